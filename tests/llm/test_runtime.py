import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from penstroke.llm import runtime as R


class _Session:
    """What ``shared_dir`` asks of a session."""

    def __init__(self, spark, master, folder):
        self._jvm, self._jsc = spark._jvm, spark._jsc
        self.sparkContext = SimpleNamespace(master=master)
        self.conf = SimpleNamespace(get=lambda key, default=None: folder if key == "spark.checkpoint.dir" else default)


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    monkeypatch.setattr(R, "_folders", {})
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        R.shared_dir(_Session(spark, "yarn", None))
    assert R.shared_dir(_Session(spark, "local[4]", None)).startswith("file:///")
    for master, local in (("local", True), ("local[8]", True), ("local-cluster[3,2,1000]", False), ("yarn", False), ("spark://a:7077", False), ("k8s://https://a", False)):
        assert R.is_local(master) == local


def test_the_named_folder_is_used(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(R, "_folders", {})
    for master in ("yarn", "local[4]"):
        assert R.shared_dir(_Session(spark, master, f"file://{tmp_path}")).startswith(f"file://{tmp_path}/penstroke-")


def test_tables_go_when_their_consumer_is_done(spark):
    def there(df):
        return os.path.exists(df._penstroke_path.removeprefix("file://"))

    one = R.materialise(spark.range(3))
    with R.scratch() as keep:
        two, three = R.materialise(one.withColumn("x", F.lit(1))), R.materialise(one)
        keep(three)
    assert there(one) and there(three) and not there(two)
    R.discard(one, three, spark.range(1))
    assert not there(one) and not there(three)
