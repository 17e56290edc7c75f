"""Sessions and what executors need."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def local_session(cores: str = "*", shuffle_partitions: int = 8, name: str = "penstroke", memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries assume: UTC, adaptive execution, Arrow."""
    session = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


#: Rows of an Arrow batch: texts are long, and a batch is held in the JVM and in the worker.
ARROW_ROWS = 1000


def ship_package(spark: SparkSession) -> None:
    """Set the batch size of the session, and send the package's sources to its executors once (in local mode they are
    importable). The archive goes through the shared folder of ``spark.checkpoint.dir`` where that is set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    context = spark.sparkContext
    if context.master.startswith("local[") or context.master == "local" or getattr(context, "_penstroke_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, Path(_PACKAGE.name) / source.relative_to(_PACKAGE))
    name = f"penstroke-{uuid.uuid4().hex}.zip"
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        jvm = spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/{name}")
        stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
        stream.write(bytearray(buffer.getvalue()))
        stream.close()
        path = target.toString()
    else:
        path = str(Path(tempfile.mkdtemp(prefix="penstroke-")) / name)
        Path(path).write_bytes(buffer.getvalue())
    context.addPyFile(path)
    context._penstroke_shipped = True
