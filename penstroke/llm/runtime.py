"""Session-level helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A join side is broadcast only while rows times width stay below this; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_folders: dict[str, str] = {}
_tables: dict[str, SparkSession] = {}


def _remove(path, configuration) -> None:
    path.getFileSystem(configuration).delete(path, True)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this driver's that every executor can reach, below ``spark.checkpoint.dir``; it goes when the driver ends.

    Where that is unset, a local session gets a private folder; on a cluster it is an error, since executors would write
    to their own disks.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or ""
    if named not in _folders:
        if named:
            _folders[named] = f"{named.rstrip('/')}/penstroke-{uuid.uuid4().hex}"
            atexit.register(_remove, spark._jvm.org.apache.hadoop.fs.Path(_folders[named]), spark._jsc.hadoopConfiguration())
        elif is_local(spark.sparkContext.master):
            own = tempfile.mkdtemp(prefix="penstroke-")
            atexit.register(shutil.rmtree, own, True)
            _folders[named] = "file://" + own
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share; intermediate tables are written there")
    return _folders[named]


def is_local(master: str) -> bool:
    """Whether executors run within the driver."""
    return master == "local" or master.startswith("local[")


def materialise(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    A lost executor then costs a re-read, never a recomputation of the whole chain. The shuffle files that led to the
    table are removed once it is written.
    """
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        (df.coalesce(partitions) if partitions else df).write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    _tables[path] = df.sparkSession
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._penstroke_path = path
    return kept


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialise`` that nothing will read again."""
    for df in tables:
        _discard(getattr(df, "_penstroke_path", ""))


def _discard(path: str) -> None:
    if spark := _tables.pop(path, None):
        _remove(spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration())


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], None]]:
    """Tables made within are removed at the end, but for those handed to the function that this gives."""
    before, kept = set(_tables), set()
    yield lambda df: kept.add(getattr(df, "_penstroke_path", ""))
    for path in set(_tables) - before - kept:
        _discard(path)


def sized_hint(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only when the counted size is below ``BROADCAST_BYTES``; otherwise the plain (shuffled) side."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one like it that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of fewer splits than there are cores is spread over them."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for part in batch.column("sums").to_pylist():
            total = np.frombuffer(part) if total is None else total + np.frombuffer(part)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["sums"])


def add_up(partials: DataFrame) -> np.ndarray | None:
    """Sum of the float64 vectors in column ``sums``, one a partition: added in 8 tasks, then on the driver."""
    rows = partials.repartition(8).mapInArrow(_sum_up, "sums binary").collect()
    return np.sum([np.frombuffer(r.sums) for r in rows], axis=0) if rows else None
