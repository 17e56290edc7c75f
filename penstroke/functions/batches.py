"""What every Arrow kernel over texts does with its batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext

#: Text bytes handled at once by a Python worker; bounds its memory whatever the batch size.
SLICE_BYTES = 1 << 20
#: Freed arrays from this size on go back to the system at once, for a worker stays resident between its tasks.
_RETURNED_BYTES = 4 << 20


@cache
def _return_memory() -> None:
    """Only in a worker: the driver's process belongs to its user."""
    if TaskContext.get() is None:
        return
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # glibc; M_MMAP_THRESHOLD and M_TRIM_THRESHOLD
        libc.mallopt(-3, _RETURNED_BYTES)
        libc.mallopt(-1, _RETURNED_BYTES)
        pa.set_memory_pool(pa.system_memory_pool())


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with at most ``limit`` text bytes each (a longer single row stays whole)."""
    _return_memory()
    if not batch.num_rows:
        return
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    yield batch.slice(start)
