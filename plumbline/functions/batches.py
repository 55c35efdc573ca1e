"""How rows are dealt out to Python workers, and what these hold at once. No result depends on it."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes a core below which a table in fewer files than there are cores is dealt out anew.
SMALL = 64 << 20
#: Bytes of text that a worker holds as Python objects at once, or one text.
PART = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where it is a small table in so few files that most cores would have none of it, else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= cores * SMALL:
        return df
    return df.repartition(cores) if 0 < len(df.inputFiles()) < cores else df


def parts(n_bytes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of items of so many bytes together, or of one item."""
    i = size = 0
    for j, n in enumerate(n_bytes):
        if j > i and size + n > most:
            yield i, j
            i, size = j, 0
        size += n
    if i < len(n_bytes):
        yield i, len(n_bytes)


@cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives memory that is free within this process back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    if _trim() is not None:
        _trim()(0)
