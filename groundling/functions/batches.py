"""Bounded memory of Python workers: Arrow batches by bytes, and memory that goes back to the machine."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch: a worker and the machine that feeds it hold little, however long the texts.
BATCH_BYTES, _DEFAULT_BATCH = 4 << 20, "67108864b"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends batches of at most ``BATCH_BYTES`` or one row, unless it has another bound than Spark's default."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key) == _DEFAULT_BATCH:
        conf.set(key, str(BATCH_BYTES))
    return df


def give_back() -> None:
    """The process returns the memory that it no longer uses."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``f``, after which the worker, which lives on for other tasks, gives back the memory that it no longer uses."""

    def run(batches):
        yield from f(batches)
        give_back()

    return run
