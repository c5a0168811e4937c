"""Python workers are used again: what a task leaves behind counts against the next one's memory."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession


@functools.cache
def _trim() -> Callable[[int], int] | None:
    """The C library's call that returns free memory to the system, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives the worker's unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker's unused memory goes back to the system."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        release()

    return wrapped


#: Texts reach a worker in batches of so many bytes, or one text.
BATCH_BYTES = 32_000_000


@contextlib.contextmanager
def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> Iterator[None]:
    """Plans made meanwhile bound the bytes of a batch of rows besides their number."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(most))
    try:
        yield
    finally:
        spark.conf.set(key, before)
