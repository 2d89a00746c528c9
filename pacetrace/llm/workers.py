"""What Python workers keep: Spark uses them again for later tasks, while the JVM beside them needs memory as well."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch; texts are whole in it, so a single longer text makes a batch of its own.
BATCH_BYTES = 16 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """From now on the session cuts Arrow batches at ``size`` bytes, unless it already does so earlier."""
    now = spark.conf.get(_BATCH)
    if not now.rstrip("b").isdigit() or int(now.rstrip("b")) > size:
        spark.conf.set(_BATCH, str(size))


def release() -> None:
    """Give freed memory back to the system: Python's, Arrow's and the allocator's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # an allocator without it
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` of a task, after which the worker releases what it no longer uses."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task
