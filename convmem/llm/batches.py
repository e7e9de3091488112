"""The memory of Python tasks: the size of the batches they get, and what they leave behind."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch; 10,000 rows of text, the default bound, can be hundreds of megabytes.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Lowers the session's bound on a batch's bytes, so that a task's Python memory does not
    depend on how long texts are. A lower bound that is set already stays."""
    now = spark.conf.get(_KEY, "67108864b").lower().rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= most:
        spark.conf.set(_KEY, str(most))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow, with its memory given back to the machine when a task ends: Spark keeps the
    Python processes for later tasks, also those of other operators."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return task
