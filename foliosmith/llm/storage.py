"""Durable tables, checked broadcasts, and Python workers that give back what they no longer need."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.durable import checkpoint_dir, durable as written  # noqa: F401

#: Rows of a table of ids that may be broadcast.
BROADCAST_ROWS = 1_000_000


def small_or_not(frame: DataFrame) -> DataFrame:
    """Marked for broadcast if it is small: at most ``BROADCAST_ROWS`` rows, counted; a plain join otherwise."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


#: Bytes of rows that may be broadcast.
BROADCAST_BYTES = 48_000_000


def light_or_not(frame: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Marked for broadcast if its rows take at most ``limit`` bytes, counted; a plain join otherwise."""
    width = F.lit(8 * (len(frame.columns) + 1))
    for name, kind in frame.dtypes:
        if kind in ("string", "binary"):
            width = width + 8 + F.coalesce(F.octet_length(name), F.lit(0))
    size = frame.agg(F.sum(width.cast("bigint")).alias("size")).first()["size"] or 0
    return F.broadcast(frame) if size <= limit else frame


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def frugal(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, after which the worker, which lives on for other tasks, returns free memory to the system."""

    def trimmed(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _trim()

    return trimmed


#: Rows of an Arrow batch: Spark's own default, and for whole texts, of which a batch of that many takes tens of megabytes in the JVM and again in Python.
BATCH, TEXT_BATCH = "10000", "2000"


def rows_a_batch(spark: SparkSession, whole_texts: bool) -> None:
    """Sets the rows of an Arrow batch of the session for what runs next, unless the session has a value of its own."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) in (BATCH, TEXT_BATCH):
        spark.conf.set(name, TEXT_BATCH if whole_texts else BATCH)
