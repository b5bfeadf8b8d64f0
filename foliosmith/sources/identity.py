"""What files are, by their content, without reading again those that have not changed.

A scan of file metadata, which opens no file, is joined with the digests that are known by path, length and time of change.  Only files that are new there are
read, in pieces of a megabyte by the tasks, so a file may be larger than memory.  A file that was copied elsewhere has the same digest and so the same identity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import stores
from .durable import durable

DIGESTS = "path string, length long, modified timestamp, sha256 string, is_pdf boolean"
_KEY = ["path", "length", "modified"]
PIECE = 1 << 20


def listed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, length, modified) of files that are not empty; none is opened."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").alias("modified"))


def _digested(files: DataFrame) -> DataFrame:
    """Adds ``sha256`` and ``is_pdf`` by reading each file; a file that is gone meanwhile has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, magic = [], []
            for path in batch.column(0).to_pylist():
                digest, head = hashlib.sha256(), None
                try:
                    store, at = stores.opened(path)
                    with store.open_input_stream(at) as file:
                        while piece := file.read(PIECE):
                            head = piece[:4] if head is None else head
                            digest.update(piece)
                except FileNotFoundError:
                    digests.append(None)
                    magic.append(None)
                    continue
                digests.append(digest.hexdigest())
                magic.append(head == b"%PDF")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string()), pa.array(magic, pa.bool_())], names=[*_KEY, "sha256", "is_pdf"])

    return files.mapInArrow(run, DIGESTS)


def identified(spark: SparkSession, path: str | list[str], known: DataFrame | None = None) -> DataFrame:
    """(path, length, modified, sha256, is_pdf, fresh) of files: ``fresh`` ones are not in ``known`` (path, length, modified, sha256, is_pdf) as they are now, and were read."""
    found = listed(spark, path)
    if known is None:
        return durable(_digested(found).withColumn("fresh", F.lit(True)), "digests")
    once = known.filter("sha256 is not null").groupBy(*_KEY).agg(F.max("sha256").alias("sha256"), F.max("is_pdf").alias("is_pdf"))
    both = durable(found.join(once, _KEY, "left"), "listed")
    old, new = both.filter("sha256 is not null"), both.filter("sha256 is null").select(*_KEY)
    return durable(old.withColumn("fresh", F.lit(False)).unionByName(_digested(new).withColumn("fresh", F.lit(True))), "digests")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """The digests that are known, none where there is no table yet."""
    try:
        return spark.read.schema(DIGESTS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DIGESTS)


def remember(files: DataFrame, path: str) -> None:
    """Adds the digests of fresh files to the table."""
    files.filter("fresh and sha256 is not null").select(*_KEY, "sha256", "is_pdf").write.mode("append").parquet(path)


def identity(path: Column, length: Column, sha256: Column) -> Column:
    """``name:size:digest``: what a file is, wherever it lies and whenever it was written."""
    return F.concat_ws(":", F.regexp_extract(path, r"([^/]+)\z", 1), length.cast("string"), sha256)
