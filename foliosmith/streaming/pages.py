"""Page arrivals as a stream: parsing is stateless; a page that comes again within the watermark counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import memo as memo_op, pages as pages_op

ARRIVAL = "doc_id string, page_number int, width_px int, height_px int, raw string, arrived timestamp"


def page_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Arriving page files as parsed pages."""
    rows = spark.readStream.schema(ARRIVAL).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return pages_op.parse_pages(rows)


def distinct_pages(pages: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Pages of new content: their key is seen once within the watermark, which bounds the state."""
    keyed = pages.withColumn("key", memo_op.key_of("page", doc=F.col("doc_id"), page=F.col("page_number"), raw=F.col("raw")))
    return keyed.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["key"])
