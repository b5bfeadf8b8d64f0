"""Figure descriptions put in place of their tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import constants as K
from ..functions import text as X


def inject_descriptions(documents: DataFrame, figures: DataFrame, doc: str, text: str = "markdown", mode: str = "describe-only") -> DataFrame:
    """Replaces each figure token of a document by the block of (doc, fig_id, description, caption, crop_path).

    The figures of a document come as one map by id, so tokens are looked up in place and nothing is exploded.  Of several rows
    of one figure the greatest block (by code points) stands.
    """
    made = figures.select(doc, F.col("fig_id"), X.figure_block(F.col("fig_id"), F.col("description"), F.col("caption"), F.col("crop_path"), mode).alias("block"))
    unique = made.groupBy(doc, "fig_id").agg(F.max("block").alias("block"))
    maps = unique.groupBy(doc).agg(F.map_from_entries(F.collect_list(F.struct("fig_id", "block"))).alias("__blocks"))
    joined = documents.join(maps, doc, "left")
    ids = F.regexp_extract_all(F.col(text), F.lit(K.TOKEN), F.lit(1))
    gaps = F.split(F.col(text), K.ANY_TOKEN, -1)
    missing = X.figure_block(F.lit(""), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), "placeholder" if mode == "placeholder" else "describe-only")
    pieces = F.transform(F.arrays_zip(gaps.alias("gap"), ids.alias("id")), lambda p: F.concat(p["gap"], F.when(p["id"].isNull(), F.lit("")).otherwise(F.coalesce(F.try_element_at(F.col("__blocks"), p["id"]), missing))))
    return joined.withColumn(text, F.array_join(pieces, "")).select(*documents.columns)
