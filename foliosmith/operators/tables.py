"""Table operators: blobs of pages, their regions, and the restructured tables put in their place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import layout as L, tables as T, text as X


def page_blobs(pages: DataFrame, *keys: str, text: str = "markdown", regions: str | None = "regions") -> DataFrame:
    """(keys, blob_idx, blobs_on_page, start, end, blob, refinable, region): every blob, numbered from 1 among all of the page; refinable ones with their region."""
    nothing = F.lit(None).cast("int")

    def placed(bs: Column) -> Column:
        if not regions:
            return F.transform(bs, lambda b, i: F.struct((i + 1).alias("at"), b.alias("b"), nothing.alias("r")))
        able = F.filter(bs, lambda b: b["refinable"])
        matched = T.match_regions(F.transform(able, lambda b: b["blob"]), F.col(regions))
        numbers = lambda m: F.transform(bs, lambda b, i: F.struct((i + 1).alias("at"), b.alias("b"), F.when(b["refinable"], F.element_at(m, b["start"])).alias("r")))
        return X.let(F.map_from_arrays(F.transform(able, lambda b: b["start"]), matched), numbers)

    guarded = F.transform(T.find_blobs(F.col(text)), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["blob"].alias("blob"), T.is_refinable(b["blob"]).alias("refinable")))
    # An outer explode, as of a plain one the optimizer makes a filter that finds all blobs again.
    rows = pages.select(*keys, *([regions] if regions else []), F.explode_outer(X.let(guarded, lambda bs: X.let(placed(bs), lambda p: F.transform(p, lambda x: F.struct(x["at"].alias("blob_idx"), F.size(p).alias("blobs_on_page"), x["b"].alias("b"), x["r"].alias("r")))))).alias("__x")).filter("__x is not null")
    region = F.when(F.col("__x.r").isNotNull(), F.get(F.col(regions), F.col("__x.r"))) if regions else F.lit(None).cast("string")
    return rows.select(*keys, "__x.blob_idx", "__x.blobs_on_page", "__x.b.start", "__x.b.end", "__x.b.blob", "__x.b.refinable", region.alias("region"))


def crop_boxes(blobs: DataFrame, width: str = "width_px", height: str = "height_px") -> DataFrame:
    """Adds ``px_box`` of the matched region, padded as table crops are."""
    return blobs.withColumn("px_box", F.when(F.col("region").isNotNull(), L.pixel_box(F.col("region.bbox"), F.col(width), F.col(height), K.TABLE_CROP_PADDING)))


def splice_answers(pages: DataFrame, answers: DataFrame, *keys: str, text: str = "markdown") -> DataFrame:
    """Puts the accepted answers (keys, start, end, blob, answer) in place of their blobs; a rejected answer keeps its blob.  Adds ``tables_refined``."""
    table = X.let(T.accepted(F.col("blob"), F.col("answer")), lambda t: F.when(t.isNotNull(), F.struct("start", "end", t.alias("table"))))
    good = answers.groupBy(*keys).agg(F.collect_list(table).alias("__tables"))
    joined = pages.join(good, list(keys), "left")
    done = F.when(F.coalesce(F.size("__tables"), F.lit(0)) == 0, F.col(text)).otherwise(T.splice(F.col(text), F.col("__tables")))
    return joined.withColumn(text, done).withColumn("tables_refined", F.coalesce(F.size("__tables"), F.lit(0))).select(*pages.columns, "tables_refined")
