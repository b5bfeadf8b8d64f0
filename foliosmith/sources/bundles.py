"""Bundles of one document each: a folder ``{name}_ocr`` with ``manifest.json`` beside its crops and page images.

Manifests are read by Spark's own JSON reader with a fixed schema, one file a bundle, so fields that are not known are skipped and those that are absent are
null.  Manifests of a newer schema, and crops or images that are named and not there, are errors of the job that reads them, which no extra job looks for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import layout as L, text as X
from .files import BOX, BUNDLE_SCHEMA

FOLDER = "_ocr"
REGION = f"struct<label:string,bbox:{BOX},text:string,figure:int>"
FIGURE = f"struct<fig_id:string,bbox:{BOX},caption:string,crop_path:string>"
PAGE = f"struct<page_number:int,width_px:int,height_px:int,markdown:string,raw:string,truncated:boolean,regions:array<{REGION}>,figures:array<{FIGURE}>,raster_path:string,raster_sha256:string>"
MANIFEST = f"bundle_schema int, created_at string, source struct<doc_id:string,name:string,url:string>, ocr struct<backend:string,model:string,resolution:string>, figure_detect string, figure_crop_padding double, pages array<{PAGE}>"


def manifests(pages: DataFrame, created_at: str, ocr: dict[str, str] | None = None, figure_detect: str = "auto", crop_padding: float | None = None) -> DataFrame:
    """(file, content): the manifest of each document of parsed pages (doc_id, page_number, markdown, regions, ...; optional name and url); figures refer to crops ``figures/{id}.png``."""
    have = set(pages.columns)
    at = lambda c, kind: (F.col(c) if c in have else F.lit(None)).cast(kind)
    crop = lambda r: F.concat(F.lit("figures/"), L.figure_id(F.col("page_number"), r["figure"]), F.lit(".png"))
    figures = F.transform(F.filter("regions", lambda r: r["figure"].isNotNull()), lambda r: F.struct(L.figure_id(F.col("page_number"), r["figure"]).alias("fig_id"), r["bbox"].alias("bbox"), r["text"].alias("caption"), crop(r).alias("crop_path")))
    sha = at("raster_sha256", "string")
    page = F.struct(
        F.col("page_number").cast("int").alias("page_number"), at("width_px", "int").alias("width_px"), at("height_px", "int").alias("height_px"), F.col("markdown"), at("raw", "string").alias("raw"), at("truncated", "boolean").alias("truncated"),
        F.col("regions").cast(f"array<{REGION}>").alias("regions"), figures.alias("figures"), F.concat(F.lit("pages/"), sha, F.lit(".png")).alias("raster_path") if "raster_path" not in have else F.col("raster_path"), sha.alias("raster_sha256"),
    )
    name = F.first(F.coalesce(at("name", "string"), F.col("doc_id").cast("string")), ignorenulls=True)
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"), name.alias("name"), F.first(at("url", "string"), ignorenulls=True).alias("url"))
    made = F.struct(
        F.lit(BUNDLE_SCHEMA).alias("bundle_schema"), F.lit(created_at).alias("created_at"), F.struct(F.col("doc_id").cast("string").alias("doc_id"), "name", "url").alias("source"),
        F.struct(*[F.lit((ocr or {}).get(k)).cast("string").alias(k) for k in ("backend", "model", "resolution")]).alias("ocr"), F.lit(figure_detect).alias("figure_detect"), F.lit(crop_padding).cast("double").alias("figure_crop_padding"), "pages",
    )
    return docs.select(F.concat(X.base_name(F.col("name")), F.lit(f"{FOLDER}/manifest.json")).alias("file"), F.concat(F.to_json(made, {"pretty": "true"}), F.lit("\n")).alias("content"))


def _plain(path: Column) -> Column:
    """A path without the slashes that some readers put after the scheme of local files."""
    return F.regexp_replace(path, r"\Afile:/+", "file:/")


def _named_files(rows: DataFrame, spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """(path, there) of crops and page images that pages name; ``there`` is null for those that are not below ``folders``."""
    named = F.concat(F.transform("figures", lambda f: f["crop_path"]), F.array("raster_path"))
    wanted = rows.select(F.explode(F.transform(F.filter(named, lambda p: p.isNotNull()), lambda p: F.concat(F.col("bundle"), F.lit("/"), p))).alias("path"))
    try:
        there = spark.read.format("binaryFile").load([f"{f}/{sub}/*" for f in folders for sub in ("figures", "pages")]).select(_plain(F.col("path")).alias("path"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return wanted.withColumn("there", F.lit(None).cast("string"))
    return wanted.join(there.withColumn("there", F.lit("")), "path", "left")


def read_bundles(spark: SparkSession, root: str, names: Sequence[str] | None = None, check: bool = True) -> DataFrame:
    """(doc_id, name, url, bundle, page_number, ...) of the pages of all bundles below ``root``, or of those that ``names`` has, of which alone a file is opened.

    With ``check`` a crop or image that is named and missing fails the job.
    """
    folders = [f"{root.rstrip('/')}/{n}{FOLDER}" for n in (["*"] if names is None else names)]
    read = spark.read.schema(MANIFEST).option("multiLine", "true").option("mode", "PERMISSIVE").json([f"{f}/manifest.json" for f in folders])
    at = _plain(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    rows = read.withColumn("bundle", F.regexp_replace(at, r"/manifest\.json\z", ""))
    wrong = F.when(F.col("bundle_schema").isNull(), F.concat(F.col("bundle"), F.lit(": no bundle_schema"))).when(F.col("bundle_schema") > BUNDLE_SCHEMA, F.concat(F.col("bundle"), F.lit(": bundle of a newer schema")))
    gated = rows.withColumn("pages", F.when(wrong.isNotNull(), F.raise_error(wrong).cast(f"array<{PAGE}>")).otherwise(F.col("pages")))
    about = ["source.doc_id", "source.name", "source.url", "bundle", "ocr", "figure_detect", "figure_crop_padding"]
    pages = gated.select(*about, F.explode("pages").alias("p")).select("doc_id", "name", "url", "bundle", "ocr", "figure_detect", "figure_crop_padding", "p.*")
    if not check:
        return pages
    # The message uses both sides of the join, so that the error is not pushed below it, where it would be raised for files that are there too.
    told = F.concat(F.lit("the bundle lacks "), F.col("path"), F.coalesce("there", F.lit("")))
    lost = _named_files(pages, spark, folders).filter("there is null").select(F.raise_error(told).cast("string").alias("doc_id"))
    none = {f.name: F.lit(None).cast(f.dataType) for f in pages.schema.fields if f.name != "doc_id"}
    return pages.unionByName(lost.withColumns(none))
