"""Files in and out, through Spark's readers and writers, so that any store works."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import layout as L, text as X, urls as U
from ..operators import memo as memo_op
from . import sink, stores
from .durable import durable

BUNDLE_SCHEMA = 1
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
PAGE = f"doc_id string, page_number int, width_px int, height_px int, raster_sha256 string, raw string, markdown string, truncated boolean, regions array<struct<label:string,bbox:{BOX},text:string,figure:int>>, bundle_schema int"
MEMO = "key string, value_schema int, text string, written_at timestamp, truncated boolean"


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, content, sha256, is_pdf) of files; a file without the PDF magic is told by ``is_pdf``."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?\z", 1).alias("name"), "content", F.sha2("content", 256).alias("sha256"), (F.substring("content", 1, 4) == F.lit(b"%PDF")).alias("is_pdf"))


def route_inputs(inputs: DataFrame, value: str = "value", offline: bool = False) -> DataFrame:
    """Adds ``is_url``, ``pdf_url`` (over HTTPS), ``file_name`` and ``error``; a URL that no repository serves keeps its address and has no name.

    Offline, each URL has an error and no address.
    """
    url = F.regexp_replace(X.strip(F.col(value)), r"(?i)\Ahttp://", "https://")
    may = F.col("is_url") & ~F.lit(offline)
    routed = inputs.withColumn("is_url", U.is_url(F.col(value))).withColumn("pdf_url", F.when(may, U.pdf_url(url))).withColumn("file_name", F.when(may, U.file_name(url)))
    return routed.withColumn("error", F.when(F.col("is_url") & F.lit(offline), F.lit("no download: offline")))


def downloads(routed: DataFrame, fetch: Callable[[str], bytes]) -> DataFrame:
    """Adds ``content``, ``sha256``, ``is_pdf`` and ``error`` to rows with a ``pdf_url``; ``fetch`` is the client, made known by the caller, and a failed call is an error of its row."""
    names = [c for c in routed.columns if c not in ("content", "error")]
    shown = routed.select(*names, F.col("error").alias("error") if "error" in routed.columns else F.lit(None).cast("string").alias("error"))
    place, last = names.index("pdf_url"), len(names)
    schema = T.StructType([*shown.schema.fields, T.StructField("content", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 16):
                part = batch.slice(lo, 16)
                errors, contents = [], []
                for url, error in zip(part.column(place).to_pylist(), part.column(last).to_pylist()):
                    content = None
                    if url is not None and error is None:
                        try:
                            content = fetch(url)
                        except Exception as e:  # a failed download is data, not a failed job
                            error = str(e)
                    errors.append(error)
                    contents.append(content)
                yield pa.RecordBatch.from_arrays([*part.columns[:last], pa.array(errors, pa.string()), pa.array(contents, pa.binary())], names=schema.names)

    return shown.mapInArrow(run, schema).withColumn("sha256", F.sha2("content", 256)).withColumn("is_pdf", F.substring("content", 1, 4) == F.lit(b"%PDF"))


def page_images(pdfs: DataFrame, render: Callable[[bytes, int], Iterable[tuple[int, int, int, bytes]]], long_edge: int) -> DataFrame:
    """(doc_id, page_number, width_px, height_px, raster_sha256, raster, error) of (doc_id, content); ``render(pdf, long edge)`` gives (page number, width, height, image) of each page.

    The pages of one file stream out one by one, so memory holds one of them; a file that can't be read is one row with an error.
    """
    schema = "doc_id string, page_number int, width_px int, height_px int, raster_sha256 string, raster binary, error string"
    fields = T._parse_datatype_string(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(*values) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=fields.names)

        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    for number, width, height, image in render(content.as_py(), long_edge):
                        yield row(doc, number, width, height, hashlib.sha256(image).hexdigest(), image, None)
                except Exception as e:  # an unreadable file is data, not a failed job
                    yield row(doc, None, None, None, None, None, str(e))

    return pdfs.select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInArrow(run, schema)


def write_bundle(pages: DataFrame, path: str) -> None:
    """Parsed pages as a table that ``read_bundle`` gives back; absent optional columns become null."""
    schema = T._parse_datatype_string(PAGE)
    have = set(pages.columns)
    columns = [F.lit(BUNDLE_SCHEMA).alias(f.name) if f.name == "bundle_schema" else (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    pages.select(*columns).write.mode("errorifexists").parquet(path)


def check_references(pages: DataFrame, present: DataFrame) -> DataFrame:
    """The pages, after a check that all crops and page images they refer to are among ``present`` (path): an error names one that is missing."""
    ids = F.transform(F.filter("regions", lambda r: r["figure"].isNotNull()), lambda r: F.concat(F.lit("figures/"), L.figure_id(F.col("page_number"), r["figure"]), F.lit(".png")))
    wanted = pages.select(F.explode(F.concat(ids, F.when(F.col("raster_sha256").isNotNull(), F.array(F.concat(F.lit("pages/"), "raster_sha256", F.lit(".png")))).otherwise(F.array().cast("array<string>")))).alias("path"))
    missing = memo_op.missing_references(wanted, present, "path").orderBy("path").limit(1).collect()
    if missing:
        raise ValueError(f"the bundle lacks {missing[0]['path']}")
    return pages


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """The pages of a bundle; rows of a newer schema are an error, not a guess."""
    rows = spark.read.schema(PAGE).parquet(path)
    newer = F.coalesce(F.col("bundle_schema"), F.lit(BUNDLE_SCHEMA + 1)) > BUNDLE_SCHEMA
    return rows.withColumn("bundle_schema", F.when(newer, F.raise_error(F.lit("bundle of a newer schema")).cast("int")).otherwise(F.col("bundle_schema")))


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """(base, part, content) of ``{base}_main.md``, ``{base}_appendix.md`` and ``{base}_backmatter.md`` files."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\z", 1).alias("file"), F.col("value").alias("content"))
    return rows.select(F.regexp_extract("file", r"\A(.*)_(?:main|appendix|backmatter)\.md\z", 1).alias("base"), F.regexp_extract("file", r"_(main|appendix|backmatter)\.md\z", 1).alias("part"), "content").filter("part <> ''")


def one_main_each(parts: DataFrame) -> DataFrame:
    """The parts, after a check that each stem has just one part of a kind and a main one: an error names a stem that has not."""
    counts = parts.groupBy("base").agg(F.sum(F.when(F.col("part") == "main", 1).otherwise(0)).alias("mains"), F.count("*").alias("n"), F.count_distinct("part").alias("kinds"))
    wrong = counts.filter("mains <> 1 or n <> kinds").orderBy("base").limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['base']}: {wrong[0]['mains']} main parts, {wrong[0]['n']} parts of {wrong[0]['kinds']} kinds")
    return parts


def write_texts(files: DataFrame, root: str, clobber: bool = True, name: str = "file", content: str = "content") -> DataFrame:
    """(path) of each text written to ``root``/``name``, in UTF-8 with LF line ends, all or none; executors write, so ``root`` is a store or a folder that they all see.

    Without ``clobber`` a file that is there already is an error, and none is written.
    """
    return write_output(files.select(F.col(name).alias("file"), F.col(content).alias("content")), None, "", root, clobber)


def present(names: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """(path, there) of names of files below a folder, asked of its store in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = stores.opened(folder)
        for batch in batches:
            found = store.get_file_info([stores.joined(at, n) for n in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f.is_file for f in found], pa.bool_())], names=["path", "there"])

    return names.select(F.col(path).alias("path")).mapInArrow(run, "path string, there boolean")


def _crops(figures: DataFrame, source: str, path: str) -> DataFrame:
    return durable(present(figures.filter(F.col(path).isNotNull()).select(F.col(path).alias("path")).distinct(), source), "crops")


def write_output(texts: DataFrame, crops: DataFrame | None, source: str, root: str, clobber: bool = True) -> DataFrame:
    """(path) of the texts (file, content) and of the crops (path, there) in ``source`` that are there, written in one commit: all or none."""
    none = F.lit(None).cast("string")
    rows = texts.select("file", F.coalesce("content", F.lit("")).alias("content"), none.alias("source"))
    if crops is not None and source.rstrip("/") != root.rstrip("/"):
        rows = rows.unionByName(crops.filter("there").select(F.col("path").alias("file"), none.alias("content"), F.concat(F.lit(source.rstrip("/") + "/"), "path").alias("source")))
    sink.publish(rows, root, clobber)
    return rows.select(F.concat(F.lit(root.rstrip("/") + "/"), "file").alias("path"))


def copy_figures(figures: DataFrame, source: str, root: str, clobber: bool = True, path: str = "crop_path") -> DataFrame:
    """(path, copied) of the crops that descriptions refer to: copied from the bundle's folder to the output's under the same name, all or none; a missing one is told, not an error."""
    crops = _crops(figures, source, path)
    if source.rstrip("/") != root.rstrip("/"):
        write_output(crops.select(F.col("path").alias("file"), F.lit("").alias("content")).limit(0), crops, source, root, clobber)
    return crops.select("path", F.col("there").alias("copied"))


def write_documents(parts: DataFrame, path: str, clobber: bool = False) -> None:
    """Document parts by part, with their output stem; refuses a taken path unless ``clobber``."""
    parts.write.mode("overwrite" if clobber else "errorifexists").partitionBy("part").parquet(path)
