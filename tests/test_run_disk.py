"""What a whole run writes and shuffles: no page text more often than it needs."""

import glob
import os
import random

from pyspark.sql import functions as F

from foliosmith.functions import tables as T
from foliosmith.plans import transcribe
from foliosmith.sources import files
from foliosmith.sources.durable import checkpoint_dir

BLOB = "<table><tr><td>1</td><td>2</td></tr></table>"


def test_a_run_writes_texts_of_pages_twice(spark):
    rng = random.Random(2)
    texts = [" ".join(f"{rng.randrange(10**6):06d}" for _ in range(3000)) for _ in range(24)]
    rows = [(f"d{k // 4}", k % 4 + 1, 1000, 1000, f"r{k}", f"image[[10, 10, 500, 500]]\ntext[[0, 61, 900, 999]]{text}\n", "stop") for k, text in enumerate(texts)]
    pages = spark.createDataFrame(rows, "doc_id string, page_number int, width_px int, height_px int, raster_sha256 string, raw string, finish_reason string")
    folder = checkpoint_dir(spark).removeprefix("file:")
    seen = set(glob.glob(f"{folder}/*"))
    documents, _ = transcribe.run(pages, spark.createDataFrame([], files.MEMO))
    got = {r["doc_id"]: r["markdown"] for r in documents.collect()}
    assert len(got) == 6 and all(text in got[f"d{k // 4}"] for k, text in enumerate(texts))
    new = set(glob.glob(f"{folder}/*")) - seen
    size = sum(os.path.getsize(f) for d in new for f in glob.glob(f"{d}/*.parquet"))
    assert 0 < size < 2.2 * sum(map(len, texts))
    for d in new:
        if os.path.basename(d).startswith(("parsed-", "refined-")):
            assert not {"raw", "blocks"} & set(spark.read.parquet(d).columns)


def test_tables_match_regions_by_the_texts_that_are_kept(spark):
    box = "named_struct('x1', 0.1D, 'y1', 0.1D, 'x2', 0.9D, 'y2', 0.9D)"
    made = lambda *rs: "array(" + ", ".join(f"named_struct('label', {label}, 'bbox', {box}, 'text', {text}, 'figure', CAST({figure} AS INT))" for label, text, figure in rs) + ")"
    cases = [made(("'text'", "'long'", "null"), ("'table'", "null", "null"), ("'text'", f"'{BLOB}'", "null"), ("'image'", "'caption'", "1")), made(("'table'", f"'{BLOB}'", "null")), made(("'text'", f"'{BLOB}'", "null")), made(("CAST(null AS STRING)", "'x'", "null"))]
    for case in cases:
        row = spark.range(1).select(F.expr(case).alias("regions")).withColumn("kept", T.region_texts(F.col("regions")))
        blobs = F.array(F.lit(BLOB))
        r = row.select(T.match_regions(blobs, F.col("regions")).alias("a"), T.match_regions(blobs, F.col("kept")).alias("b"), F.filter("regions", lambda x: x["figure"].isNotNull()).alias("f"), F.filter("kept", lambda x: x["figure"].isNotNull()).alias("g")).first()
        assert r["a"] == r["b"] and r["f"] == r["g"]
