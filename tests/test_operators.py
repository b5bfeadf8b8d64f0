"""Operators and whole plans on small tables."""

import pytest
from pyspark.sql import functions as F

from foliosmith.operators import memo, pages
from foliosmith.plans import config, inference, transcribe
from foliosmith.sources import files, memo_table
from foliosmith.streaming import pages as streaming

HEAD, FOOT = "Journal of Tests", "Page %d"


def page_rows(spark, texts):
    return spark.createDataFrame([("d", k + 1, t) for k, t in enumerate(texts)], "doc string, page int, md string")


def chrome(spark, texts):
    return [r["md"] for r in pages.strip_chrome(page_rows(spark, texts), "doc", "md").orderBy("page").collect()]


def test_chrome(spark):
    assert chrome(spark, [f"{HEAD}\nbody {k}\n{FOOT % k}" for k in range(3)]) == ["body 0", "body 1", "body 2"]
    kept = [f"{word}\n⟦FIG:fig_p1_1⟧" for word in ("one", "two", "three", "four")]
    assert chrome(spark, kept) == kept
    two_of_four = [f"{HEAD}\na", f"{HEAD}\nb", "c\nd", "e\nf"]
    assert chrome(spark, two_of_four) == two_of_four
    assert chrome(spark, [f"{HEAD}\na"] * 2) == [f"{HEAD}\na"] * 2
    rows = [f"t{k}\n| 1 |" for k in ("q", "r", "s", "t")]
    assert chrome(spark, rows) == rows


def test_stitch(spark):
    got = pages.stitch_pages(page_rows(spark, ["page one\n", "\npage two"]), "doc", "page", "md").first()
    assert got["markdown"] == "page one\n\npage two"


def test_memo_runs_once(spark):
    items = spark.createDataFrame([("k1", "p"), ("k1", "p"), ("k2", "bad")], "key string, prompt string").withColumn("image", F.lit(None).cast("string"))
    empty = spark.createDataFrame([], files.MEMO)

    class Failing(inference.StubBackend):
        def answer(self, prompt, image):
            if prompt == "bad":
                raise RuntimeError("no")
            return super().answer(prompt, image)

    done, entries = memo.memoised(items, empty, lambda misses: inference.infer(misses, Failing), 2)
    rows = entries.collect()
    assert [r["key"] for r in rows] == ["k1"] and done.filter("error is not null").count() == 1
    stored = spark.createDataFrame(rows, files.MEMO)
    hits, misses = memo.split_hits(items, stored, 2)
    assert hits.count() == 2 and misses.count() == 1
    assert memo.split_hits(items, stored, 1)[0].count() == 0
    with pytest.raises(ValueError):
        memo.figure_key(F.lit("p"))


def raw_pages(spark):
    rows = []
    for p in range(1, 4):
        table = "<table><tr><td>1</td><td>2</td></tr></table>"
        rows.append(("d", p, 800, 1000, "sha", f"title[[1,1,9,9]]{HEAD}\nimage[[100,100,500,500]]text[[1,1,900,900]]Body of page {p} with hyph-\nens. table_caption[[1,1,9,9]]{table} text[[2,2,9,9]]End {'abc'[p - 1]}", "stop"))
    return spark.createDataFrame(rows, "doc_id string, page_number int, width_px int, height_px int, raster_sha256 string, raw string, finish_reason string")


def test_whole_run(spark, tmp_path):
    empty = spark.createDataFrame([], files.MEMO)
    docs, entries = transcribe.run(raw_pages(spark), empty)
    text = docs.first()["markdown"]
    assert "Stub description" in text and "⟦" not in text and "hyphens" in text and HEAD not in text and "<table>" in text
    memo_table.append_memo(entries, str(tmp_path / "memo"))
    again, fresh = transcribe.run(raw_pages(spark), memo_table.read_memo(spark, str(tmp_path / "memo")))
    assert again.first()["markdown"] == text
    parts = transcribe.outputs(docs.withColumn("bibtex", F.lit("@misc{k,\n}"))).collect()
    assert {r["part"] for r in parts} == {"full", "main"} and all("Transcribed with" in r["content"] for r in parts)


def test_page_range_and_bundle(spark, tmp_path):
    parsed = transcribe.ocr_pass(raw_pages(spark), config.resolve({"pages": "2-"}))
    assert sorted(r["page_number"] for r in parsed.collect()) == [2, 3]
    files.write_bundle(parsed, str(tmp_path / "b"))
    back = files.read_bundle(spark, str(tmp_path / "b"))
    assert back.count() == 2 and back.select("regions").first()["regions"][0]["label"] == "title"


def test_config():
    got = config.resolve({"figure": {"detect": "none", "unknown": 1}}, {"figure": {"detect": None, "mode": "placeholder"}})
    assert got.figure.detect == "none" and got.figure.mode == "placeholder"
    with pytest.raises(config.ConfigError) as e:
        config.resolve({"figure": {"detect": "x", "crop_padding": 2}, "table": {"refine": "yes"}})
    assert len(str(e.value).splitlines()) == 3
    assert inference.known_backends() == ["stub"]


def test_stream_equals_batch(spark, tmp_path):
    rows = raw_pages(spark).select("doc_id", "page_number", "width_px", "height_px", "raw").withColumn("arrived", F.lit("2024-01-01").cast("timestamp"))
    rows.unionByName(rows).write.parquet(str(tmp_path / "in"))
    stream = streaming.distinct_pages(streaming.page_stream(spark, str(tmp_path / "in")))
    query = stream.select("doc_id", "page_number", "markdown").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = pages.parse_pages(raw_pages(spark)).select("doc_id", "page_number", "markdown")
    assert sorted(spark.table("arrived").collect()) == sorted(want.collect())


def test_pdf_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.pdf").write_bytes(b"text")
    got = {r["name"]: r["is_pdf"] for r in files.read_pdfs(spark, str(tmp_path)).collect()}
    assert got == {"a": True, "b": False}


def test_embedded_figures_are_sorted(spark):
    box = "struct<x1:double,y1:double,x2:double,y2:double>"
    frame = spark.createDataFrame([([(0.0, 0.5, 1.0, 1.0), (0.0, 0.1, 1.0, 0.2)],)], f"embedded array<{box}>")
    got = pages.select_figures(frame.withColumn("regions", F.lit(None)), "pdf-embedded").first()["regions"]
    assert [r["bbox"]["y1"] for r in got] == [0.1, 0.5]
    with pytest.raises(ValueError):
        pages.select_figures(frame, "grounding", supports_grounding=False)
