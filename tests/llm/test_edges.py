"""Nulls in any column, empty and very long texts, repeated rows, empty tables and columns with clashing names, for the narrow operators and the pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliosmith.llm import chat, decontam, langid, licences, packing, pii
from foliosmith.llm.queries import public_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ids string, start int, length string, pii string, score string, lang_pred string, family string, item_id string, edits string, sequence_id string, __text string, __row string, __lang string, __pii string"
NOTICE = "Released under the MIT License."
LONG = "the tide and the wind " * 20_000
NOSPACE = "潮汐" * 20_000


def table(spark, empty=False):
    extra = ("x", 1, "x", "x", "x", "x", "x", "x", "x", "x", "x", "x", "x", "x")
    texts = [(1, "a tide came in\n" + NOTICE), (1, "a tide came in\n" + NOTICE), (2, None), (None, "an id is missing, mail a@b.org"), (3, ""), (4, " \n "), (5, LONG), (6, NOSPACE), (7, "12 !? 34")]
    rows = [(k, t, None if k == 6 else "en" if (k or 0) % 2 else "de", None if k == 5 else "s", len(t) if t else None, *extra) for k, t in texts]
    return spark.createDataFrame([] if empty else rows, SCHEMA).repartition(3)


def pairs(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_licences(spark):
    docs = table(spark)
    model = licences.fit(docs)
    found = licences.scan(docs, model)
    assert found.columns == ["doc_id", "family", "probability", "similarity", "start", "end"]
    assert pairs(found, "doc_id", "family", "start", "end") == [(1, "mit", 15, 15 + len(NOTICE) - 1)] * 2
    none = table(spark, empty=True)
    assert licences.scan(none, licences.fit(none)).count() == 0


def test_decontamination(spark):
    items = spark.createDataFrame([(10, "the wind and the tide"), (11, None), (12, "tide came"), (12, "tide came"), (None, "missing")], "item_id long, text string")
    got = pairs(decontam.contaminated(table(spark), items), "doc_id", "item_id", "edits", "start", "end")
    assert got == [(1, 12, 0, 2, 11)] * 2
    left = decontam.clean(table(spark), items)
    assert left.columns == table(spark).columns and left.count() == 7
    assert decontam.clean(table(spark, empty=True), items).count() == 0


def test_packing(spark):
    pieces = packing.pack(table(spark), public_vocabulary(), size=4096)
    assert pieces.columns == ["doc_id", "ids", "start", "length", "doc_tokens", "sequence_id", "offset"]
    rows = pieces.collect()
    own = packing.WordTokenizer(public_vocabulary())
    sizes = {5: len(own.ids(LONG)) // 4 + 1, 6: len(own.ids(NOSPACE)) // 4 + 1, 2: 1, 3: 1, 4: 1}
    for k, n in sizes.items():
        assert sum(r["length"] for r in rows if r["doc_id"] == k) == n and {r["doc_tokens"] for r in rows if r["doc_id"] == k} == {n}
    assert sum(r["doc_id"] == 1 for r in rows) >= 2 and sum(r["doc_id"] is None for r in rows) >= 1


def test_language(spark):
    docs = table(spark)
    model = langid.fit(docs, F.lit(True))
    got = pairs(langid.predict(docs, model), "doc_id", "lang_pred")
    assert len(got) == 9 and {k for k, lang in got if lang == "und"} == {2, 3, 4, 7} and (None, "und") not in got
    kept = langid.predict(docs, model, keep=docs.columns, names=("__l", "__s"))
    assert kept.columns == [*docs.columns, "__l", "__s"] and kept.count() == 9


def test_pii(spark):
    found = pii.find_pii(table(spark))
    assert [(r["doc_id"], [s["kind"] for s in r["pii"]]) for r in found.collect() if r["pii"]] == [(None, ["email"])] and found.count() == 9
    many = spark.createDataFrame([(" ".join(f"u{k}@host.org" for k in range(3000)),)], "text string")
    row = pii.find_pii(many).first()
    assert len(row["pii"]) == 3000 and all(row["text"][s["start"] : s["end"]] == s["text"] for s in row["pii"])
    assert pii.redact(pii.find_pii(many)).first()["text"] == " ".join(["<EMAIL>"] * 3000)


def test_chats(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", f"turn {k} </s>", "x", "x", 0) for k in range(3000)] + [(2, 0, "user", "a", "x", "x", 0)] * 2
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, body string, turns string, loss int").repartition(4)
    got = {r["conv_id"]: r for r in chat.format_chats(turns, chat.text_part(F.col("text"))).collect()}
    assert chat.parse(got[1]["formatted"]) == [(r[2], r[3]) for r in rows[:3000]]
    assert chat.under_mask(got[1]["formatted"], got[1]["loss_spans"]) == "".join(r[3] for r in rows[1:3000:2])
    assert chat.parse(got[2]["formatted"]) == [("user", "a")] * 2


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline(spark, tmp_path, empty):
    table(spark, empty).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no such item in here at all, not one")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
    got = pairs(docs, "doc_id", "text")
    if empty:
        assert got == []
    else:
        assert {k for k, _ in got} <= {None, 1, 5, 6} and (None, "an id is missing, mail <EMAIL>") in got and np.all([t != LONG or k == 5 for k, t in got])
