"""Operators whose registered queries take the beginning of a text, on whole texts."""

from foliosmith.plans import queries


def test_whole_texts_are_seen(spark, tmp_path):
    long = "First line\n\n" + "word " * 2000 + "\nlast line"
    spark.createDataFrame([(1, long, "s", "en"), (2, long, "s", "en"), (3, long, "s", "en")], "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["whole_texts"](spark, str(tmp_path)).collect()}
    assert [got[k]["description_chars"] for k in (1, 2, 3)] == [len(long), len(long), len("ok ") + len(long)]
    assert all(r["base_chars"] >= 10000 and r["bibtex_chars"] > len(long) for r in got.values())
