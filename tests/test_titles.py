"""Title links against the plain predicate on every pair."""

import random

from pyspark.sql import functions as F

from foliosmith.functions import citations as C
from foliosmith.operators import titles


def brute(docs):
    a, b = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), docs.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    rows = a.crossJoin(b).select("a", "b", C.titles_match(F.col("ta"), F.col("tb")).alias("m"), (C.normalize_title(F.col("ta")) == C.normalize_title(F.col("tb"))).alias("same")).collect()
    first = {x: min(r["b"] for r in rows if r["a"] == x and r["same"]) for x in {r["a"] for r in rows}}
    return {(x, f, "class") for x, f in first.items()} | {(r["a"], r["b"], "match") for r in rows if r["m"] and not r["same"] and first[r["a"]] == r["a"] and first[r["b"]] == r["b"]}


def texts():
    rng, words = random.Random(5), [f"{a}{b}" for a in "bcdfghklm" for b in ("alpha", "omega", "er", "on")]
    made = ["Deep Nets for All", "deep nets, for ALL!", "DEEP nets for all.", "", None, "Short", "short!", "12345", "one one one one one one two", "one two", "one two three four five six seven"]
    for _ in range(60):
        base = [rng.choice(words[:rng.choice([6, 12, 36])]) for _ in range(rng.randint(2, 30))]
        made.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            for _ in range(rng.randint(1, max(1, len(near) // 3))):
                near[rng.randrange(min(4, len(near))) if rng.random() < 0.5 else rng.randrange(len(near))] = rng.choice(words)
            made.append(" ".join(near).title() + rng.choice(["", ".", " 7"]))
    return made


def test_links_are_all_matches(spark):
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string").cache()
    want = brute(docs)
    directed = {(a, b) for a, b, link in want if link == "match"}
    assert any((b, a) not in directed for a, b in directed) and any((b, a) in directed for a, b in directed)
    assert len([1 for a, b, link in want if link == "class" and a != b]) >= 4
    for least in (1, 3):
        got = [tuple(r) for r in titles.title_links(docs, least_blocks=least).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_title_links_is_registered_and_whole(spark, tmp_path):
    docs = spark.createDataFrame([(1, "An early word differs in this title"), (2, "The early word differs in this title"), (3, "the EARLY word differs in this title!")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    import __spark_entry__ as entry

    got = {tuple(r) for r in entry.queries()["title_links"](spark, str(tmp_path)).collect()}
    assert got == {(1, 1, "class"), (2, 2, "class"), (3, 2, "class"), (1, 2, "match"), (2, 1, "match")}
