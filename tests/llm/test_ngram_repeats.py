"""Repeated rows of an id in the n-gram join: one posting a group, one set a class, the same components."""

import random

from pyspark.sql import functions as F

from foliosmith.llm import ngramjoin
from foliosmith.llm.storage import written

OPTIONS = {"n": 3, "percent": 90, "longest": 8, "block": 4}


def texts():
    rng = random.Random(4)
    made = []
    for _ in range(12):
        base = [f"w{rng.randrange(400)}" for _ in range(80)]
        for _ in range(rng.randint(1, 4)):
            near = list(base)
            near[rng.choice((0, 79))] = f"changed{rng.randrange(9)}"
            made.append(" ".join(near))
    return [*enumerate(made), (900, ""), (901, None), (902, "one")]


def brute(rows):
    sets = {}
    for k, t in rows:
        words = (t or "").lower().split()
        sets[k] = {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    root = {k: k for k in sets}

    def find(k):
        return k if root[k] == k else find(root[k])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in sets}


def test_repeated_rows_are_one(spark):
    rows = texts()
    hot = {0: 200, 1: 200, 2: 30, 901: 5, 902: 3}
    many = [r for r in rows for _ in range(hot.get(r[0], 1))]
    docs = spark.createDataFrame(many, "doc_id long, text string").repartition(5)
    want = brute(rows)
    got = ngramjoin.components(docs, **OPTIONS).collect()
    assert len(got) == len(many) and {(r["doc_id"], (r["n_shingles"], r["component_id"])) for r in got} == set(want.items())
    assert any(c != k for k, (_, c) in want.items())


def test_one_set_a_class_and_one_posting_a_group(spark):
    docs = spark.createDataFrame([(k, "a b c d e f g h i j k l m n o " + x) for k, x in ((1, "p q"), (2, "p r")) for _ in range(20)], "doc_id long, text string").repartition(3)
    wanted = written(docs.select(F.col("doc_id").alias("class_id")).distinct(), "wanted")
    assert ngramjoin.sets_of(docs, wanted, 3, "doc_id", "text").count() == 2
    postings = spark.createDataFrame([(s, g, 4 << 32) for s in (7, 8, 9) for g in (1, 2) for _ in range(200)] + [(5, 1, 4 << 32)] * 300, "shingle long, group_id long, info long").repartition(3)
    lists = ngramjoin.shingle_lists(postings, 8).collect()
    assert sorted((r["shingle"], r["group_id"], r["long"]) for r in lists) == [(s, g, False) for s in (7, 8, 9) for g in (1, 2)]
