"""Title links by blocks of sizes: blocks hold about as many words, sizes that can't match aren't met, shared hash buckets change no result."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from foliosmith.operators import titles


def lists_of(rows):
    found = [np.unique(np.array(r, np.int64), return_counts=True) for r in rows]
    return pa.array([w for w, _ in found], pa.list_(pa.int64())), pa.array([c.astype(np.int32) for _, c in found], pa.list_(pa.int32()))


def test_blocks_hold_as_many_words_and_few_sizes(spark):
    rng = random.Random(2)
    rows = [(k, list(range(int(2 ** rng.uniform(2, 9))))) for k in range(2000)]
    lists = spark.createDataFrame(rows, "id long, words array<long>")
    dealt = titles._dealt(lists, 8).groupBy("block").agg(F.sum(F.size("words")).alias("w"), F.min(F.size("words")).alias("lo"), F.max(F.size("words")).alias("hi")).orderBy("block").collect()
    assert [r["block"] for r in dealt] == list(range(8)) and max(r["w"] for r in dealt) < 1.3 * min(r["w"] for r in dealt)
    assert all(after["lo"] >= before["hi"] / 1.1 for before, after in zip(dealt, dealt[1:]))
    one = titles._dealt(lists.filter("size(words) = 40").unionByName(spark.range(400).select("id", F.sequence(F.lit(1), F.lit(40)).cast("array<bigint>").alias("words"))), 4)
    assert {r["block"] for r in one.select("block").distinct().collect()} == {0, 1, 2, 3}
    assert titles._dealt(lists.limit(0), 4).count() == 0


def test_sizes_that_cannot_match_are_not_met(monkeypatch):
    words, counts = lists_of([range(k, k + 10) for k in range(20)] + [range(k, k + 400) for k in range(20)])
    table = pa.table({"id": pa.array(range(40)), "block": pa.array([0] * 20 + [1] * 20), "words": words, "counts": counts})
    monkeypatch.setattr(titles.np, "bitwise_count", lambda *_: 1 / 0)
    assert list(titles._pairs(table, False)) == []


def test_shared_buckets_change_nothing(monkeypatch):
    rng = random.Random(4)
    rows = []
    for _ in range(60):
        base = [rng.randrange(-300, 300) for _ in range(rng.randint(2, 60))]
        rows += [base, base[: len(base) * 7 // 8] + [rng.randrange(300)], base + base[:1] * rng.randint(0, 9)]
    words, counts = lists_of(rows)
    table = pa.table({"id": pa.array(range(len(rows))), "block": pa.array([k % 2 for k in range(len(rows))]), "words": words, "counts": counts})
    match = lambda a, b: 4 * sum(w in set(b) for w in a) > 3 * max(len(a), len(set(b)))
    want = {(x, y) for x, a in enumerate(rows) for y, b in enumerate(rows) if x % 2 != y % 2 and match(a, b)}
    for buckets in (1 << 20, 32, 2):
        monkeypatch.setattr(titles, "BUCKETS", buckets)
        got = [p for t in titles._pairs(table, False) for p in zip(t["a"].to_pylist(), t["b"].to_pylist())]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 60
