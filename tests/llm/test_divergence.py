"""Source divergence against plain sums over all terms, and its edge cases."""

import collections
import re

import numpy as np
import pytest

from foliosmith.llm import divergence
from foliosmith.llm.words import cut_points

SCHEMA = "doc_id long, lang string, source string, text string, term string, n long, p long, item string, rank int, value string, zero string"


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, "x", 1, 1, "x", 1, "x", "x") for k, r in enumerate(rows)], SCHEMA).repartition(3)


def plainly(rows, least, smooth=5, scale=10**9, top=50):
    rows = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        held = collections.Counter(t for _, _, words in own for t in set(words))
        kept = sorted((t for t, n in held.items() if n >= least), key=str.encode)
        counts = {s: collections.Counter(t for _, s2, words in own if s2 == s for t in words if t in set(kept)) for s in {r[1] for r in own}}
        everything = sum(counts.values(), collections.Counter())
        price = lambda c, t: 1 + scale * (c[t] + smooth) // (sum(c.values()) + smooth * len(kept))
        for s, c in counts.items():
            pairs = [(o, sum(abs(price(c, t) - price(d, t)) for t in kept)) for o, d in counts.items() if o != s]
            terms = [(t, price(c, t) - price(everything, t)) for t in kept if c[t] and price(c, t) > price(everything, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (item, value) in enumerate(sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


def random_rows(seed, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "Bee", "bee", "é", "ÉA", "tide", "日本", "wind", "xx", "q"]
    pick = lambda values: values[rng.integers(len(values))]
    return [(pick(["en", "de", None, ""]), pick(["s1", "s2", "s3", None, "ß"]), pick([None, "", "12 !?"]) if rng.random() < 0.1 else pick([" ", "\n", "1", ", "]).join(pick(vocabulary[: 3 + k % 8]) for _ in range(rng.integers(1, 30)))) for k in range(n)]


@pytest.mark.parametrize("seed, least, chunk", [(1, 1, 1 << 20), (2, 6, 64), (3, 500, 64)])
def test_against_plain_sums(spark, monkeypatch, seed, least, chunk):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    rows = random_rows(seed)
    got = divergence.audit(frame(spark, rows), least_docs=least)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == plainly(rows, least)


def test_long_texts_are_counted_in_slices(spark):
    rows = [("en", "s", "tide wind " * 5000 + "é" * 3000), ("en", "t", "x" * 9000), ("en", "t", "tide")]
    got = {(r["source"], r["term"]): (r["n"], r["docs"]) for r in divergence.count_terms(frame(spark, rows).select("lang", "source", "text").coalesce(1), chunk=1000).collect() if r["term"]}
    assert got == {("s", "tide"): (5000, 1), ("s", "wind"): (5000, 1), ("s", "é" * 3000): (1, 1), ("t", "x" * 9000): (1, 1), ("t", "tide"): (1, 1)}


def test_counts_that_overflow_products(spark):
    made = spark.createDataFrame([(9_000_000_000_000_000, 9_000_000_000_000_100, 3)], "n long, total long, kept long").select(divergence.price("n", "total", "kept", 5, 10**9).alias("p"))
    assert made.first()["p"] == 1 + 10**9 * (9_000_000_000_000_000 + 5) // (9_000_000_000_000_100 + 15)


def test_groups_without_terms_and_empty_tables(spark):
    assert divergence.audit(frame(spark, [])).count() == 0
    got = [tuple(r) for r in divergence.audit(frame(spark, [("en", "a", None), ("en", "b", "")])).collect()]
    assert sorted(got) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_cut_points():
    solid = np.array([1, 1, 0, 1, 1, 1, 1, 1, 0, 1], bool)
    assert cut_points(solid, 4) == [3, 9, 10] and cut_points(solid, 100) == [10] and cut_points(np.ones(9, bool), 4) == [9] and cut_points(np.zeros(0, bool), 4) == [0]
