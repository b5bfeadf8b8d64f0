"""Texts that have several runs of one minimizer, rows that share an id or have none: every window that starts earlier elsewhere is found."""

import random

import pytest

from foliosmith.llm import substrings


def kept(rows, length=20):
    first, docs = {}, {k: (t or "").split() for k, t in rows}
    for k in sorted(docs):
        for at in range(len(docs[k]) - length + 1):
            first.setdefault(tuple(docs[k][at : at + length]), (k, at))
    out = {}
    for k, found in docs.items():
        gone = {p for at in range(len(found) - length + 1) if first[tuple(found[at : at + length])] < (k, at) for p in range(at, at + length)}
        out[k] = (len(found), len(gone), " ".join(w for p, w in enumerate(found) if p not in gone))
    return out


def texts(seed):
    """Short passages that recur in changing surroundings, so that a text holds a minimizer in several runs."""
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(300)]
    passages = [[rng.choice(words) for _ in range(rng.choice([6, 15, 20, 25, 40]))] for _ in range(12)]
    return [(k * 7 - 50, " ".join(w for _ in range(rng.randrange(9)) for w in (rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randrange(30))]))) for k in range(120)]


@pytest.mark.parametrize("longest,hot", [(1000, 128), (1000, 10**9), (5, 10**9)])
def test_every_run_of_a_text_is_searched(spark, monkeypatch, longest, hot):
    monkeypatch.setattr(substrings, "LONGEST", longest)
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = texts(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.deduplicate(docs).collect()} == kept(rows)


def test_rows_of_one_id_are_one_place_and_rows_without_id_lose_their_own_repeats(spark):
    once, twice = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k % 30}" for k in range(60))
    rows = [(1, once), (1, once), (2, once), (None, twice), (None, once)]
    for parts in (1, 4):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((str(r["doc_id"]), r["n_removed"], r["kept"]) for r in substrings.deduplicate(docs).collect())
        assert got == sorted([("1", 0, once), ("1", 0, once), ("2", 60, ""), ("None", 0, once), ("None", 30, " ".join(twice.split()[:30]))])
