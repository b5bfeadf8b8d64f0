"""Importance resampling against plain code, for longer runs of words and small chunks too."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from foliosmith.llm import importance

SCHEMA = "doc_id long, text string, row string, total string, n_words string, score string, buckets string, rank string, __at string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 7) for r in rows], SCHEMA).repartition(3)


def runs(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def plainly(rows, target, longest, size, least, percent):
    bucket = lambda run: zlib.crc32(run.encode()) % size
    counted = [(key, runs(text, longest)[0], collections.Counter(map(bucket, runs(text, longest)[1]))) for key, text in rows]
    s, t = sum((c for *_, c in counted), collections.Counter()), collections.Counter(bucket(x) for text in target for x in runs(text, longest)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + size) / ((s[b] + 1) * (t.total() + size)))) for b in range(size)]
    out = []
    for key, words, c in counted:
        weight = sum(gain[b] * n for b, n in c.items()) // c.total() if c else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append((key, c.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words))
    order = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], (x[0] is not None, x[0])))
    drawn = collections.defaultdict(list)
    for rank, x in enumerate(order[: len(order) * percent // 100], 1):
        drawn[x[:4]].append(rank)
    return sorted(((*x[:4], drawn[x[:4]].pop() if drawn[x[:4]] else None) for x in out), key=str)


def random_rows(seed, n=90):
    rng = np.random.default_rng(seed)
    vocabulary = ["a", "Bee", "bee", "é", "ÉA", "tide", "日本", "wind", "x9", "10"]
    made = [(int(k), rng.choice([" ", "\n", ", ", "_"]).join(rng.choice(vocabulary, rng.integers(0, 60)))) for k in rng.permutation(n)]
    return [*made, (500, None), (501, ""), (502, "!? _"), (None, "tide " * 30), (503, "wind bee " * 40), (503, "wind bee " * 40)]


@pytest.mark.parametrize("longest, chunk, size", [(1, 1 << 20, 100), (2, 1 << 20, 1000), (3, 60, 50)])
def test_against_plain_code(spark, monkeypatch, longest, chunk, size):
    rows, target = random_rows(longest), ["tide wind", None, "日本 tide tide Bee"]
    own = importance.count_buckets
    monkeypatch.setattr(importance, "count_buckets", lambda *a, **k: own(*a, **k, chunk=chunk))
    got = importance.resample(frame(spark, rows), spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string"), longest=longest, n_buckets=size, percent=30)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plainly(rows, target, longest, size, 20, 30)


def test_ranks_over_many_partitions(spark):
    rows = [(k, "tide wind bee " * 10) for k in range(3000)]
    got = importance.resample(frame(spark, rows).repartition(7), frame(spark, rows[:1]), n_buckets=64)
    drawn = sorted(((r["rank"], r["score"], r["doc_id"]) for r in got.collect() if r["rank"]))
    assert [d[0] for d in drawn] == list(range(1, 301)) and drawn == sorted(drawn, key=lambda d: (-d[1], d[2]))


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    assert importance.resample(none, none).count() == 0
    got = importance.resample(frame(spark, [(1, None), (2, "few words")]), none).collect()
    assert [(r["doc_id"], r["n_features"], r["rank"]) for r in sorted(got, key=lambda r: r["doc_id"])] == [(1, 0, None), (2, 2, None)]
