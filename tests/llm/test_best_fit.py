"""Best-fit packing: ids against the full tokenizer, plans that place each piece once, and few sequences."""

import collections
import os
import zlib

import numpy as np
import pytest

from foliosmith.llm import bestfit, queries
from foliosmith.llm.bytepairs import BytePairs

DATA = "/root/testdata/sf0.001"
BYTES = queries.public_vocabulary("byte_bpe_50k.json")
WORDS = queries.public_vocabulary("word_bpe_49k.json")

TEXTS = [
    "", " ", "\n\n", "The tide  came\nin.\n\n It's 2024 — “quoted”   text　。 <|endoftext|> more <|endoftext|>", "潮汐" * 3000, "word " * 4000, "a\x00b\x1c\x85 c\t\td\r\n", "naïve café Ωμέγα привет 한국어 👍🏽 ᏸ ￼", " lead and trail  ",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("stretch", [1 << 19, 50])
def test_ids_are_those_of_the_full_tokenizer(path, stretch):
    own = BytePairs(path, stretch)
    assert (own.fast is not None) == (path == BYTES)
    for text in TEXTS:
        assert own.ids(text).tolist() == own.full.encode(text, add_special_tokens=False).ids


def sequences_of(available, rows):
    """The sequences that a plan fills; each piece must have one place, each sequence no gap."""
    keys, table = bestfit.places(rows)
    length = np.repeat(np.arange(len(available)), available)
    nth = np.concatenate([np.arange(n) for n in available])
    sequence, offset = bestfit.placed(keys, table, length, nth)
    held = collections.defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), length.tolist()):
        held[s].append((o, n))
    for spans in held.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) < len(available)
    assert sorted(held) == list(range(len(held)))
    return held


@pytest.mark.parametrize("lengths", [[], [64], [1] * 500, [40] * 30 + [24] * 10 + [12] * 30, "uniform", "short", "skewed"])
def test_plans(lengths):
    rng = np.random.default_rng(7)
    made = {"uniform": lambda: rng.integers(1, 65, 4000), "short": lambda: rng.integers(1, 9, 3000), "skewed": lambda: np.minimum(64, rng.geometric(0.06, 5000))}
    lengths = np.array(made[lengths]() if isinstance(lengths, str) else lengths, dtype=int)
    available = np.bincount(lengths, minlength=65)
    rows = bestfit.plan(available)
    held = sequences_of(available, rows)
    least = -(-int(lengths.sum()) // 64)
    assert len(held) <= sum(n for n, _ in bestfit._best_fit(available))  # plain best-fit, longest first
    assert len(held) <= least + 0.02 * least + 1 or len(lengths) == 70


def test_complements_fill_gaps_exactly():
    available = np.zeros(101, int)
    available[[70, 30, 60, 25, 15, 50, 20, 18, 12]] = 1
    rows = bestfit.plan(available)
    filled = collections.defaultdict(list)
    for r in rows:
        filled[r.sequence].append(r.length)
    assert sorted(sorted(x) for x in filled.values()) == [[12, 18, 20, 50], [15, 25, 60], [30, 70]]


def test_a_plan_does_not_grow_with_the_pieces():
    rng = np.random.default_rng(3)
    available = np.concatenate([[0], rng.integers(1, 10**9, 512)])
    rows = bestfit.plan(available)
    assert len(rows) < 10 * 512 and sum(r.each * r.sequences for r in rows) == available.sum()


SCHEMA = "doc_id long, text string, piece string, part string, length string, ids string, nth string, __part string, sequence_id string"


def test_pieces(spark):
    texts = [(1, "tide " * 300), (1, "tide " * 300), (2, None), (None, "no id"), (3, ""), (4, "潮汐" * 400), (5, TEXTS[3])]
    docs = spark.createDataFrame([(*t, *["x"] * 7) for t in texts], SCHEMA).repartition(3)
    got = bestfit.pack(docs, BYTES, size=64)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    rows = got.collect()
    own = BytePairs(BYTES)
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for spans in held.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist() and sum(n for _, n in spans) <= 64
    for key, text in dict(texts).items():
        want = [*own.ids(text or "").tolist(), 0]
        found = sorted((r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in rows if r["doc_id"] == key)
        if key == 1:
            found = found[::2]
        assert np.frombuffer(b"".join(f[3] for f in found), "<u4").tolist() == want
        assert [f[1] for f in found] == np.cumsum([0, *(f[2] for f in found)])[:-1].tolist() and [f[0] for f in found] == list(range(len(found)))
        assert all(f[2] == 64 for f in found[1:]) and len(found) == -(-len(want) // 64)
    assert bestfit.pack(docs.limit(0), BYTES).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query(spark):
    from tokenizers import Tokenizer

    full, got = Tokenizer.from_file(BYTES), collections.defaultdict(list)
    rows = queries.op12_best_fit_packing(spark, DATA).collect()
    for r in rows:
        got[r["doc_id"]].append(r)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    assert set(got) == set(texts)
    total = 0
    for key, text in texts.items():
        ids = np.array([*full.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        pieces, at = sorted(got[key], key=lambda r: r["piece"]), 0
        for k, r in enumerate(pieces):
            assert (r["piece"], r["start"]) == (k, at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes()) and (k == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids) and len(pieces) == -(-len(ids) // 2048)
    ends = collections.Counter()
    for r in rows:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048 and len(ends) <= 1.02 * -(-total // 2048) + 1
