"""The registered queries over the smallest tables: against their SQL, or against the contract in plain code."""

import os
import zlib

import numpy as np
import pytest

from foliosmith.llm import langid, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def rows(spark, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, DATA).collect()]


@pytest.fixture(scope="module")
def duck():
    import duckdb

    found = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "pages", "benchmark"):
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_give_the_rows_of_their_sql(spark, duck, name):
    got = rows(spark, name)
    want = duck.execute(queries.ORACLE_SQL[name]).fetchall()
    names = [c[0] for c in duck.description]
    assert set(names) == set(got[0]) and len(got) == len(want)
    assert sorted(str([r[n] for n in names]) for r in got) == sorted(str(list(r)) for r in want)


def test_packing(spark, duck):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(queries.public_vocabulary())
    ids = {k: [*full.encode(t or "", add_special_tokens=False).ids, 2] for k, t in duck.execute("SELECT doc_id, text FROM documents").fetchall()}
    got, at, sequences = rows(spark, "op4_packing"), {}, {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        k, lo, n = r["doc_id"], r["start"], r["length"]
        assert lo == at.get(k, 0) and r["doc_tokens"] == len(ids[k]) and n > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[k][lo : lo + n], "<u4").tobytes())
        at[k] = lo + n
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], n))
    assert at == {k: len(v) for k, v in ids.items()}
    for spans in sequences.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist()
        total = sum(n for _, n in spans)
        assert total == 4096 or total & (total - 1) == 0


def test_language(spark, duck):
    truth = dict(duck.execute("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
    texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
    got = rows(spark, "op5_language_id")
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and (r["lang_pred"] == "und") == (not langid.has_letter(texts[r["doc_id"]]))
    seen = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth and r["lang_pred"] != "und"]
    assert len(seen) > 20 and np.mean(seen) >= 0.9


def test_pages(spark, duck):
    pages = {r[0]: r[1] for r in duck.execute("SELECT page_id, url FROM pages").fetchall()}
    got = rows(spark, "op7_html_extraction")
    assert {r["page_id"]: r["url"] for r in got} == pages and len(got) == len(pages)
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in got)


def test_licences(spark, duck):
    """Each line that says so is found, in its place, and little else."""
    named = {"Licensed under the Apache License": "apache-2.0", "Released under the MIT License": "mit", "GNU General Public License, version 3": "gpl-3.0", "CC BY-NC 4.0": "cc-by-nc"}
    texts = dict(duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall())
    got = rows(spark, "op1_license_scan")
    want = {(k, family) for k, t in texts.items() for sign, family in named.items() if sign in t}
    found = {(r["doc_id"], r["family"]) for r in got}
    assert want and want <= found and len(found - want) <= 0.02 * len(texts) + sum("rights reserved" in t for t in texts.values())
    for r in got:
        assert 0.6 <= r["probability"] <= 1 and 0 <= r["start"] < r["end"] <= len(texts[r["doc_id"]])
        assert any(s in texts[r["doc_id"]][max(0, r["start"] - 40) : r["end"] + 40] for s in ("icense", "CC BY", "rights reserved"))


def test_decontamination(spark, duck):
    """Whole items in a text are found with no edits, at their place."""
    texts = dict(duck.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall())
    items = dict(duck.execute("SELECT item_id, text FROM benchmark").fetchall())
    got = {(r["doc_id"], r["item_id"]): r for r in rows(spark, "op2_decontamination")}
    fold = lambda t: " ".join(t.lower().split())
    folded = {k: fold(t) for k, t in texts.items()}
    for item, text in items.items():
        for k, t in folded.items():
            if fold(text) in t:
                r = got[k, item]
                assert r["edits"] == 0 and fold(texts[k][r["start"] : r["end"]]) == fold(text)
    assert got and all(r["edits"] <= 0.08 * len(fold(items[i])) for (_, i), r in got.items())
