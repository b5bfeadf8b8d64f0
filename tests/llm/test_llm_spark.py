"""Training-data operators on small tables with nulls, ties, repeats, empty tables and clashing columns, against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliosmith.llm import capfilters, chat, decontam, langid, licences, ngramjoin, packing, pii, substrings
from foliosmith.llm.queries import public_vocabulary

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(400)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(25, 120))) for _ in range(n)]
    for k in range(0, n, 6):  # near copies, exact copies, shared passages
        changed = texts[k].split()
        changed[len(changed) // 2] = "zzz"
        texts += [" ".join(changed), texts[k], texts[k + 1] + " " + " ".join(texts[k].split()[:22]), texts[k].upper()]
    texts += [None, "", "  ", "one", "one two", "same " * 60, "same " * 30, " ".join(vocabulary * 3)]
    rng.shuffle(texts)
    return [(k, t, "en" if k % 2 else None, "s", len(t or "")) for k, t in enumerate(texts)]


def frame(spark, rows, extra=True):
    made = spark.createDataFrame(rows, DOC).repartition(3)
    return made.withColumns({"score": F.lit(1), "digest": F.lit("x"), "prefix": F.lit(2), "start": F.lit(3)}) if extra else made


def brute_windows(rows, length=20):
    seen, out = set(), {}
    for k, text, *_ in sorted(rows, key=lambda r: r[0]):
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for at in range(len(found) - length + 1):
            window = tuple(found[at : at + length])
            if window in seen:
                gone.update(range(at, at + length))
            seen.add(window)
        out[k] = (len(found), len(gone), " ".join(w for i, w in enumerate(found) if i not in gone))
    return out


@pytest.mark.parametrize("longest,shard,hot", [(1000, 150_000, 128), (1, 40, 2)])
def test_substrings(spark, monkeypatch, longest, shard, hot):
    monkeypatch.setattr(substrings, "LONGEST", longest)
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = corpus()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.deduplicate(frame(spark, rows), shard=shard).collect()}
    assert got == brute_windows(rows)


def brute_components(rows, n, percent):
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for k, text, *_ in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
        sets[k] = {tuple(found[i : i + n]) for i in range(max(1, len(found) - n + 1))} if found else set()
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize("options", [{}, {"longest": 2, "block": 2, "hot": 2}])
@pytest.mark.parametrize("n,percent", [(3, 90), (5, 80)])
def test_ngram_join(spark, options, n, percent):
    rows = corpus(2, 40)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngramjoin.components(frame(spark, rows), n=n, percent=percent, **options).collect()}
    assert got == brute_components(rows, n, percent)


def test_empty_tables(spark):
    none = frame(spark, [])
    assert substrings.deduplicate(none).count() == 0
    assert ngramjoin.keep_one(none).count() == 0
    assert packing.pack(none, public_vocabulary()).count() == 0
    assert pii.find_pii(none).count() == 0
    assert langid.predict(none, langid.fit(none, F.lit(True))).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(frame(spark, corpus(3, 6)), items).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert capfilters.near_duplicates(vectors).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), chat.text_part(F.col("text"))).count() == 0


def test_null_ids_stay(spark):
    rows = [(None, "a b c d e f g", "en", "s", 1), (1, "a b c d e f g", "en", "s", 1), (2, "a b c d e f g", "en", "s", 1)]
    assert {r["doc_id"] for r in ngramjoin.keep_one(frame(spark, rows)).collect()} == {None, 1}
    assert substrings.deduplicate(frame(spark, rows)).count() == 3


def test_vectors(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 16))
    rows = [(k, [float(x) for x in base[k % 30] + rng.normal(size=16) * (0.08 if k >= 30 else 0)], k % 30 % 2) for k in range(90)]
    rows += [(100, rows[0][1], 0), (101, rows[0][1], 1), (102, rows[0][1], None), (103, None, 0), (104, [0.0] * 16, 0), (105, [float("nan")] * 16, 0), (106, [None] * 16, 0), (107, [], 0)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in capfilters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), cell=3).collect()}
    good = {k: np.array(v) / np.linalg.norm(v) for k, v, label in rows if v and label is not None and None not in v and np.isfinite(v).all() and any(v)}
    label = {k: x for k, _, x in rows}
    links = {k: [j for j in good if j != k and label[j] == label[k] and good[j] @ good[k] >= 0.93] for k in good}
    for k, _, _ in rows:
        near, todo = {k}, [k]
        while todo:
            for j in links.get(todo.pop(), []):
                if j not in near:
                    near.add(j)
                    todo.append(j)
        assert got[k] == (len(links.get(k, [])), min(near), min(near) == k)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def good(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        if kind == "ip":
            return all(int(p) <= 255 for p in hit.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0
        return kind != "phone" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def test_pii(spark):
    rng = random.Random(3)
    signs = ["1", "2", "4", "0", "9", ".", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "_", "😀", "é", "255", "4111 1111 1111 1111", "a@b.c", "1.2.3.4", "\n"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(800)] + ["1" * 20000, "1 " * 9000, "a" * 20000, "a@" * 3000, "a@b.c_x@y.z", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for r in pii.find_pii(docs).collect():
        got = [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in BASE]
        assert got == base_spans(texts[r["doc_id"]])
    told = pii.redact(pii.find_pii(spark.createDataFrame([("😀 mail a@b.co, GB82 WEST 1234 5698 7654 32!",), (None,)], "text string"))).collect()
    assert [r["text"] for r in told] == ["😀 mail <EMAIL>, <IBAN>!", None]


def test_packing_round_trip(spark):
    rows = corpus(4, 30)
    own = packing.WordTokenizer(public_vocabulary())
    pieces = packing.pack(frame(spark, rows), public_vocabulary(), size=128, max_open=4).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append((p["start"], bytes(p["ids"])))
        by_sequence.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for k, text, *_ in rows:
        assert b"".join(x for _, x in sorted(by_doc[k])) == own.ids(text or "") + (2).to_bytes(4, "little")
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at == 128 or at & (at - 1) == 0


def test_chat_order_and_mask(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a</s>"), (1, 1, "assistant", "b"), (1, None, None, None), (None, 0, "assistant", "x")]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chat.text_part(F.col("text"))).collect()}
    assert chat.parse(got[1]["formatted"]) == [("", ""), ("user", "a</s>"), ("assistant", "b"), ("assistant", "b")]
    assert chat.under_mask(got[1]["formatted"], got[1]["loss_spans"]) == "bb" and None in got


def test_decontamination_blocks(spark):
    rows = corpus(5, 12)
    items = [(k, " ".join(rows[k][1].split()[3:18])) for k in range(12) if rows[k][1] and len(rows[k][1].split()) > 20] + [(99, None), (98, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {tuple(r)[:3] for r in decontam.contaminated(frame(spark, rows), benchmark, block_chars=60).collect()}
    matcher = decontam.Matcher([i for i in items if i[1]])
    assert got == {(k, item, edits) for k, text, *_ in rows for item, edits, _, _ in matcher.search(text)} and got


def test_licences_in_spark(spark):
    docs = spark.createDataFrame([(1, "Text.\nReleased under the MIT License."), (2, None), (3, "")], "doc_id long, text string")
    assert [(r["doc_id"], r["family"]) for r in licences.scan(docs, licences.fit(docs)).collect()] == [(1, "mit")]


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(6)
    rows = [(k, " ".join(rng.choice(["the", "and", "of", "house", "river", "green", "old", "tree", "stone", "bird", f"w{k}"]) for _ in range(60)), "en" if k % 2 else "de", "s", 1) for k in range(30)]
    rows += [(100, rows[0][1], "en", "s", 1), (101, None, "en", "s", 1), (102, "123 !", None, "s", 1), (103, rows[1][1] + " mail me@example.com now", "en", "s", 1), (104, " ".join(f"item{k}" for k in range(20)), "en", "s", 1)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(f"item{k}" for k in range(20)))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {101, 102}.isdisjoint(kept["language_id"]) and len(kept["language_id"]) == len(rows) - 2
    assert {r for r in kept["language_id"]} - set(kept["ngram_join"]) >= {100}
    assert set(kept["ngram_join"]) - set(kept["decontamination"]) == {104}
    assert not any("@" in t for t in kept["pii"].values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept["pii"])


