"""Kernels of the training-data operators against brute force, without Spark."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from foliosmith.llm import capfilters, chat, decontam, htmltext, langid, licences, ngramjoin, packing, pii, substrings, words
from foliosmith.llm.fmindex import FMIndex
from foliosmith.llm.queries import public_vocabulary

TEXTS = ["", None, "one", " two  words ", "é ü\tß\nx", "a\x0bb\x0cc", "the same the same", "x" * 3000 + " y"]


def test_words_and_hashes():
    column = pa.array(TEXTS)
    for limit in (1, 10, 1 << 18):
        got, seen = [], {}
        for chunk in words.word_chunks(column, limit=limit):
            hashes = words.word_hashes(chunk)
            for lo, hi in zip(chunk.first, chunk.first[1:]):
                found = [bytes(chunk.data[a:b]).decode() for a, b in zip(chunk.starts[lo:hi], chunk.ends[lo:hi])]
                got.append(found)
                for w, h in zip(found, hashes[lo:hi]):
                    assert seen.setdefault(w, h) == h
        assert got == [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
        assert len(set(seen.values())) == len(seen)


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 5, rng.integers(3, 30)) for _ in range(20)]
    index = FMIndex(texts)
    ends = np.flatnonzero(index.text)
    for length in (2, 4):
        ok = np.array([e for e in ends if e - length + 1 >= 0 and (index.text[e - length + 1 : e + 1] > 0).all()])
        at, low, high = index.repeated(ok, length)
        counts = dict(zip(ok[at].tolist(), (high - low).tolist()))
        spots: dict = {}
        for e in ok.tolist():
            spots.setdefault(tuple(index.text[e - length + 1 : e + 1]), []).append(e)
        want = {e: len(v) for v in spots.values() if len(v) > 1 for e in v}
        assert counts == want


def test_myers_and_matcher():
    rng = random.Random(2)
    for _ in range(300):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randrange(24, 36)))
        text = list("".join(rng.choice("abc") for _ in range(50)))
        if rng.random() < 0.7:
            planted = list(pattern)
            for _ in range(rng.randrange(4)):
                planted[rng.randrange(len(planted))] = rng.choice("abcx")
            text[15:15] = planted
        text = "".join(text)
        row = [0] * (len(text) + 1)
        for i, c in enumerate(pattern, 1):
            new = [i]
            for j, e in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        end = min(range(len(row)), key=lambda j: (row[j], j))
        got = decontam.Matcher([(1, pattern)], 0.1).search(text)
        assert (got and (got[0][1], got[0][3]) == (row[end], end)) if row[end] <= int(0.1 * len(pattern)) else not got


def test_matcher_edge_cases():
    matcher = decontam.Matcher([(1, ""), (2, "short item"), (3, "  A longer item, Of more\nthan a few words ")])
    assert matcher.search(None) == matcher.search("") == matcher.search("shorty items") == []
    assert matcher.search("x short  ITEM y")[0][:2] == (2, 0)
    assert matcher.search("so a longer item, of more than a few words")[0][:2] == (3, 0)
    assert decontam.Matcher([]).search("x") == []


def test_packer_places_every_id_once():
    rng = random.Random(3)
    packer, out, sizes = packing.Packer(64, max_open=5), [], {}
    for document in range(300):
        ids = np.array([document * 1000 + k for k in range(rng.choice([1, 5, 33, 40, 63, 64, 65, 200]))], dtype="<u4").tobytes()
        sizes[document] = ids
        out += packer.add(document, ids)
    out += packer.finish()
    filled: dict = {}
    for document, start, ids, sequence, offset in out:
        assert sizes[document][4 * start : 4 * start + len(ids)] == ids
        assert filled.get(sequence, 0) == offset
        filled[sequence] = offset + len(ids) // 4
    assert sum(len(x[2]) for x in out) == sum(map(len, sizes.values()))
    assert all(n == 64 or n & (n - 1) == 0 for n in filled.values())
    assert sum(n != 64 for n in filled.values()) <= 6


def test_tokenizer_equals_library():
    public = pytest.importorskip("public_tokenizers")
    own = packing.WordTokenizer(public.path("word_bpe_49k.json"), limit=20)
    for text in ["", "Hello<|endoftext|>x 's don't a_b", "Ünïcödé ΟΔΟΣ 日本語 é ½ x² \x1c z", "it's I'LL 12a3 €5 a\xa0b ÷×ªº ß ẞ", "x " * 50 + "Été, çà!"]:
        assert own.ids(text) == np.array(own.full.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_chat_escapes_come_back():
    rng = random.Random(4)
    signs = ["<", "s>", "/s>", "\\", "[", "INST]", "/INST]", "|im_end|>", "|im_start|>", "\n", "|image_1|>", "<SYS>>", "x"]
    for _ in range(5000):
        text, role = ("".join(rng.choice(signs) for _ in range(rng.randrange(8))) for _ in range(2))
        formatted = chat.OPEN + chat.escape_role(role) + "\n" + chat.escape(text) + chat.CLOSE
        assert chat.parse(formatted) == [(role, text)]


def test_chat_parts():
    body, attached = chat.flatten([{"type": "text", "text": "a <"}, {"type": "text", "text": "s>"}, {"type": "image", "ref": "i.png", "amount": 7840.0}, {"type": "audio", "ref": "a.wav", "amount": 2.0}, None, {"type": "new", "ref": "z"}])
    assert body == "a <\\s><|image_1|><|audio_2|><|attachment_3|>"
    assert [(a["kind"], a["tokens"]) for a in attached] == [("image", 10), ("audio", 50), ("attachment", 1)]
    assert chat.flatten(None) == ("", [])
    assert chat.parts_from_json('[{"type": "image", "ref": "x"}]')[0]["ref"] == "x"


PAGE = """<html><body><div id="hd" class="header"><h1>Site</h1></div><ul class=menu><li><a href=x>Home</a><li><a href=y>Two</a></ul>
<div class="wrap has-sidebar"><div id=content><h1>Title &amp; more</h1><div class=sec><p>One long para with text that goes on and on.<p>Another<br>text</div>
<div class=sec><p>Section two para text which is long as well, really.</p><p>Short.</p></div></div><div class="sidebar"><p>Popular posts and long text here of many words</p></div></div>
<div id=comments><p>Nice article! I love it so much that I write a long comment</div><div class="cookie-notice">We use cookies</div><form><label>Mail</label></form><footer>c</footer></body>"""


def test_html():
    assert htmltext.main_text(PAGE) == "Title & more\nOne long para with text that goes on and on.\nAnother text\nSection two para text which is long as well, really.\nShort."
    assert htmltext.main_text("<nav><a>x y z</a></nav><article><h1>A</h1><p>b &lt; c<p>d<script>1<2</script></article><aside>no</aside>") == "A\nb < c\nd"
    for empty in (None, "", "<html>", "<nav>x</nav>", "<!-- x", "<p"):
        assert htmltext.main_text(empty) == ""
    deep = "<div>" * 5000 + "<p>deep text</p>" + "</div>" * 5000
    assert htmltext.main_text(deep) == "deep text"


def test_language_network_learns():
    rng = random.Random(5)
    make = {"aa": "the and of to in", "bb": "der und die das ein"}
    sample = [(" ".join(rng.choice(v.split()) for _ in range(40)).encode()[:64], k) for k, v in make.items() for _ in range(150)]
    model = langid.train(sample, window=64, epochs=3)
    names, score = langid.predict_column(model, pa.array(["the and of the and in to", "und der die das", None, "", "12 !?", "und das " * 900]), model.tables())
    assert names == ["aa", "bb", "und", "und", "und", "bb"] and (score >= 0).all() and (score <= 1).all()


def test_network_equals_plain_convolution():
    model = langid.train([(b"abc abd", "x"), (b"xyz", "y")], window=16, epochs=1)
    codes = np.random.default_rng(0).integers(0, langid.CLASSES, (5, 16)).astype(np.uint8)
    plain = [np.max([sum(model.embed[codes[:, t + k]] @ bank[k] for k in range(width)) for t in range(16 - width + 1)], axis=0) for width, bank in zip(model.widths, model.filters)]
    assert np.allclose(np.concatenate(plain, axis=1), langid._pooled(codes, model.tables(), model.widths), atol=1e-4)


def test_licences():
    rng = random.Random(6)
    prose = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 8))) for _ in range(60)) for _ in range(80)]
    model = licences.train(prose, epochs=3)
    text = "Été prose of a page.\nReleased under the MIT License.\n" + prose[0] + " Licensed under the Apache License, Version 2.0. " + prose[1]
    found = licences.scan_column(model, pa.array([text, None, "", "The licence of the poet."]), 0.5)
    assert {(r, f) for r, f, *_ in found} == {(0, "mit"), (0, "apache-2.0")}
    assert {text[a:b] for *_, a, b in found} == {"Released under the MIT License", "Licensed under the Apache License, Version 2.0"}
    notice = licences.TEMPLATES["gpl-3.0"][0].split()
    wrapped = "A file.\n\n" + "\n".join(" ".join(notice[k : k + 5]) for k in range(0, len(notice), 5)) + "\n\nMore."
    ((_, family, sure, similarity, lo, hi),) = licences.scan_column(model, pa.array([wrapped]), 0.5)
    assert family == "gpl-3.0" and sure > 0.6 and similarity == 1 and wrapped[lo:hi].split() == " ".join(notice).rstrip(".").split()


def plain_units(text):
    """(first word, last word + 1) of the units, and the words with their code points, by the docstring."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))]
    line = [text.count("\n", 0, a) for a, _ in spans]
    units = set()
    for least in (1, 2):
        cuts = [0, *[k for k in range(1, len(spans)) if line[k] - line[k - 1] >= least], len(spans)]
        for lo, hi in zip(cuts, cuts[1:]):
            at = lo
            while lo < hi:
                units.add((at, min(at + licences.UNIT, hi)))
                if at + licences.UNIT >= hi:
                    break
                at += licences.UNIT // 2
    return spans, sorted(units)


def test_licence_scores_against_plain_code(monkeypatch):
    rng = random.Random(16)
    strange = ["".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 8))) for _ in range(200)]
    prose = [" ".join(rng.choice(strange) for _ in range(60)) for _ in range(60)]
    model = licences.train(prose, epochs=2)
    texts = []
    for _ in range(40):
        parts = [rng.choice(prose)[: rng.randrange(200)] for _ in range(3)] + [rng.choice(rng.choice(list(licences.TEMPLATES.values()))) for _ in range(2)]
        rng.shuffle(parts)
        texts.append(rng.choice(["\n", "\n\n", " "]).join(parts))
    want = []
    for row, text in enumerate(texts):
        spans, units = plain_units(text)
        hashes = licences.hashes_of(text)
        assert len(hashes) == len(spans)
        runs = {}
        for lo, hi in units:
            part = hashes[lo:hi]
            features = [f for grams in licences.grams(part) for f in grams]
            logits = (sum(model.weights[f].astype(float) for f in features) / len(features) ** 0.5 + model.bias) / model.temperature
            sure = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
            best = int(sure[:-1].argmax())
            known = set(model.runs[best].tolist())
            trigrams = [int(g) in known for g in licences.gram_hashes(part, 3)]
            matched = [k for k in range(hi - lo) if any(trigrams[j] for j in range(max(0, k - 2), min(k + 1, len(trigrams))))]
            if sure[best] < 0.6 or len(matched) < licences.RUN or len(matched) < licences.COVER * (matched[-1] - matched[0] + 1):
                continue
            found = runs.setdefault(best, [])
            first, last = lo + matched[0], lo + matched[-1] + 1
            if found and first <= found[-1][1] + licences.RUN:
                found[-1] = [min(found[-1][0], first), max(found[-1][1], last), max(found[-1][2], sure[best])]
            else:
                found.append([first, last, sure[best]])
        want += [(row, model.families[k], round(p, 3), spans[a][0], spans[b - 1][1]) for k, found in runs.items() for a, b, p in found]
    monkeypatch.setattr(licences, "_settled", lambda spans, *_: spans)
    got = [(row, family, round(p, 3), a, b) for row, family, p, _, a, b in licences.scan_column(model, pa.array(texts), 0.6)]
    assert sorted(got) == sorted(want) and len(got) > 40


def test_licence_probabilities_are_calibrated():
    rng = random.Random(17)
    strange = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(300)]
    page = lambda: " ".join(rng.choice(strange) for _ in range(20))
    model = licences.train([page() for _ in range(150)], epochs=3)
    families = list(licences.TEMPLATES)
    sure, right = [], []
    for _ in range(600):
        truth = rng.randrange(len(families) + 1)
        words = rng.choice(licences.TEMPLATES[families[truth]]).split()[:20] if truth < len(families) else page().split()
        words = [w for w in words if rng.random() > 0.1] or words
        features = np.concatenate(licences.grams(licences.hashes_of(" ".join(words))))
        p = licences._softmax((model.weights[features].sum(axis=0) / np.sqrt(len(features)) + model.bias) / model.temperature)
        sure.append(p.max())
        right.append(p.argmax() == truth)
    sure, right = np.array(sure), np.array(right)
    bins = np.minimum((sure * 10).astype(int), 9)
    error = sum((bins == k).mean() * abs(sure[bins == k].mean() - right[bins == k].mean()) for k in range(10) if (bins == k).any())
    assert right.mean() > 0.9 and error < 0.08


def test_level_is_the_least_sum_of_squares():
    rng = random.Random(18)
    for _ in range(200):
        packer = packing.Packer(size=16, max_open=99)
        for level in rng.choices(range(1, 16), k=rng.randrange(30)):
            packer._put(level, [("d", 0, b"\0" * 4 * level)])
        s = rng.randrange(1, 16)
        before = packer.levels.copy()

        def squares(h):
            after = before.copy()
            if h:
                after[h] -= 1
            if h + s < 16:
                after[h + s] += 1
            return int((after[1:16] ** 2).sum())

        fits = [h for h in range(16 - s + 1) if h == 0 or before[h]]
        assert squares(packer._level_for(s)) == min(map(squares, fits))


def test_account_numbers_have_the_length_of_their_country():
    found = lambda t: re.compile(pii.PATTERNS["iban"].replace("++", "+")).findall(t)
    assert found("ES9121000418450200051332 CODE") == ["ES9121000418450200051332"]
    assert found("to ES91 2100 0418 4502 0005 1332 TEST and DE89 3704 0044 0532 0130 00.") == ["ES91 2100 0418 4502 0005 1332", "DE89 3704 0044 0532 0130 00"]
    assert found("NO9386011117947, XX9386011117947, xNO9386011117947 NO93860111179470") == ["NO9386011117947"]
    assert sorted(" ".join(pii.IBAN_LENGTHS.values()).split()) == sorted(set(" ".join(pii.IBAN_LENGTHS.values()).split()))


def test_hits_have_offsets_of_the_text():
    item = "the quick brown fox jumps over the lazy dog again and again"
    text = "  İntro\tİ  " + item.upper().replace(" ", " \n ") + "  tail"
    ((_, edits, lo, hi),) = decontam.Matcher([(1, item)]).search(text)
    assert edits == 0 and text[lo:hi] == item.upper().replace(" ", " \n ")
    for sample in ("", " ", "a b", "  İ x\n\ny ", "ΑΣ Σ"):
        assert len(decontam.places(sample)) == len(decontam.fold(sample))


def test_token_caches_are_bounded_by_bytes():
    own = packing.WordTokenizer(public_vocabulary(), limit=20_000, stretch=50)
    rng = random.Random(19)
    texts = [" ".join("".join(rng.choice("abcXYZ019.,éß漢字") for _ in range(rng.choice([1, 3, 8, 200]))) for _ in range(60)) for _ in range(40)]
    for text in texts:
        assert np.frombuffer(own.ids(text), np.uint32).tolist() == own.full.encode(text, add_special_tokens=False).ids
        assert own.held < 20_000 + 60 * (packing.ENTRY + 900) and not any(len(k) > 64 for k in own.chunks)
    assert own.ids("") == own.ids(" \n ") == b""


def test_cap_filters_recall():
    rng = np.random.default_rng(7)
    u = rng.normal(size=(1500, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    w /= np.linalg.norm(w, axis=1, keepdims=True)
    v = 0.93 * u + np.sqrt(1 - 0.93**2) * w
    coder = capfilters.CapFilters(64)
    a, b = (set(zip(*map(np.ndarray.tolist, coder.decode(x)))) for x in (u, v))
    assert len({r for r, _ in a & b}) >= 0.98 * len(u)


def test_block_intersections():
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 60, 40)).astype(np.uint64) for _ in range(12)]
    rows, columns = np.arange(5), np.arange(5, 12)
    got = ngramjoin.intersections(sets, rows, columns, width=7)
    assert got.tolist() == [[len(np.intersect1d(sets[x], sets[y])) for y in columns] for x in rows]


def test_sliding_min():
    x = np.random.default_rng(9).integers(0, 100, 50)
    for width in (1, 2, 7, 15):
        assert substrings.sliding_min(x, width).tolist() == [min(x[k : k + width]) for k in range(51 - width)]


def test_luhn_patterns_are_fixed():
    assert set(pii.PATTERNS) == set(pii.KINDS) and re.compile(pii.PATTERNS["phone"]).search("+1 (017) 555-7713")


def test_no_sequence_is_cut_before_the_end_of_a_partition(monkeypatch):
    """30,000 texts of mixed lengths: some hundred sequences stay open, and none is cut into another until the last text is in."""
    lengths = np.minimum(40_000, np.random.default_rng(5).lognormal(6.5, 1.1, 30_000).astype(int) + 1)
    packer, ids, most = packing.Packer(), bytes(4 * 40_000), 0
    monkeypatch.setattr(packer, "_merge", lambda leave: pytest.fail("cut while texts come"))
    for k, n in enumerate(lengths.tolist()):
        for _ in packer.add(k, ids[: 4 * n]):
            pass
        most = max(most, packer.count)
    assert 50 < most < 1000
