"""Column expressions against pairs worked out by hand, and against plain Python on drawn inputs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliosmith import constants as K
from foliosmith.functions import citations as C, layout as L, sections as S, tables as T, text as X, urls as U


def value(spark, column, **inputs):
    frame = spark.range(1).select(*[F.lit(v).alias(k) for k, v in inputs.items()]) if inputs else spark.range(1)
    return frame.select(column.alias("out")).first()["out"]


def values(spark, texts, expression):
    """The expression of each text of a column ``t``."""
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    return [r["out"] for r in frame.select("k", expression.alias("out")).orderBy("k").collect()]


RAW = "noise heading[[0, 999, 333, 444]]Tides\nplot[[111, 5, 500, 1500]]caption[[7, 7, 8, 8]] Fig. A: the moon  TEXT [[1,2,3,4]] low water Diagram[[9,9,10,10]]"


def test_layout(spark):
    found = value(spark, L.parse_blocks(F.col("raw")), raw=RAW)
    assert [(b["label"], b["text"]) for b in found] == [("heading", "Tides"), ("plot", ""), ("caption", "Fig. A: the moon"), ("TEXT", "low water"), ("Diagram", "")]
    assert found[1]["bbox"]["x1"] == 111 / 999 and found[1]["bbox"]["y2"] == 1.0 and found[0]["bbox"]["y1"] == 1.0
    frame = spark.createDataFrame([(RAW,)], "raw string").withColumn("blocks", L.parse_blocks(F.col("raw")))
    row = frame.select(L.regions(F.col("blocks")).alias("r"), L.page_markdown(F.col("raw"), F.col("blocks"), F.lit(12)).alias("m")).first()
    assert [(r["text"], r["figure"]) for r in row["r"]] == [("Tides", None), ("Fig. A: the moon", 1), ("Fig. A: the moon", None), ("low water", None), (None, 2)]
    assert row["m"] == "Tides\n\n⟦FIG:fig_p12_1⟧\n\nFig. A: the moon\n\nlow water\n\n⟦FIG:fig_p12_2⟧"
    assert value(spark, L.page_markdown(F.col("raw"), L.parse_blocks(F.col("raw")), F.lit(1)), raw="\n no marks here ") == "no marks here"


def test_dehyphenate(spark):
    pairs = {"light-\nhouse": "lighthouse", "tide-\n\t table": "tidetable", "north-west": "north-west", "ö-\nä": "öä", "end-\n.": "end-\n.", "9-\n8": "98"}
    assert values(spark, pairs, X.dehyphenate(F.col("t"))) == list(pairs.values())


def test_description_blocks(spark):
    assert value(spark, X.format_blockquote(F.col("t")), t=" A chart.\n \nTwo axes. ") == "> **Image description.** A chart.\n>\n> Two axes."
    block = X.figure_block(F.lit("fig_p2_3"), F.lit("").cast("string"), F.lit("Map [north]"), F.lit("figures/fig_p2_3.png"), "describe-and-keep")
    assert value(spark, block) == "![Map \\[north\\]](figures/fig_p2_3.png)\n\n> **Image description.** [figure description unavailable]\n"
    with pytest.raises(ValueError):
        X.figure_block(F.lit("f"), F.lit("d"), F.lit("c"), F.lit("p"), "other")


def spaced(text):
    """The rules of description spacing in plain code."""
    lines, out, inside, after = text.split("\n"), [], False, False
    for k, line in enumerate(lines):
        header, caption = bool(re.match(X.HEADER_LINE, line)), line.startswith("Figure ")
        if not inside and header:
            out += ([""] if out and out[-1] != "" else []) + [line]
            inside, after = True, False
        elif inside and line.startswith(">"):
            out.append(line)
        elif inside:
            out += ["", line] if line != "" else []
            inside, after = False, True
        elif after and caption:
            out += ([""] if out and out[-1] != "" else []) + [line] + ([""] if k + 1 < len(lines) and lines[k + 1] != "" else [])
        else:
            out.append(line)
            after = after and (line == "" or caption)
    return "\n".join(out + [""] if inside else out)


def test_description_spacing(spark):
    rng = random.Random(1)
    parts = ["", "", "prose", "> **Image description.** d", "> more", "Figure 4: f", "> **Image.** [not displayed]", "> quote"]
    texts = ["\n".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(300)] + ["\n".join(rng.choice(parts) for _ in range(3000)), ""]
    assert values(spark, texts, X.description_spacing(F.col("t"))) == [spaced(t) for t in texts]


def test_walk_goes_on_over_blocks(spark):
    items = F.sequence(F.lit(1), F.col("n"))
    step = lambda at, i: F.struct((at + i).alias("state"), F.when(i % 2 == 0, F.array(at)).otherwise(F.array().cast("array<bigint>")).alias("out"))
    for n in (1, X.WALK_BLOCK - 1, X.WALK_BLOCK, X.WALK_BLOCK + 1, 3 * X.WALK_BLOCK):
        got = value(spark, X.walk(items, F.lit(0).cast("bigint"), step, "bigint"), n=n)
        assert got["state"] == n * (n + 1) // 2 and got["out"] == [i * (i - 1) // 2 for i in range(2, n + 1, 2)]
    assert tuple(value(spark, X.walk(F.array().cast("array<int>"), F.lit(0).cast("bigint"), step, "bigint"))) == (0, [])


def test_notice(spark):
    wants = {
        "words only": "*Transcribed with OCR; text may contain mistakes.*", "so \\(a\\)": "*Transcribed with OCR; text and equations may contain mistakes.*",
        "|x|y|\n|:---|---:|": "*Transcribed with OCR; text and tables may contain mistakes.*",
        "> **Image description.** e\n\\[b\\] </TD>": "*Transcribed with OCR and VLMs; text, equations, tables, and figure descriptions may contain mistakes.*",
    }
    assert values(spark, wants, X.notice(F.col("t"))) == list(wants.values())
    assert value(spark, X.notice(F.col("t"), True), t="<table>") == "*Transcribed with OCR and VLMs; text and tables may contain mistakes.*"


@pytest.mark.parametrize("spec,total,want", [
    (None, 3, [1, 2, 3]), (" ALL ", 1, [1]), ("6", 9, [6]), ("6", 5, []), ("4-7", 20, [4, 5, 6, 7]), ("8-", 10, [8, 9, 10]), ("-3", 8, [1, 2, 3]), ("5 - 60", 7, [5, 6, 7]), ("40-50", 12, []), ("7-2", 9, []), ("2", 0, []),
])
def test_page_numbers(spark, spec, total, want):
    assert value(spark, X.page_numbers(F.lit(spec).cast("string"), F.lit(total))) == want


@pytest.mark.parametrize("spec", ["two", "0", "1,2", "3--4"])
def test_bad_page_ranges(spark, spec):
    with pytest.raises(Exception, match="bad page range"):
        value(spark, X.page_numbers(F.lit(spec), F.lit(3)))


def test_urls(spark):
    wants = {
        "https://arxiv.org/abs/1907.00042": ("https://arxiv.org/pdf/1907.00042.pdf", "arxiv", "1907.00042"),
        "https://arxiv.org/pdf/0801.1234v7": ("https://arxiv.org/pdf/0801.1234v7.pdf", "arxiv", "0801.1234v7"),
        "https://openreview.net/forum?id=qq-7_Z": ("https://openreview.net/pdf?id=qq-7_Z", "openreview", None),
        "https://openreview.net/group": ("https://openreview.net/group", None, None),
        "https://arxiv.org.mirror.test/abs/1907.00042": ("https://arxiv.org.mirror.test/abs/1907.00042", None, None),
        "https://myarxiv.org/abs/1907.00042": ("https://myarxiv.org/abs/1907.00042", None, None),
    }
    got = values(spark, wants, F.struct(U.pdf_url(F.col("t")).alias("p"), U.repository_of(F.col("t")).alias("r"), U.arxiv_id(F.col("t")).alias("i")))
    assert [tuple(g) for g in got] == list(wants.values())


def test_citation_keys(spark):
    key = lambda t, a, y: value(spark, C.citation_key(F.lit(t), F.array(*[F.lit(x) for x in a]).cast("array<string>"), F.lit(y)))
    assert key("On the Drift of Buoys", ["Ada B. Marlowe", "C. D."], "1987") == "marlowe1987drift"
    assert key("In It", ["Otto Quill"], "2001") == "quill2001in"
    assert key("Sandbanks!", [], "1999").startswith("Unknown1999")


def plain_match(a, b):
    """The title rule in plain code."""
    a, b = (re.sub(r"\s+", " ", re.sub(r"[^a-z\s]", "", t.lower())).strip(" ") for t in (a, b))
    if len(a) < K.TITLE_FLOOR or len(b) < K.TITLE_FLOOR:
        return a == b
    words, known = a.split(" "), set(b.split(" "))
    return sum(w in known for w in words) / max(len(words), len(known)) > K.TITLE_SIMILARITY


def test_titles(spark):
    rng = random.Random(2)
    vocabulary = ["tide", "Buoy", "sand,", "of", "the", "sea", "wind!", "chart", "North"]
    pairs = [("Low Tide", "Low Tides"), ("the sea of the wind chart", "the sea of the wind"), ("", ""), ("!!", "??")]
    for _ in range(400):
        a = [rng.choice(vocabulary) for _ in range(rng.randrange(1, 9))]
        b = [w for w in a if rng.random() < 0.85] + [rng.choice(vocabulary) for _ in range(rng.randrange(2))]
        pairs.append((" ".join(a), " ".join(b)))
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, a string, b string")
    got = [r["m"] for r in rows.select("k", C.titles_match(F.col("a"), F.col("b")).alias("m")).orderBy("k").collect()]
    assert got == [plain_match(a, b) for a, b in pairs] and 50 < sum(got) < 350


@pytest.mark.parametrize("raw", [None, " ", "yes it is", "17", "[true]", '{"citable": null}', '{"citable": 1}', '{"citable": true, "title": ["t"]}', '{"citable": false, "authors": {"a": 1}}', '{"citable": true, "authors": ["a", 2]}', '{"citable": true, "venue": 3}', 'Answer {"citable": true}'])
def test_malformed_probes(spark, raw):
    assert value(spark, C.probe_answer(F.lit(raw).cast("string"))) is None


def test_probes(spark):
    got = value(spark, C.probe_answer(F.lit('```\n{"citable": false, "title": " Eddies ", "authors": ["", " P. Reef "], "year": 1876, "venue": ""}\n```')))
    assert tuple(got) == (False, "Eddies", ["P. Reef"], "1876", None)


def test_atom(spark):
    xml = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/77</id><published>2011-11-30T00:00:00Z</published><title>Salt \n and\tfoam</title><author><name> Ida  Brine </name></author><author><name>Z</name></author></entry></feed>'
    got = value(spark, C.atom_entry(F.lit(xml)))
    assert (got["title"], got["authors"], got["year"], got["primary_class"]) == ("Salt and foam", ["Ida Brine", "Z"], "2011", None)
    assert value(spark, C.atom_entry(F.lit("<!DOCTYPE feed>" + xml))) is None
    assert value(spark, C.atom_entry(F.lit(xml.replace("abs/77", "api/errors#3")))) is None


def test_table_answers(spark):
    assert value(spark, T.sanitize(F.lit("```\n| port | depth |\n\n  |---|---|  \n```"))) == "| port | depth |\n|---|---|"
    for bad in ("Sure:\n| port |\n|---|", "depths", "| port |", " ", None):
        assert value(spark, T.sanitize(F.lit(bad).cast("string"))) is None
    assert value(spark, T.digit_coverage_ok(F.lit("<td>55555 44444"), F.lit("5555544"))) is False
    assert value(spark, T.digit_coverage_ok(F.lit("<td>55555 44444"), F.lit("55555444"))) is True
    assert value(spark, T.digit_coverage_ok(F.lit("<td height=30>&#160;deep"), F.lit("deep"))) is True


def test_table_blobs(spark):
    made = "".join(f"é{k}<table a>{k}</table >" for k in range(1200))
    found = value(spark, T.find_blobs(F.col("t")), t=made + "<table>open")
    assert len(found) == 1200 and all(made[b["start"] : b["end"]] == b["blob"] for b in found)
    parts = F.array(*[F.struct(F.lit(a).cast("long").alias("start"), F.lit(b).cast("long").alias("end"), F.lit(t).alias("table")) for a, b, t in ((6, 7, " |1| "), (12, 13, "|2|"))])
    assert value(spark, T.splice(F.lit("abc\n  X mid  Y\n"), F.array(parts[0]))) == "abc\n\n|1|\n\nmid  Y\n"


def match(spark, blobs, regions):
    frame = spark.createDataFrame([(blobs, regions)], "b array<string>, r array<struct<label:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>,text:string>>")
    return frame.select(T.match_regions(F.col("b"), F.col("r")).alias("m")).first()["m"]


def test_blobs_and_regions(spark):
    wide, flat = (0.2, 0.3, 0.9, 0.8), (0.2, 0.3, 0.9, 0.305)
    p, q = "<table>ebb</table>", "<table>flow</table>"
    assert match(spark, [q, p], [("Table", wide, p), ("TABLE", wide, q)]) == [1, 0]
    assert match(spark, [p], [("paragraph", wide, p)]) == [None]
    assert match(spark, [q, q, q], [("table", wide, q), ("table", wide, q)]) == [0, 1, None]
    assert match(spark, [q], [("table", wide, f"see {q}."), ("table", wide, q)]) == [1]
    assert match(spark, [q], [("table", flat, q)]) == [None]
    assert match(spark, [p, q], [("table", wide, None), ("note", wide, f"N: {p}"), ("table", wide, ""), ("note", wide, f"N: {q}")]) == [0, 2]


def plain_bounds(text):
    """Where back matter and appendix begin, by the rules, in plain code; no page markers."""
    first = lambda p, t: (m := re.search(S.heading(p).replace("(?imd)", "(?im)"), t)) and m.start()
    least = lambda found: min([x for x in found if x is not None], default=None)
    back = least([first(p, text) for p in S.BACKMATTER])
    appendix = least([first(p, text) for p in S.APPENDIX] + [x for x in (first(p, text) for p in S.GUARDED) if x is not None and back is not None and x > back])
    if back is not None and appendix is not None and back > appendix:
        back = next((x for x in (first(p, text[:appendix]) for p in S.BACKMATTER) if x is not None), None)
    return back, appendix


def test_section_bounds(spark):
    rng = random.Random(3)
    parts = ["waves", "## Funding", "# References", "### Works cited", "## A Harbour", "## A. Proofs", "## Supplementary Dataset", "# Appendices", "## SI Tables", "## Citationless", "## S3. More", "# Acknowledgements", "## Impact statement", ""]
    texts = ["# Tides\n" + "\n".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(300)]
    assert [tuple(b) for b in values(spark, texts, S.boundaries(F.col("t")))] == [plain_bounds(t) for t in texts]


def split(spark, text):
    return value(spark, S.split_document(F.col("t")), t=text)


def test_sections(spark):
    got = split(spark, "# Moorings\nropes\n---\n## Bibliography\nknots\n")
    assert (got["title"], got["main"], got["backmatter"], got["appendix"]) == ("Moorings", "# Moorings\nropes", "## Bibliography\nknots", None)
    assert split(spark, "# M\nropes\n\n### Page 9\n\n\n## Bibliography\nknots")["backmatter"].startswith("### Page 9")
    assert split(spark, "# M\nropes\n### Page 9\nwords\n## Bibliography\nknots")["backmatter"].startswith("## Bibliography")
    assert value(spark, S.title_of(F.lit("x title={Spray and Mist} y"))) == "Spray and Mist"
    whole = value(spark, S.all_parts(S.split_document(F.col("t"))), t="# M\nropes\n## Works Cited\nknots\n## Appendix\nsplices")
    assert whole.index("ropes") < whole.index("# M - Appendix") < whole.index("splices") < whole.index("# M - Backmatter") < whole.index("knots")
    assert value(spark, S.main_with_title(F.lit("# was\nropes"), F.lit("$2 \\beta{r}"))) == "# $2 \\beta{r}\nropes"


def test_pixel_box(spark):
    box = lambda *v: F.struct(*[F.lit(x).alias(k) for k, x in zip(("x1", "y1", "x2", "y2"), v)])
    assert tuple(value(spark, L.pixel_box(box(0.1, 0.0, 0.5, 0.975), F.lit(200), F.lit(40), 0.05))) == (10, 0, 110, 40)
    assert value(spark, L.pixel_box(box(0.3, 0.1, 0.304, 0.9), F.lit(100), F.lit(100))) is None
