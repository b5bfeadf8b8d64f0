"""Table blobs, the guards of restructured tables, and their splicing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from .layout import is_table
from .text import let, lstrip, present, rstrip, strip, walk

BLOB = r"(?is)<table\b[^>]*>.*?</table\s*>"
#: Replacements whose gaps are cut out of one stretch of text.
SPLICE_BLOCK = 64


def find_blobs(text: Column) -> Column:
    """array of (start, end, blob) in code points, end exclusive."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(BLOB), F.lit(0)).alias("blob"), F.split(text, BLOB, -1).alias("gap"))
    item = "struct<start:bigint,end:bigint,blob:string>"

    def step(at: Column, p: Column) -> Column:
        start = at + F.length(p["gap"])
        end = start + F.length(p["blob"])
        return F.struct(end.alias("state"), F.array(F.struct(start.alias("start"), end.alias("end"), p["blob"].alias("blob"))).alias("out"))

    return walk(F.filter(pairs, lambda p: p["blob"].isNotNull()), F.lit(0).cast("bigint"), step, item)["out"]


def is_refinable(blob: Column) -> Column:
    """Holds no figure token, one opening tag, and some letter or digit outside tags."""
    return ~blob.rlike(K.ANY_TOKEN) & (F.regexp_count(blob, F.lit(r"(?i)<table\b")) <= 1) & F.regexp_replace(blob, r"<[^>]+>", " ").rlike("[0-9A-Za-z]")


def digits(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\P{Nd}", ""))


def digit_coverage_ok(blob: Column, table: Column, least: float = K.DIGIT_COVERAGE) -> Column:
    """Whether a candidate keeps enough of a blob's digits, those in tags and entities aside."""
    had = digits(F.regexp_replace(F.regexp_replace(blob, r"<[^>]+>", " "), r"&#?\w+;", " "))
    return let(had, lambda n: (n == 0) | (digits(table) >= F.lit(least) * n))


def sanitize(raw: Column) -> Column:
    """A pipe table out of a model's answer, without a code fence around it; null for anything else."""

    def unfenced(bare: Column) -> Column:
        return F.coalesce(strip(present(F.regexp_extract(bare, r"(?s)\A```[A-Za-z]*\s*\n(.*?)\n?```\s*\z", 1))), bare)

    def table(lines: Column) -> Column:
        good = (F.size(lines) >= 2) & F.forall(lines, lambda line: line.startswith("|"))
        return F.when(good, F.array_join(lines, "\n"))

    return let(let(strip(raw), unfenced), lambda body: let(F.filter(F.transform(F.split(body, "\n"), strip), lambda line: line != ""), table))


def accepted(blob: Column, answer: Column) -> Column:
    """The table to put in place of a blob, or null to keep the blob."""
    return let(sanitize(answer), lambda table: F.when(digit_coverage_ok(blob, table), table))


def page_context(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, BLOB, ""), K.ANY_TOKEN, ""))


def ordinal(n: Column) -> Column:
    tens, ones = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    return F.concat(n.cast("string"), F.when(tens.between(10, 20), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th"))


def locator(index: Column, count: Column) -> Column:
    several = F.concat(F.lit("This page contains "), count.cast("string"), F.lit(" tables; reconstruct the "), ordinal(index), F.lit(" table (the one whose values match the OCR text below)."))
    return F.when(count == 1, F.lit("This page contains a single table; reconstruct it.")).otherwise(several)


def splice(text: Column, replacements: Column) -> Column:
    """Puts (start, end, table) replacements in, each parted from its neighbours by a blank line.

    The text is a list of segments, the gaps between replacements that don't overlap, and is put together once.  Gaps are cut out of stretches
    of ``SPLICE_BLOCK`` replacements, as a cut reads its text from the beginning, so the time is in proportion to the page.
    """

    def segments(rs: Column) -> Column:
        end = lambda at: F.when(at > 0, F.get(rs, at - 1)["end"]).otherwise(F.lit(0)).cast("int")
        starts = F.sequence(F.lit(0), F.floor((F.size(rs) - 1) / SPLICE_BLOCK).cast("int"))

        def stretch(k: Column) -> Column:
            part = F.slice(rs, k * SPLICE_BLOCK + 1, F.lit(SPLICE_BLOCK))
            base = end(k * SPLICE_BLOCK)
            cut = F.substring(text, base + 1, end(k * SPLICE_BLOCK + F.size(part)) - base)
            return let(F.struct(cut.alias("text"), base.alias("base"), part.alias("part")), pieces)

        def pieces(s: Column) -> Column:
            def one(r: Column, i: Column) -> Column:
                before = F.when(i > 0, F.get(s["part"], i - 1)["end"]).otherwise(s["base"]).cast("int")
                gap = F.substring(s["text"], before - s["base"] + 1, r["start"].cast("int") - before)
                return F.array(present(F.when(before > 0, strip(gap)).otherwise(rstrip(gap))), present(strip(r["table"])))

            return F.flatten(F.transform(s["part"], one))

        last = present(lstrip(F.substring(text, end(F.size(rs)) + 1, F.length(text))))
        return F.array_join(F.concat(F.flatten(F.transform(starts, stretch)), F.array(last)), "\n\n")

    return let(F.sort_array(replacements), lambda rs: F.when(F.size(rs) > 0, segments(rs)).otherwise(text))


def region_texts(regions: Column) -> Column:
    """The regions with the texts that ``match_regions`` and figures' captions need: of tables, of what follows a table, and of figures."""
    needed = lambda r, i: r["figure"].isNotNull() | is_table(r["label"]) | ((i > 0) & F.coalesce(is_table(F.get(regions, i - 1)["label"]), F.lit(False)))
    return F.transform(regions, lambda r, i: r.withField("text", F.when(F.coalesce(needed(r, i), F.lit(False)), r["text"])))


def match_regions(blobs: Column, regions: Column) -> Column:
    """For each blob, in order, the region it belongs to, or null: of the unused table regions with a wide enough box, the first
    whose anchor (its text, else the following region's) equals the blob, else the first whose anchor holds it.  A fold over the blobs."""
    found = F.transform(regions, lambda r, i: F.struct(i.alias("at"), r["label"].alias("label"), r["bbox"].alias("bbox"), F.coalesce(present(r["text"]), present(F.get(regions, i + 1)["text"])).alias("anchor")))
    wide = lambda b: (b["x2"] - b["x1"] >= K.MIN_TABLE_SPAN) & (b["y2"] - b["y1"] >= K.MIN_TABLE_SPAN)
    candidates = F.filter(found, lambda c: is_table(c["label"]) & wide(c["bbox"]) & c["anchor"].isNotNull())
    state = F.struct(candidates.alias("free"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, blob: Column) -> Column:
        exact = F.get(F.filter(acc["free"], lambda c: c["anchor"] == blob), 0)["at"]
        held = F.get(F.filter(acc["free"], lambda c: F.contains(c["anchor"], blob)), 0)["at"]
        pick = F.coalesce(exact, held)
        return F.struct(F.filter(acc["free"], lambda c: pick.isNull() | (c["at"] != pick)).alias("free"), F.array_append(acc["out"], pick).alias("out"))

    return F.aggregate(blobs, state, step, lambda acc: acc["out"])
