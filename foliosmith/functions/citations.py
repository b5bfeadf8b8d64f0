"""Citation text: keys, escaping, title comparison, entries; strict reading of probe answers and Atom entries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from .text import let, present, strip

# Words a key's title part passes over, and the comment lines of entries.
PASSED_OVER = ("a", "an", "the", "on", "in", "of", "for", "and", "or")
HEADER = "% NOTE: Best-effort entry generated from the document's own front matter\n% (no citation database was consulted). Verify before use.\n%\n"


def escape_text(text: Column) -> Column:
    """BibTeX escapes of special signs, curly quotes and dashes."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)([&%$#_{}~^\\]|[\s&&[^ ]])", r"\\$1")
    for sign, plain in (("“", "``"), ("”", "``"), ("‘", "''"), ("’", "''"), ("—", "---"), ("–", "--")):
        out = F.replace(out, F.lit(sign), F.lit(plain))
    return out


def citation_key(title: Column, authors: Column, year: Column) -> Column:
    """Last name of the first author, year, first telling word of the title."""
    words = F.transform(F.split(title, " "), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", ""))
    telling = let(words, lambda ws: F.coalesce(F.get(F.filter(ws, lambda w: (F.length(w) > 2) & ~w.isin(*PASSED_OVER)), 0), F.get(ws, 0)))
    return F.concat(F.coalesce(F.lower(F.element_at(F.split(F.get(authors, 0), " "), -1)), F.lit("Unknown")), year, telling)


def normalize_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"[^a-z\s]", ""), r"\s+", " "))


def title_form(title: Column) -> Column:
    """(text, words, known) of a title: normalised, its words, its distinct words; made once a title, however often it is compared."""
    return let(normalize_title(title), lambda t: let(F.split(t, " "), lambda words: F.struct(t.alias("text"), words.alias("words"), F.array_distinct(words).alias("known"))))


def shared_words(words: Column, known: Column) -> Column:
    """How many of ``words``, repeats counted, are among the distinct ``known`` ones: both in one sorted list, each word right after its known twin."""
    marked = lambda ws, side: F.transform(ws, lambda w: F.struct(w.alias("word"), F.lit(side).alias("side")))
    state = lambda twin, n: F.struct(twin.alias("twin"), n.alias("n"))
    step = lambda acc, x: F.when(x["side"] == 0, state(x["word"], acc["n"])).otherwise(state(acc["twin"], acc["n"] + F.coalesce(x["word"] == acc["twin"], F.lit(False)).cast("int")))
    return F.aggregate(F.sort_array(F.concat(marked(known, 0), marked(words, 1))), state(F.lit(None).cast("string"), F.lit(0)), step, lambda acc: acc["n"])


def forms_match(a: Column, b: Column) -> Column:
    """``titles_match`` of two title forms.  Words of a that b lacks are found by hashing; they are counted only if they may be few enough."""
    longest = F.greatest(F.size(a["words"]), F.size(b["known"]))

    def counted(unknown: Column) -> Column:
        most = F.size(a["words"]) - F.size(unknown)
        shared = F.when(F.size(unknown) == 0, F.size(a["words"])).otherwise(shared_words(a["words"], b["known"]))
        return F.when(most / longest <= K.TITLE_SIMILARITY, F.lit(False)).otherwise(shared / longest > K.TITLE_SIMILARITY)

    short = (F.length(a["text"]) < K.TITLE_FLOOR) | (F.length(b["text"]) < K.TITLE_FLOOR)
    return F.when(short | (a["text"] == b["text"]), (a["text"] == b["text"]) & (short | (F.size(a["words"]) / longest > K.TITLE_SIMILARITY))).otherwise(let(F.array_except(a["known"], b["known"]), counted))


def titles_match(original: Column, cited: Column) -> Column:
    """Whether a cited title is that of the paper; asymmetric: words of the original count as often as they occur."""
    return let(F.struct(title_form(original).alias("a"), title_form(cited).alias("b")), lambda n: forms_match(n["a"], n["b"]))


def _authors(authors: Column) -> Column:
    return F.when(F.size(authors) > 0, F.concat(F.lit("  author={"), F.array_join(F.transform(authors, escape_text), " and "), F.lit("}")))


def _field(name: str, value: Column) -> Column:
    """A field line, null for a null or empty value."""
    return F.concat(F.lit(f"  {name}={{"), present(value), F.lit("}"))


def _entry(kind: str, key: Column, *fields: Column) -> Column:
    return F.concat(F.lit(f"@{kind}{{"), key, F.lit(",\n"), F.array_join(F.array_compact(F.array(*fields)), ",\n"), F.lit("\n}"))


def _title(title: Column) -> Column:
    return F.concat(F.lit("  title={"), escape_text(title), F.lit("}"))


def article_entry(title: Column, authors: Column, year: Column, venue: Column, doi: Column, url: Column, current_year: str) -> Column:
    """A published article; ``current_year`` stands in keys of undated papers."""
    key = citation_key(title, authors, F.coalesce(present(year), F.lit(current_year)))
    return _entry("article", key, _title(title), F.coalesce(_authors(authors), F.lit("  author={Unknown}")), _field("year", year), _field("journal", escape_text(venue)), _field("doi", doi), _field("url", url))


def preprint_entry(title: Column, authors: Column, year: Column, identifier: Column, current_year: str, primary_class: Column | None = None) -> Column:
    key = citation_key(title, authors, F.coalesce(present(year), F.lit(current_year)))
    return _entry(
        "misc", key, _title(title), _authors(authors), _field("year", year), _field("eprint", identifier), F.lit("  archivePrefix={arXiv}"),
        _field("primaryClass", primary_class) if primary_class is not None else F.lit(None).cast("string"), F.concat(F.lit("  url={https://arxiv.org/abs/"), identifier, F.lit("}")),
    )


def best_effort_entry(title: Column, authors: Column, year: Column, venue: Column, current_year: str) -> Column:
    """An entry from the document's own front matter, or null without a title."""
    key = citation_key(title, authors, F.coalesce(present(year), F.lit(current_year)))
    return F.when(present(title).isNotNull(), F.concat(F.lit(HEADER), _entry("misc", key, _title(title), _authors(authors), _field("year", year), _field("note", escape_text(venue)))))


def mock_entry(title: Column, date: str, year: str) -> Column:
    """What stands where no source knows the paper."""
    # The comment lines and fields of the entry.
    head = f"% WARNING: This is a fallback mock citation.\n% BibTeX generation failed to find this paper in academic databases.\n% Please replace with the correct citation if available.\n%\n% Generated: {date}\n@article{{unknownYear,\n  title={{"
    return F.concat(F.lit(head), title, F.lit(f"}},\n  author={{Unknown Author}},\n  journal={{Unknown Journal}},\n  year={{{year}}},\n  note={{This is an automatically generated fallback citation}}\n}}"))


def mismatch_warning(original: Column, cited: Column) -> Column:
    # The comment lines.
    return F.concat(F.lit('% WARNING: The retrieved citation title may not match the paper title.\n% Paper title: "'), original, F.lit('"\n% Citation title: "'), cited, F.lit('"\n% \n'))


def is_preprint_venue(venue: Column) -> Column:
    bare = F.lower(strip(F.coalesce(venue, F.lit(""))))
    return (bare == "") | bare.startswith("arxiv")


def entry_key(bibtex: Column) -> Column:
    """The key of an entry, null where there is none."""
    return F.nullif(F.regexp_extract(bibtex, r"(?U)@\w+\{([^,\s{}]+),", 1), F.lit(""))


def probe_answer(raw: Column) -> Column:
    """(citable, title, authors, year, venue) of an answer that has exactly these types; null for anything else."""
    fence = r"(?s)\A```[A-Za-z]*\s*\n(.*?)\n?```\s*\z"
    body = let(strip(raw), lambda bare: F.coalesce(strip(F.nullif(F.regexp_extract(bare, fence, 1), F.lit(""))), bare))
    fields = ("citable", "title", "authors", "year", "venue")

    def read(v: Column) -> Column:
        kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$.{n}", "variant")), F.lit("VOID")).alias(f"{n}_kind") for n in fields]
        texts = [present(strip(F.try_variant_get(v, f"$.{n}", "string"))).alias(n) for n in ("title", "year", "venue")]
        names = F.try_variant_get(v, "$.authors", "array<variant>")
        plain = F.coalesce(F.forall(names, lambda a: F.schema_of_variant(a) == "STRING"), F.lit(True))
        authors = F.filter(F.transform(F.coalesce(names, F.array().cast("array<variant>")), lambda a: strip(F.try_variant_get(a, "$", "string"))), lambda a: a != "")
        return F.struct(*kinds, *texts, plain.alias("plain"), authors.alias("authors"), F.try_variant_get(v, "$.citable", "boolean").alias("citable"), F.coalesce(F.schema_of_variant(v), F.lit("VOID")).alias("kind"))

    def typed(r: Column) -> Column:
        good = (
            r["kind"].startswith("OBJECT") & (r["citable_kind"] == "BOOLEAN") & r["title_kind"].isin("STRING", "VOID") & r["venue_kind"].isin("STRING", "VOID") & r["year_kind"].isin("STRING", "VOID", "BIGINT", "BOOLEAN")
            & (r["authors_kind"].startswith("ARRAY") | (r["authors_kind"] == "VOID")) & r["plain"]
        )
        year = F.when(r["year_kind"] == "BOOLEAN", F.initcap(r["year"])).otherwise(r["year"])
        return F.when(good, F.struct(r["citable"].alias("citable"), r["title"].alias("title"), r["authors"].alias("authors"), year.alias("year"), r["venue"].alias("venue")))

    return let(let(F.try_parse_json(body), read), typed)


def atom_entry(xml: Column) -> Column:
    """(title, authors, year, primary_class) of the first Atom entry; null with a DTD, an error entry or no title."""
    plain = F.when(xml.rlike(r"(?i)<!DOCTYPE|<!ENTITY"), None).otherwise(F.regexp_replace(F.regexp_replace(xml, r"\sxmlns(?::\w+)?=\x22[^\x22]*\x22", ""), r"(</?)\w+:", "$1"))
    value = lambda path: present(strip(F.regexp_replace(F.xpath_string(plain, F.lit(path)), r"\s+", " ")))
    year = F.nullif(F.regexp_extract(value("//entry[1]/published"), r"\A(\d{4})", 1), F.lit(""))
    names = F.filter(F.transform(F.xpath(plain, F.lit("//entry[1]/author/name/text()")), lambda a: strip(F.regexp_replace(a, r"\s+", " "))), lambda a: a != "")
    good = value("//entry[1]/title").isNotNull() & ~F.coalesce(F.contains(value("//entry[1]/id"), F.lit("api/errors")), F.lit(False))
    return F.when(good, F.struct(value("//entry[1]/title").alias("title"), names.alias("authors"), year.alias("year"), present(F.xpath_string(plain, F.lit("//entry[1]/primary_category/@term"))).alias("primary_class")))
