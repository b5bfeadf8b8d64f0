"""Splitting a document into main text, back matter and appendix, and putting it together again.

Offsets are code points from 0: the length of what stands before the first match of a pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import let, present, strip

# Heading patterns, in order of priority.
BACKMATTER = (
    r"Acknowledgments?\b", r"Acknowledgements?\b", r"Author\s+Contributions", r"Funding", r"Impact\s+Statement", r"Broader\s+Impact", r"Societal\s+Impact", r"Ethical\s+Considerations",
    r"(?:References|Bibliography)\b", r"Works\s+Cited\b", r"Literature\s+Cited\b", r"Citations?\b", r"References\s+and\s+Notes\b", r"References\s+Cited\b", r"Cited\s+(?:Works|Literature)\b",
)
APPENDIX = (r"(?:Appendix|Appendices)\b", r"(?:Supplementary|Supporting)\s+(?:Materials?|Information|Data)", r"Supplemental\s+", r"SI\s+", r"S\d+\.\s+")
GUARDED = (r"A\s+", r"A\.\s+")
PAGE_MARKER = r"(?i)^#{3,4}\s+Page\s+\d+\s*$"


def heading(pattern: str) -> str:
    return r"(?imd)^#+\s+" + pattern


def _any(patterns: tuple[str, ...]) -> str:
    """One pattern whose first match is the earliest of all of them, as each begins in the same way."""
    return heading("(?:" + "|".join(patterns) + ")")


def first_match(text: Column, pattern: str) -> Column:
    """Where a pattern first matches, or null."""
    return let(F.split(text, pattern, 2), lambda cut: F.when(F.size(cut) == 2, F.length(F.get(cut, 0))))


def before_marker(text: Column, start: Column) -> Column:
    """The start of the page marker line just before ``start``, if only blank lines (at most four) part them; ``start`` otherwise."""
    # Walks back from the last line: (length passed so far, found, stopped).
    state = F.struct(F.lit(-1).alias("passed"), F.lit(None).cast("int").alias("found"), F.lit(False).alias("stopped"))

    def step(acc: Column, line: Column) -> Column:
        passed = acc["passed"] + 1 + F.length(line)
        hit = line.rlike(PAGE_MARKER)
        done = acc["stopped"] | acc["found"].isNotNull()
        return F.when(done, acc).otherwise(F.struct(passed.alias("passed"), F.when(hit, passed).alias("found"), (~hit & (strip(line) != "")).alias("stopped")))

    def shifted(at: Column) -> Column:
        tail = let(F.split(F.substring(text, F.lit(1), at.cast("int")), "\n"), lambda lines: F.slice(lines, -F.least(F.size(lines), F.lit(5)), F.lit(5)))
        return at - F.coalesce(F.aggregate(F.reverse(tail), state, step, lambda acc: acc["found"]), F.lit(0))

    return let(start, lambda at: F.when(at.isNotNull(), shifted(at)))


def _least(*columns: Column) -> Column:
    return F.array_min(F.array_compact(F.array(*columns)))


def boundaries(text: Column) -> Column:
    """(backmatter, appendix) start offsets, each null where there is none."""

    def first(whole: Column) -> Column:
        return F.struct(
            whole.alias("text"), first_match(whole, _any(BACKMATTER)).alias("back"), first_match(whole, _any(APPENDIX)).alias("plain"),
            *[first_match(whole, heading(p)).alias(f"guarded_{k}") for k, p in enumerate(GUARDED)],
        )

    def shifted(f: Column) -> Column:
        later = [F.when(f[f"guarded_{k}"] > f["back"], f[f"guarded_{k}"]) for k in range(len(GUARDED))]
        return F.struct(f["text"].alias("text"), before_marker(f["text"], f["back"]).alias("back"), before_marker(f["text"], _least(f["plain"], *later)).alias("appendix"))

    def ordered(s: Column) -> Column:
        again = let(F.substring(s["text"], F.lit(1), s["appendix"].cast("int")), lambda ahead: before_marker(ahead, F.coalesce(*[first_match(ahead, heading(p)) for p in BACKMATTER])))
        return F.struct(F.when(s["back"] > s["appendix"], again).otherwise(s["back"]).alias("backmatter"), s["appendix"].alias("appendix"))  # the second search is for few

    return let(let(let(text, first), shifted), ordered)


def title_of(text: Column) -> Column:
    """The first top heading, else a BibTeX title, else ``Untitled_Paper``."""
    top = F.get(F.regexp_extract_all(text, F.lit(r"(?md)^# (.+?)$"), F.lit(1)), 0)
    cited = F.get(F.regexp_extract_all(text, F.lit(r"title=\{([^}]*)\}"), F.lit(1)), 0)
    return F.coalesce(strip(top), strip(cited), F.lit("Untitled_Paper"))


def _part(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"---\s*\z", ""))


def split_at(text: Column, bounds: Column) -> Column:
    """(title, main, backmatter, appendix); absent parts are null."""
    whole = F.length(text)
    cut = F.coalesce(bounds["appendix"], whole)
    own = F.coalesce(bounds["backmatter"], cut)
    piece = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    return F.struct(
        title_of(text).alias("title"), _part(piece(F.lit(0), own)).alias("main"),
        F.when(bounds["backmatter"].isNotNull(), _part(piece(own, cut))).alias("backmatter"), F.when(bounds["appendix"].isNotNull(), _part(piece(cut, whole))).alias("appendix"),
    )


def split_document(text: Column) -> Column:
    return split_at(text, boundaries(text))


def with_header(content: Column, title: Column, name: str) -> Column:
    return F.when(present(content).isNotNull(), F.concat(F.lit("# "), title, F.lit(f" - {name}\n\n---\n\n"), content))


def main_with_title(main: Column, title: Column) -> Column:
    """The main part with its first top heading replaced by the title, by position, so that signs in the title mean nothing."""
    cut = F.split(main, r"(?md)^# .*$", 2)
    return F.when(F.size(cut) == 2, F.concat(F.get(cut, 0), F.lit("# "), title, F.get(cut, 1))).otherwise(main)


def all_parts(sections: Column, add_title: bool = True) -> Column:
    """Main text, appendix, back matter, in that order."""
    framed = lambda part, name: with_header(sections[part], sections["title"], name) if add_title else present(sections[part])
    return F.concat_ws("\n\n", present(sections["main"]), framed("appendix", "Appendix"), framed("backmatter", "Backmatter"))
