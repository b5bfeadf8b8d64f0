"""Page operators: layout parsing, figures, stitching, running headers and footers."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from .. import constants as K
from ..functions import layout as L, text as X


def parse_pages(pages: DataFrame, raw: str = "raw", page: str = "page_number") -> DataFrame:
    """Adds ``blocks``, ``regions`` and ``markdown`` to pages with raw layout output."""
    parsed = pages.withColumn("blocks", L.parse_blocks(F.col(raw)))
    return parsed.withColumn("regions", L.regions(F.col("blocks"))).withColumn("markdown", L.page_markdown(F.col(raw), F.col("blocks"), F.col(page)))


def zipped(pages: DataFrame, results: DataFrame, *keys: str) -> DataFrame:
    """Each page with its one result.  A page without one, a result without a page, or several of either are an error that names one of them."""
    count = lambda rows, name: rows.groupBy(*keys).agg(F.count("*").alias(name))
    both = count(pages, "__pages").join(count(results, "__results"), list(keys), "full")
    wrong = both.filter((F.coalesce("__pages", F.lit(0)) != 1) | (F.coalesce("__results", F.lit(0)) != 1)).orderBy(*keys).limit(1).collect()
    if wrong:
        row = wrong[0].asDict()
        raise ValueError(f"{', '.join(f'{k} {row[k]}' for k in keys)}: {row['__pages'] or 0} pages and {row['__results'] or 0} results")
    return pages.join(results, list(keys))


REGIONS = "array<struct<label:string,bbox:struct<x1:double,y1:double,x2:double,y2:double>,text:string,figure:int>>"


def layout_blocks(parsed: DataFrame, *keys: str) -> DataFrame:
    """(keys, block_idx, label, bbox, text, figure): one row a region, in page order from 0."""
    # An outer explode, as of a plain one the optimizer makes a filter that parses every page again.
    return parsed.select(*keys, F.posexplode_outer("regions").alias("block_idx", "r")).filter("r is not null").select(*keys, "block_idx", "r.label", "r.bbox", "r.text", "r.figure")


def figures(parsed: DataFrame, *keys: str, page: str = "page_number", width: str = "width_px", height: str = "height_px", padding: float = 0.0) -> DataFrame:
    """(keys, page, fig_id, caption, bbox, px_box): figures with their padded pixel box, null if too small to crop."""
    rows = parsed.select(*keys, page, width, height, F.explode_outer(F.filter("regions", lambda r: r["figure"].isNotNull())).alias("r")).filter("r is not null")
    return rows.select(*keys, page, L.figure_id(F.col(page), F.col("r.figure")).alias("fig_id"), F.col("r.text").alias("caption"), F.col("r.bbox").alias("bbox"), L.pixel_box(F.col("r.bbox"), F.col(width), F.col(height), padding).alias("px_box"))


def select_figures(parsed: DataFrame, detect: str, supports_grounding: bool = True) -> DataFrame:
    """Keeps the regions of a detection mode: ``none``, ``grounding``, ``auto``, or ``pdf-embedded``: boxes of the column ``embedded``, clamped to the page, from top to bottom, are the figures after the page's own regions, of which none is a figure then."""
    if detect == "auto":
        detect = "grounding" if supports_grounding else "pdf-embedded"
    if detect == "none":
        return parsed.withColumn("regions", F.filter("regions", lambda r: r["figure"].isNull()))
    if detect == "grounding":
        if not supports_grounding:
            raise ValueError("this backend does not ground figures")
        return parsed
    if detect == "pdf-embedded":
        clamped = lambda b: F.struct(*[F.greatest(F.least(b[c], F.lit(1.0)), F.lit(0.0)).alias(c) for c in ("x1", "y1", "x2", "y2")])
        ranked = F.array_sort(F.transform("embedded", lambda b, i: X.let(clamped(b), lambda c: F.struct(c["y1"].alias("y1"), i.alias("i"), c.alias("bbox")))))
        found = F.transform(ranked, lambda r, i: F.struct(F.lit("image").alias("label"), r["bbox"].alias("bbox"), F.lit(None).cast("string").alias("text"), (i + 1).alias("figure")))
        plain = F.transform(F.coalesce(F.col("regions").cast(REGIONS), F.array().cast(REGIONS)), lambda r: F.struct(r["label"].alias("label"), r["bbox"].alias("bbox"), r["text"].alias("text"), F.lit(None).cast("int").alias("figure")))
        return parsed.withColumn("regions", F.concat(plain, F.coalesce(found.cast(REGIONS), F.array().cast(REGIONS))))
    raise ValueError(f"unknown figure detection: {detect}")


def stitch_pages(pages: DataFrame, doc: str, page: str, text: str, page_numbers: bool = False, page_separators: bool = False, normalize: bool = True) -> DataFrame:
    """(doc, markdown): pages in order, each stripped of outer line ends, parted by a blank line or a rule."""
    made = pages.select(doc, F.col(page).alias("__page"), page_body(F.col(text), F.col(page), page_numbers, normalize).alias("__body"))
    ordered = F.array_sort(F.collect_list(F.struct("__page", "__body")))
    return made.groupBy(doc).agg(joined_bodies(F.transform(ordered, lambda p: p["__body"]), page_separators).alias("markdown"))


def page_body(text: Column, page: Column, page_numbers: bool = False, normalize: bool = True) -> Column:
    """What a page adds to its document."""
    body = X.strip_newlines(X.normalize_line_breaks(text) if normalize else text)
    return F.concat(F.lit("#### Page "), page.cast("string"), F.lit("\n\n"), body) if page_numbers else body


def joined_bodies(bodies: Column, page_separators: bool = False) -> Column:
    return F.array_join(bodies, "\n\n---\n\n" if page_separators else "\n\n")


def _ends(text: Column) -> tuple[Column, Column]:
    """The first and last non-blank line, '' where there is none."""
    filled = F.filter(F.split(text, "\n"), lambda line: X.strip(line) != "")
    return F.coalesce(F.get(filled, 0), F.lit("")), F.coalesce(F.get(filled, F.size(filled) - 1), F.lit(""))


def _candidate(line: Column) -> Column:
    """What a line recurs as, or null if it can't be page chrome."""
    plain = X.norm_line(line)
    return F.when(~X.is_protected_line(line) & (plain != "") & (F.length(plain) <= K.CHROME_MAX_CHARS), plain)


def running_chrome(pages: DataFrame, doc: str, text: str, min_pages: int = K.CHROME_MIN_PAGES, min_fraction: float = K.CHROME_FRACTION) -> DataFrame:
    """(doc, place, line, pages): lines that recur first (``top``) or last (``bottom``) on enough pages of a document."""
    top, bottom = _ends(F.col(text))
    lines = pages.select(doc, F.explode(F.array(F.struct(F.lit("all").alias("place"), F.lit("").alias("line")), F.struct(F.lit("top").alias("place"), _candidate(top).alias("line")), F.struct(F.lit("bottom").alias("place"), _candidate(bottom).alias("line")))).alias("l"))
    counted = lines.filter("l.line is not null").groupBy(doc, "l.place", "l.line").agg(F.count("*").alias("pages"))
    total = counted.filter("place = 'all'").select(F.col(doc).alias("__doc"), F.col("pages").alias("__n"))
    least = F.greatest(F.lit(2), F.ceil(F.round(F.col("__n") * min_fraction, 9)))
    found = counted.filter("place <> 'all'").join(total, F.col(doc).eqNullSafe(F.col("__doc")))
    return found.filter((F.col("__n") >= min_pages) & (F.col("pages") >= least)).select(doc, "place", "line", "pages")


def _drop(lines: Column, chrome: Column, last: bool) -> Column:
    """The lines without their first or last non-blank one, if that is chrome."""
    numbered = lambda ls: F.filter(F.transform(ls, lambda line, i: F.struct(line.alias("line"), i.alias("i"))), lambda p: X.strip(p["line"]) != "")
    end = lambda ls: X.let(numbered(ls), lambda f: F.get(f, F.size(f) - 1) if last else F.get(f, 0))
    at = lambda ls: X.let(end(ls), lambda p: F.when(~X.is_protected_line(p["line"]) & F.array_contains(chrome, X.norm_line(p["line"])), p["i"]))
    return X.let(lines, lambda ls: X.let(at(ls), lambda k: F.filter(ls, lambda _, i: k.isNull() | (i != k))))


def strip_chrome(pages: DataFrame, doc: str, text: str, min_pages: int = K.CHROME_MIN_PAGES, min_fraction: float = K.CHROME_FRACTION, keep: Callable[[DataFrame], DataFrame] = lambda lists: lists) -> DataFrame:
    """The pages without running headers and footers; documents without any are untouched.  Counts are aggregated by line, so a document of
    very many pages is no hot spot, and come back by one join on the document.  ``keep`` may write the lists of lines first, so that the optimizer
    knows their bytes and shuffles no page where they are few."""
    found = running_chrome(pages, doc, text, min_pages, min_fraction)
    lists = found.groupBy(F.col(doc).alias("__doc")).agg(F.collect_set(F.when(F.col("place") == "top", F.col("line"))).alias("__tops"), F.collect_set(F.when(F.col("place") == "bottom", F.col("line"))).alias("__bottoms"))
    joined = pages.join(keep(lists), F.col(doc).eqNullSafe(F.col("__doc")), "left")
    lines = _drop(_drop(F.split(F.col(text), "\n"), F.col("__tops"), False), F.col("__bottoms"), True)
    clean = X.strip_newlines(F.array_join(lines, "\n"))
    return joined.withColumn(text, F.when(F.col("__tops").isNull(), F.col(text)).otherwise(clean)).select(*pages.columns)
