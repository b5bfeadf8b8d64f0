"""Layout blocks of a page's raw output: ``LABEL[[x1, y1, x2, y2]]`` and the text up to the next marker."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import constants as K
from .text import let, present, strip, token_of

#: Entered only where a label starts, with possessive runs, so that plain words cost one try each.
MARKER = r"(?<![A-Za-z_])([A-Za-z_][A-Za-z_0-9]*+)\s*+\[\[\s*+(\d++\s*+,\s*+\d++\s*+,\s*+\d++\s*+,\s*+\d++)\s*+\]\]"


def grid_to_norm(grid: Column) -> Column:
    """A 0 to 999 grid value as a share of the page side, clamped."""
    return F.greatest(F.least(grid.cast("double") / K.GRID_MAX, F.lit(1.0)), F.lit(0.0))


def bbox(grid: Column) -> Column:
    return F.struct(*[grid_to_norm(F.get(grid, k)).alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


def parse_blocks(raw: Column) -> Column:
    """array of (label, grid, bbox, text); text before the first marker is dropped; no marker: an empty array."""
    parts = F.arrays_zip(F.regexp_extract_all(raw, F.lit(MARKER), F.lit(0)).alias("mark"), let(F.split(raw, MARKER, -1), lambda texts: F.slice(texts, F.lit(2), F.size(texts))).alias("text"))

    def block(p: Column) -> Column:
        grid = F.transform(F.split(F.regexp_extract(p["mark"], MARKER, 2), r"\s*,\s*"), lambda g: strip(g).cast("bigint"))
        return let(grid, lambda g: F.struct(F.regexp_extract(p["mark"], MARKER, 1).alias("label"), g.alias("grid"), bbox(g).alias("bbox"), strip(p["text"]).alias("text")))

    return F.transform(parts, block)


def is_figure(label: Column) -> Column:
    return F.lower(label).isin(*K.FIGURE_LABELS)


def is_table(label: Column) -> Column:
    return F.lower(label).isin(*K.TABLE_LABELS)


def is_caption(label: Column) -> Column:
    return F.lower(label).isin(*K.CAPTION_LABELS)


def regions(blocks: Column) -> Column:
    """array of (label, bbox, text, figure): a figure's text is the caption block that follows it, ``figure`` its number on the page."""

    def every(found: Column, spots: Column) -> Column:
        def region(b: Column, i: Column) -> Column:
            following = F.get(found, i + 1)
            caption = F.when(is_caption(following["label"]), present(following["text"]))
            figure = is_figure(b["label"])
            return F.struct(b["label"].alias("label"), b["bbox"].alias("bbox"), F.when(figure, caption).otherwise(present(b["text"])).alias("text"), F.when(figure, F.array_position(spots, i).cast("int")).alias("figure"))

        return F.transform(found, region)

    spots = lambda found: F.filter(F.transform(found, lambda b, i: F.when(is_figure(b["label"]), i)), lambda i: i.isNotNull())
    return let(blocks, lambda found: let(spots(found), lambda s: every(found, s)))


def figure_id(page_number: Column, ordinal: Column) -> Column:
    return F.concat(F.lit("fig_p"), page_number.cast("string"), F.lit("_"), ordinal.cast("string"))


def page_markdown(raw: Column, blocks: Column, page_number: Column) -> Column:
    """Block texts joined by blank lines, figures as tokens; without markers the whole output, stripped."""

    def joined(found: Column) -> Column:
        numbered = F.transform(regions(found), lambda r: r["figure"])
        parts = F.transform(F.arrays_zip(found.alias("b"), numbered.alias("n")), lambda p: F.when(p["n"].isNotNull(), token_of(figure_id(page_number, p["n"]))).otherwise(present(p["b"]["text"])))
        return F.when(F.size(found) == 0, strip(raw)).otherwise(F.array_join(F.array_compact(parts), "\n\n"))

    return let(blocks, joined)


def pixel_box(box: Column, width: Column, height: Column, padding: float | Column = 0.0) -> Column:
    """The padded box in pixels (half to even), null where a side has fewer than two pixels."""
    pad = padding if isinstance(padding, Column) else F.lit(float(padding))
    low = lambda v, side: F.bround(F.greatest(F.least(v - pad, F.lit(1.0)), F.lit(0.0)) * side).cast("int")
    high = lambda v, side: F.bround(F.greatest(F.least(v + pad, F.lit(1.0)), F.lit(0.0)) * side).cast("int")
    made = F.struct(low(box["x1"], width).alias("x1"), low(box["y1"], height).alias("y1"), high(box["x2"], width).alias("x2"), high(box["y2"], height).alias("y2"))
    fits = (made["x2"] - made["x1"] >= K.MIN_CROP_PX) & (made["y2"] - made["y1"] >= K.MIN_CROP_PX)
    return F.when(fits, made)
