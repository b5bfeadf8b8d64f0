"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are folded to lower case with single spaces.  An item of m characters may be met with up to
k = floor(rate * m) edits.  It is cut into k + 1 pieces, so that at least one piece of any such occurrence is exact: one
automaton over all pieces finds the exact hits, and Myers' bit-parallel distance verifies the text around each.  No hit is capped.
Offsets are code points of the text itself, so a hit can be cut out of it.

The items are a stated query set: they go to the tasks in blocks of about ``block_chars`` characters, one pass over the documents
a block, so what is sent is bounded however large the benchmark is.

Defined results: items or texts that are null or empty match nothing; an item of fewer than ``exact_below`` characters
matches only exactly and with no letter, digit, mark or underscore next to it; repeated items or documents are each reported (a row for each document row and item id);
an empty input gives an empty output; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .storage import frugal, written

RATE, EXACT_BELOW, BLOCK_CHARS = 0.08, 24, 2_000_000


def fold(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def places(text: str) -> list[tuple[int, int]]:
    """For each character of ``fold(text)``, where the characters of ``text`` that it stands for begin and end."""
    out: list[tuple[int, int]] = []
    blank = -1
    for k, c in enumerate(text):
        if c.isspace():
            blank = k if blank < 0 else blank
            continue
        if blank >= 0 and out:
            out.append((blank, k))
        blank = -1
        out += [(k, k + 1)] * len(c.lower())
    return out


def in_word(sign: str) -> bool:
    """Whether a character (or none) is a letter, digit, underscore or combining mark."""
    return bool(sign) and (sign.isalnum() or sign == "_" or unicodedata.category(sign)[0] == "M")


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces that cover the item, as (offset, piece), of lengths that differ by one at most."""
    n = min(k + 1, len(item))
    cuts = [len(item) * j // n for j in range(n + 1)]
    return [(lo, item[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for j, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << j
    return masks


def distances(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> Iterator[int]:
    """Myers: after each character of ``text``, the least edits between the pattern and a part of text that ends there (anchored: that starts at 0)."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, first = full, 0, m, int(anchored)
    for c in text:
        same = masks.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        same |= down
        rise = down | full & ~(across | up)
        fall = up & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise = (rise << 1 | first) & full
        up = (fall << 1 | ~(same | rise)) & full
        down = rise & same
        yield score


class Matcher:
    """All items of a block; ``search`` gives the best occurrence of each item in a text."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE, exact_below: int = EXACT_BELOW):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            item = fold(text)
            if item:
                k = 0 if len(item) < exact_below else int(rate * len(item))
                for offset, piece in pieces(item, k):
                    at.setdefault(piece, []).append((len(self.items), offset))
                self.items.append((key, item, k, len(item) < exact_below, masks_of(item), masks_of(item[::-1])))
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) in code points of the text: fewest edits, then the earliest end of the folded text."""
        whole, text = text, fold(text)
        if not self.items or not text:
            return []
        diagonals: dict[int, set[int]] = {}
        for end, (size, where) in self.automaton.iter(text):
            for item, offset in where:
                diagonals.setdefault(item, set()).add(end + 1 - size - offset)
        found = []
        for index in sorted(diagonals):
            key, item, k, exact, masks, back = self.items[index]
            m, best = len(item), None
            for lo, hi in self._windows(sorted(diagonals[index]), m, k):
                lo, hi = max(lo, 0), min(hi, len(text))
                if exact:
                    bounded = not in_word(text[lo - 1 : lo]) and not in_word(text[hi : hi + 1])
                    score, end = (0, hi) if bounded and text[lo:hi] == item else (m + 1, hi)
                else:
                    score, end = min(((s, lo + j + 1) for j, s in enumerate(distances(masks, m, text[lo:hi]))), default=(m + 1, hi))
                if score <= k and (best is None or (score, end) < best):
                    best = (score, end)
            if best:
                score, end = best
                before = text[max(0, end - m - k) : end][::-1]
                length = next((j + 1 for j, s in enumerate(distances(back, m, before, anchored=True)) if s == score), m)
                found.append((key, score, end - length, end))
        if not found:
            return found
        at = places(whole)
        return [(key, score, at[lo][0], at[hi - 1][1]) for key, score, lo, hi in found]

    @staticmethod
    def _windows(starts: list[int], m: int, k: int) -> Iterator[tuple[int, int]]:
        """Stretches of text that hold every occurrence on the given diagonals; near ones are searched as one."""
        first = last = starts[0]
        for start in starts[1:]:
            if k and start - last <= 2 * k:
                last = start
            else:
                yield first - k, last + m + k
                first = last = start
        yield first - k, last + m + k


def blocks(benchmark: DataFrame, item_id: str, text_col: str, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The distinct items in hash-chosen blocks of about ``block_chars`` characters."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(text_col).alias("text")).filter("id is not null and length(text) > 0")
    total = items.agg(F.sum(F.length("text").cast("bigint"))).first()[0] or 0
    n = -(-total // block_chars)
    for k in range(n):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).distinct()
        yield sorted((r["id"], r["text"]) for r in part.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, exact_below: int = EXACT_BELOW, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(document id, item_id, edits, start, end) of each item found in each document."""
    shown = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    fields = [T.StructField("item_id", T.LongType()), T.StructField("edits", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
    schema = T.StructType([shown.schema.fields[0], *fields])

    def search(items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate, exact_below)
            for batch in batches:
                keys, rows = [], []
                for k, text in enumerate(batch.column(1)):
                    hits = matcher.search(text.as_py())
                    keys += [k] * len(hits)
                    rows += hits
                columns = list(zip(*rows)) or [()] * 4
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], names=schema.names)

        return shown.mapInArrow(frugal(run), schema)

    out = None
    for items in blocks(benchmark, item_id, item_text, block_chars):
        found = search(items)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else shown.limit(0).select(id_col, *[F.lit(None).cast("long").alias(f.name) for f in fields])


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, exact_below: int = EXACT_BELOW, block_chars: int = BLOCK_CHARS, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows without any hit.  Each row is judged by its own text within the search, so its id may be null or repeated; no join.

    With several blocks of items the rows left by one are written before the next, so that a task holds one block.
    """
    at = docs.columns.index(text_col)

    def without(rows: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(items, rate, exact_below)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.search(text.as_py()) for text in batch.column(at)], pa.bool_()))

        return rows.mapInArrow(frugal(run), rows.schema)

    out = docs
    for k, items in enumerate(blocks(benchmark, item_id, item_text, block_chars)):
        out = without(written(out, f"clean-{k}") if k else out, items)
    return out
