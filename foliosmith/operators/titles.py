"""All texts whose titles match, by ``functions.citations.titles_match``: classes of equal normalised text, and directed pairs between their representatives.

A matches B if the words of A that B knows, counted as often as A has them, are more than 0.75 of A's words and of B's distinct words.  So A may
miss u = n - 1 - floor(3 n / 4) of its n words at most: words of A that make up more than u of them hold one that any such B has.  B gets no prefix,
as one word of B may stand for many of A; B is found by any of its words.  Longer prefixes must share as much more.  B has at least A's distinct
words less u and fewer than 4 n / 3.  Of B's found, those that lack more than u bits of A's signature go; each survivor is counted in full.

Classes are dealt by size into blocks of about as many words and each pair of blocks is one task, so no word and no group of like texts makes a task
larger, and a text is passed over where no text has a fitting size; work and bytes moved still grow with the square of the classes, as the matches do.
Word lists are written once and dealt out in rounds: in round k block i meets block i + k, so a list is on disk at most three times at once, as the
shuffle files of a round go when it ends.  Nothing is capped.  Words stand as 64-bit hashes.

Defined results: a null text counts as an empty one; texts under ten normalised characters match only as equals, so they are in classes
only; rows without an id are left out; ids name one text each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .. import constants as K
from ..functions import citations as C
from ..sources.durable import durable

#: Whether shuffle files go when the query that made them ends.
CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BLOCK_ROWS, BLOCK_WORDS, CHUNK_WORDS, LEAST_BLOCKS = 16_000, 2_500_000, 500_000, 6
#: Classes of sizes for each doubling; hash buckets of words; rows that a longer prefix may meet for each word of a text.
SIZE_CLASSES, BUCKETS, LONGER = 16, 1 << 20, 40


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all stretches, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Side:
    """Distinct words of the texts of a block, and how often each stands there; texts by their number of distinct words."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, at: np.ndarray):
        self.at = at[np.argsort(sizes[at], kind="stable")]
        self.sizes = sizes[self.at]
        self.starts, here = np.cumsum(self.sizes) - self.sizes, _ranges(starts[self.at], self.sizes)
        self.words, self.counts = words[here], counts[here]
        self.buckets = (self.words & (BUCKETS - 1)).astype(np.int32)
        self.rows = np.repeat(np.arange(len(at), dtype=np.int32), self.sizes)
        self.n = np.bincount(self.rows, self.counts, len(at)).astype(np.int64)
        self.spare = self.n - 1 - 3 * self.n // 4

    def of(self, row: int) -> slice:
        return slice(self.starts[row], self.starts[row] + self.sizes[row])

    def signs(self, bits: int) -> np.ndarray:
        """Of each text, the bits that hashes of its words fall on."""
        out = np.empty((len(self.at), bits // 64), np.uint64)
        step = (1 << 25) // bits
        for k in range(0, len(out), step):
            part = slice(self.starts[k], self.starts[k + step] if k + step < len(out) else None)
            on = np.zeros((min(step, len(out) - k), bits), bool)
            on[self.rows[part] - k, (self.words[part] >> 32) & (bits - 1)] = True
            out[k : k + step] = np.packbits(on, axis=1).view(np.uint64)
        return out


def _prefixes(a: Side, fits: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, int]]:
    """Of each row that fits: buckets of its prefix, how often it has them, how often they are known, and how much of the prefix a match shares at least."""
    chunk = (a.starts // CHUNK_WORDS).astype(np.int64)
    for k in range(int(chunk[-1]) + 1):
        start, end = np.searchsorted(chunk, [k, k + 1])
        if not fits[start:end].any():
            continue
        part = slice(a.starts[start], a.starts[end] if end < len(a.at) else None)
        own = np.flatnonzero(fits[start:end][a.rows[part] - start])
        buckets, counts, rows = a.buckets[part][own], a.counts[part][own], a.rows[part][own] - start
        known = first[buckets + 1] - first[buckets]
        order = np.argsort(rows.astype(np.int64) << 32 | (known / counts).astype(np.float32).view(np.int32))
        buckets, counts, known = buckets[order], counts[order], known[order]
        begin = np.searchsorted(rows, np.arange(end - start))[rows]
        before, cost = (np.cumsum(x) - x for x in (counts, known))
        before, cost, spare = before - before[begin], cost - cost[begin], a.spare[start:end]
        least = before <= spare[rows]
        # A longer prefix costs more counting and leaves fewer rows to count in full.
        most = 3 * np.bincount(rows, known * least, end - start) + LONGER * a.sizes[start:end]
        prefix = least | (cost + known <= most[rows])
        buckets, counts, known, rows = buckets[prefix], counts[prefix], known[prefix], rows[prefix]
        need = np.bincount(rows, counts, end - start) - spare
        ends = np.searchsorted(rows, np.arange(end - start + 1))
        for row in np.flatnonzero(np.bincount(rows, known, end - start)):
            words = slice(ends[row], ends[row + 1])
            yield int(start + row), buckets[words], counts[words], known[words], need[row]


def _matches(a: Side, b: Side) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of ``a`` with the rows of ``b`` that it matches, if any.  Words count by bucket, which finds too many rows, until the last step."""
    low, high = np.searchsorted(b.sizes, a.sizes - a.spare), np.searchsorted(b.sizes, (4 * a.n - 1) // 3, side="right")
    fits = low < high
    if not fits.any():
        return
    holders = b.rows[np.argsort(b.buckets, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(b.buckets, minlength=BUCKETS))])
    bits = 1 << int(np.clip(np.log2(8 * len(b.words) / len(b.at)), 9, 16))
    signs, word, weight = b.signs(bits), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int32)
    for row, buckets, counts, known, need in _prefixes(a, fits, first):
        at = a.of(row)
        met = holders[_ranges(first[buckets], known)]
        shared = np.bincount(met, np.repeat(counts, known), len(b.at))[low[row] : high[row]]
        found = np.flatnonzero(shared >= need) + low[row]
        if len(found):
            on = np.zeros(bits, bool)
            on[(a.words[at] >> 32) & (bits - 1)] = True
            found = found[np.bitwise_count(np.packbits(on).view(np.uint64) & ~signs[found]).sum(axis=1) <= a.spare[row]]
        if not len(found):
            continue
        # A word found in another's place by bucket is counted by itself.
        word[a.buckets[at]], weight[a.buckets[at]] = a.words[at], a.counts[at]
        twins = np.flatnonzero(word[a.buckets[at]] != a.words[at])
        full = [np.empty(0, np.int64)]
        for some in np.array_split(found, -(-int(b.sizes[found].sum()) // 2_000_000)):
            size = b.sizes[some]
            here = _ranges(b.starts[some], size)
            near, words = b.buckets[here], b.words[here]
            times = np.where(word[near] == words, weight[near], 0)
            for k in twins:
                times[words == a.words[at][k]] += a.counts[at][k]
            full.append(some[4 * np.add.reduceat(times, np.cumsum(size) - size) > 3 * np.maximum(a.n[row], size)])
        weight[a.buckets[at]] = 0
        found = np.concatenate(full)
        if len(found):
            yield row, found


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hashes) -> (id, distinct hashes, counts)"""
    for batch in batches:
        pairs = [np.unique(h.values.to_numpy(), return_counts=True) for h in batch.column(1)]
        lists = [pa.array([p[k] for p in pairs], pa.list_(kind)) for k, kind in ((0, pa.int64()), (1, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["id", "words", "counts"])


def _pairs(table: pa.Table, one: bool) -> Iterator[pa.Table]:
    """Matches within one block, or between two in both directions."""
    table = table.combine_chunks()
    ids, block = table["id"].combine_chunks(), table["block"].to_numpy()
    lists, counts = table["words"].combine_chunks(), table["counts"].combine_chunks().flatten().to_numpy()
    sizes, words = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
    starts = np.cumsum(sizes) - sizes
    sides = [Side(words, counts, starts, sizes, np.flatnonzero(block == b)) for b in np.unique(block)]
    del words, counts, lists, starts, sizes, table
    for a, b in [(sides[0], sides[0])] if one else [(sides[0], sides[1]), (sides[1], sides[0])] if len(sides) == 2 else []:
        left, right, n = [], [], 0
        for row, found in _matches(a, b):
            met = b.at[found[found != row]] if one else b.at[found]
            left.append(np.full(len(met), a.at[row]))
            right.append(met)
            n += len(met)
            if n > 1_000_000:
                yield pa.table({"a": ids.take(pa.array(np.concatenate(left))), "b": ids.take(pa.array(np.concatenate(right)))})
                left, right, n = [], [], 0
        if n:
            yield pa.table({"a": ids.take(pa.array(np.concatenate(left))), "b": ids.take(pa.array(np.concatenate(right)))})


def _dealt(lists: DataFrame, n: int) -> DataFrame:
    """The lists with a block each: n blocks of about as many words, by the number of distinct words, and by hash among those of one class of sizes."""
    classes = F.floor(F.log2(F.size("words")) * SIZE_CLASSES).cast("int")
    words = sorted(map(tuple, lists.groupBy(classes.alias("c")).agg(F.sum(F.size("words"))).collect()))
    ends = np.cumsum([w for _, w in words]).tolist()
    pick = lambda values: F.element_at(F.create_map(*[F.lit(x) for c, v in zip((c for c, _ in words), values) for x in (c, float(v))]), classes) if words else F.lit(0.0)
    spread = F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20)
    place = (pick([e - w for e, (_, w) in zip(ends, words)]) + spread * pick([w for _, w in words])) * n / float(ends[-1] if words else 1)
    return lists.withColumn("block", F.least(F.floor(place), F.lit(n - 1)).cast("int"))


def title_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """(a, b, link): ``class`` from each id to the least id of equal normalised text, ``match`` from each such representative to each other one it matches."""
    n = max(least_blocks, -(-docs.count() // block_rows))
    rows = docs.select(F.col(id_col).alias("id"), C.normalize_title(F.col(text_col)).alias("t")).filter("id is not null").withColumn("key", F.sha2("t", 256))
    classes = rows.select("id", "key").groupBy("key").agg(F.min("id").alias("first"))
    members = rows.select("id", "key").join(classes, "key").select(F.col("id").alias("a"), F.col("first").alias("b"), F.lit("class").alias("link"))
    shown = rows.filter(F.length("t") >= K.TITLE_FLOOR).join(classes.select(F.col("first").alias("id"), "key"), ["id", "key"], "left_semi")
    hashed = shown.select("id", F.transform(F.split("t", " "), lambda w: F.xxhash64(w)).alias("hashes"))
    counted = hashed.mapInArrow(_counted, T.StructType([hashed.schema["id"], T.StructField("words", T.ArrayType(T.LongType())), T.StructField("counts", T.ArrayType(T.IntegerType()))]))
    kind = hashed.schema["id"].dataType
    conf = docs.sparkSession.conf
    before = conf.get(CLEANED, None)
    conf.set(CLEANED, "true")
    try:
        lists = durable(counted, "word-lists")
        n = max(n, -(-(lists.agg(F.sum(F.size("words"))).first()[0] or 0) // BLOCK_WORDS))
        lists = _dealt(lists, n)
        met = [durable(_round(lists, n, k, kind), "links") for k in range(n // 2 + 1)]
    finally:
        conf.unset(CLEANED) if before is None else conf.set(CLEANED, before)
    return members.unionByName(reduce(DataFrame.unionByName, met).withColumn("link", F.lit("match")))


def _round(lists: DataFrame, n: int, k: int, kind: T.DataType) -> DataFrame:
    """(a, b): the matches of each block with the one ``k`` further, of ``n`` in a ring."""

    def within(table: pa.Table) -> pa.Table:
        empty = pa.table({"a": table["id"].slice(0, 0), "b": table["id"].slice(0, 0)})
        return pa.concat_tables([empty, *_pairs(table, k == 0)])

    block, back = F.col("block"), F.pmod(F.col("block") - k, F.lit(n))
    cells = F.array(block) if k == 0 else F.array(F.least(block, back)) if 2 * k == n else F.array(block, back)
    return lists.withColumn("cell", F.explode(cells)).groupBy("cell").applyInArrow(within, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))
