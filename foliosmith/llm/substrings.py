"""Substring deduplication by FM-indexes over content-defined shards.

A window is ``length`` consecutive words of one text; a word goes if a window over it has the same words as a window that starts earlier
(smaller id, or the same text and an earlier start), all judged on the input.

1. Runs: each window belongs to the least hash among its ``GRAM``-word grams, so equal windows have equal minimizers.  Consecutive windows of one minimizer form a run.
   What repeats within a text, or as a whole run within a task's batch, is settled on the spot; only first copies go on.
2. Sorted streams by minimizer keep every run, also those of one text, whose minimizer several texts have.  Where very many have it, their windows go on one by one; a minimizer that
   a task sees very often does not enter those streams, so a passage that many texts have in differing surroundings is no hot key.
3. The words of those runs come from the texts, as 32-bit codes, and are dealt to shards by minimizer (single windows: by their own hash).  Whole copies are settled by sorting.
4. Each shard of about ``SHARD`` words gets a compressed FM-index: backward search over its wavelet matrix gives each window's matching statistics and
   suffix interval; a window goes if its interval holds an earlier start.  Intervals of words above the threshold go back to their texts.

So a text meets only shards that can match it, and cost stays in proportion to the input.  No group is held in full: streams hold at most a shard, and of equal windows
a task's batch ships the words once.  Words are told apart by 64-bit hashes, within a minimizer's or window's shard by 32 bits of them.  Defined results: null and empty texts have no words; rows with a null id lose only
what repeats within them and remove nothing elsewhere; an id names one text (repeated rows are the same place); an empty input gives an empty output; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .fmindex import FMIndex
from .ngramjoin import shingle_lists
from .storage import frugal, small_or_not, written
from .words import _power, gram_hashes, gram_valid, mix, word_chunks, word_hashes

GRAM, SHARD, LONGEST, MOST_RUN = 6, 150_000, 1_000, 1_000
#: A minimizer that so many of ``STRETCH`` runs in a row have is hot.
HOT, STRETCH = 128, 250_000
_RUN_BASE = 0xD6E8FEB86659FD93
_RUN_UNBASE = pow(_RUN_BASE, -1, 1 << 64)


def span_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the words of each span."""
    total = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * _power(_RUN_BASE, len(words)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_RUN_UNBASE, len(words) + 1)[starts])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    now, have = values, 1
    while have < width:
        by = min(have, width - have)
        now = np.minimum(now[:-by], now[by:])
        have += by
    return now


def _runs(mask: np.ndarray, owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, size) of runs of consecutive set positions of one owner and value, of at most MOST_RUN."""
    at = np.flatnonzero(mask)
    if not len(at):
        return at, at
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]) | (value[at[1:]] != value[at[:-1]])])
    begin = np.flatnonzero(new)
    within = np.arange(len(at)) - np.repeat(begin, np.diff(np.concatenate([begin, [len(at)]])))
    new |= within % MOST_RUN == 0
    begin = np.flatnonzero(new)
    return at[begin], np.diff(np.concatenate([begin, [len(at)]]))


def find_runs(ids: pa.Array, texts: pa.Array, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(gone, minimizer, id, start, windows, run hash) of all runs of each chunk of a batch; ``gone``: its windows repeat earlier ones of the same text."""
    keys = ids.to_numpy(zero_copy_only=False)
    for chunk in word_chunks(texts):
        words = word_hashes(chunk)
        if len(words) < length:
            continue
        valid = gram_valid(chunk, length)
        least = sliding_min(gram_hashes(words, GRAM), length - GRAM + 1)
        owner = np.repeat(np.arange(chunk.hi - chunk.lo), np.diff(chunk.first))[: len(valid)]
        starts = np.arange(len(valid))
        whole = span_hashes(words, starts, starts + length) ^ mix(owner.astype(np.uint64) + np.uint64(77))
        at = np.flatnonzero(valid)
        _, first = np.unique(whole[at], return_index=True)
        fresh = np.zeros(len(valid), dtype=bool)
        fresh[at[first]] = True
        for gone, mask, value in ((False, fresh, least), (True, valid & ~fresh, np.zeros(len(valid), np.uint64))):
            begin, size = _runs(mask, owner, value)
            text = owner[begin]
            yield np.full(len(begin), gone), value[begin].view(np.int64), keys[chunk.lo + text].astype(np.int64), begin - chunk.first[text], size, span_hashes(words, begin, begin + size + length - 1)


def _later_copies(hashes: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which entries have an equal hash at an earlier place; entries of one place are none to each other."""
    order = np.lexsort((starts, ids, hashes))
    new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])[: len(order)]
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.zeros(len(hashes), dtype=bool)
    later[order] = (ids[order] != ids[head]) | (starts[order] != starts[head])
    return later


def runs_of(docs: DataFrame, length: int) -> DataFrame:
    """(gone, minimizer, doc_id, start, windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(find_runs(batch.column(0), batch.column(1), length))
            if not found:
                continue
            gone, least, ids, starts, sizes, hashes = (np.concatenate(x) for x in zip(*found))
            live = np.flatnonzero(~gone)
            gone[live] = _later_copies(hashes[live], ids[live], starts[live])
            yield pa.RecordBatch.from_arrays([pa.array(gone), pa.array(least), pa.array(ids), pa.array(starts.astype(np.int32)), pa.array(sizes.astype(np.int32))], names=["gone", "minimizer", "doc_id", "start", "windows"])

    return docs.filter("doc_id is not null").mapInArrow(frugal(run), "gone boolean, minimizer long, doc_id long, start int, windows int")


def hot_minimizers(runs: DataFrame) -> DataFrame:
    """The minimizers that are hot in some stretch of the runs; each counts as hot for all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value[count >= HOT])], names=["minimizer"])

        for batch in batches:
            held.append(batch.column(0).to_numpy())
            size += batch.num_rows
            if size >= STRETCH:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    return runs.filter("not gone").select("minimizer").mapInArrow(frugal(run), "minimizer long").distinct()


def _segments(length: int):
    """From (doc_id, text, runs) rows to (key, hash, doc_id, start, windows, codes); codes is null where the run is settled: a later copy within the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            codes: list[bytes] = []
            lists = batch.column(2)
            for text, chunk in ((k, c) for lo in range(batch.num_rows) for k, c in ((lo, c) for c in word_chunks(batch.column(1).slice(lo, 1)))):
                words = word_hashes(chunk)
                flat = lists[text].values
                info, least, alone = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                start, size = info >> 22, (info & ((1 << 22) - 1)) >> 1
                count = np.where(alone, size, 1)
                inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                alone, least = np.repeat(alone, count), np.repeat(least, count)
                start, size = np.repeat(start, count) + inner, np.where(alone, 1, np.repeat(size, count))
                hashes = span_hashes(words, start, start + size + length - 1)
                parts.append((np.where(alone, hashes.view(np.int64), least), hashes, np.full(len(start), batch.column(0)[text].as_py()), start, size))
                small = words.astype(np.uint32)
                codes += [small[a : a + n + length - 1].tobytes() for a, n in zip(start.tolist(), size.tolist())]
            if not parts:
                continue
            key, hashes, ids, start, size = (np.concatenate(x) for x in zip(*parts))
            later = _later_copies(hashes, ids, start)
            key = np.where(later, mix(ids.astype(np.uint64) + start.astype(np.uint64) * np.uint64(1 << 40)).view(np.int64), key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(hashes.view(np.int64)), pa.array(ids), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array([None if gone else c for gone, c in zip(later.tolist(), codes)], pa.binary())],
                names=["key", "hash", "doc_id", "start", "windows", "codes"],
            )

    return run


def search_shard(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, start, windows) of the runs of windows in a shard of distinct segments that have an earlier occurrence in it."""
    names, dense = np.unique(np.concatenate(codes), return_inverse=True)
    edges = np.cumsum([len(c) for c in codes])
    index = FMIndex(np.split(dense + 1, edges[:-1]))
    segment = np.repeat(np.arange(len(ids)), sizes)
    inner = np.arange(len(segment)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    begin = (edges - [len(c) for c in codes] + np.arange(len(codes)))[segment] + inner
    place = starts[segment] + inner
    rank = np.empty(len(segment), dtype=np.int64)
    order = np.lexsort((place, ids[segment]))
    rank[order] = np.concatenate([[0], np.cumsum((np.diff(ids[segment][order]) != 0) | (np.diff(place[order]) != 0))])
    at, low, high = index.repeated(begin + length - 1, length)
    if not len(at):
        return at, at, at
    by_text = np.full(len(index.text), np.iinfo(np.int64).max)
    by_text[begin] = rank
    by_suffix = np.append(by_text[index.suffixes], np.iinfo(np.int64).max)
    lows, where = np.unique(low, return_inverse=True)
    highs = np.zeros(len(lows), dtype=np.int64)
    highs[where] = high
    first = np.minimum.reduceat(by_suffix, np.column_stack([lows, highs]).ravel())[::2]
    gone = np.zeros(len(segment), dtype=bool)
    gone[at] = first[where] < rank[at]
    head, size = _runs(gone, segment, np.zeros(len(segment), np.int64))
    return ids[segment[head]], place[head], size


def _shards(length: int, shard: int):
    """Over segments sorted by (key, hash, doc_id, start): the runs of windows to remove."""

    def rows(ids, starts, sizes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)), pa.array(np.asarray(starts, np.int64)), pa.array(np.asarray(sizes, np.int64))], names=["doc_id", "start", "windows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, sizes, codes, total, last, place = [], [], [], [], 0, (None, None), (None, None)
        for batch in batches:
            gone: tuple[list, list, list] = ([], [], [])
            for key, mark, doc, start, size, code in zip(*(batch.column(k).to_pylist() for k in range(5)), batch.column(5)):
                if (key, mark) == last and (doc, start) == place:
                    continue
                if not code.is_valid or (key, mark) == last:
                    for column, value in zip(gone, (doc, start, size)):
                        column.append(value)
                    continue
                if total >= shard and key != last[0]:
                    yield rows(*search_shard(np.array(ids), np.array(starts), np.array(sizes), codes, length))
                    ids, starts, sizes, codes, total = [], [], [], [], 0
                last, place = (key, mark), (doc, start)
                ids.append(doc)
                starts.append(start)
                sizes.append(size)
                codes.append(np.frombuffer(code.as_py(), dtype=np.uint32))
                total += len(codes[-1])
            if gone[0]:
                yield rows(*gone)
        if ids:
            yield rows(*search_shard(np.array(ids), np.array(starts), np.array(sizes), codes, length))

    return run


def repeated_windows(docs: DataFrame, length: int = 20, shard: int = SHARD) -> DataFrame:
    """(doc_id, start, windows): runs of windows of (doc_id, text) rows that repeat earlier ones."""
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = written(runs_of(docs, length), "runs")
    live = runs.filter("not gone").select(F.col("minimizer").alias("shingle"), F.col("doc_id").alias("group_id"), F.shiftleft(F.col("start").cast("long"), 22).bitwiseOR(F.shiftleft(F.col("windows").cast("long"), 1)).alias("info"))
    hot = small_or_not(written(hot_minimizers(runs), "hot").withColumnRenamed("minimizer", "shingle"))
    met = written(shingle_lists(live.join(hot, "shingle", "left_anti"), LONGEST, every=True).unionByName(live.join(hot, "shingle", "left_semi").withColumn("long", F.lit(True))), "met")
    by_doc = met.groupBy(F.col("group_id").alias("doc_id")).agg(F.collect_list(F.struct("info", "shingle", "long")).alias("runs"))
    segments = docs.join(by_doc, "doc_id").select("doc_id", "text", "runs").mapInArrow(frugal(_segments(length)), "key long, hash long, doc_id long, start int, windows int, codes binary")
    found = segments.repartition(count, "key").sortWithinPartitions("key", "hash", "doc_id", "start").mapInArrow(frugal(_shards(length, shard)), "doc_id long, start long, windows long")
    return found.unionByName(runs.filter("gone").select("doc_id", F.col("start").cast("long").alias("start"), F.col("windows").cast("long").alias("windows")))


def deduplicate(docs: DataFrame, length: int = 20, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept) of every row; removed: (start, end) word spans in order; kept: its words joined by blanks."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    gone = repeated_windows(rows, length, shard).groupBy("doc_id").agg(F.collect_list(F.struct("start", (F.col("start") + F.col("windows") + length - 1).alias("end"))).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                words, removed, spans, kept = [], [], [], []
                for doc, text, gone in zip(*part.columns):
                    found = (text.as_py() or "").encode().split()
                    merged: list[list[int]] = []
                    if not doc.is_valid:
                        lost = [(a, a + n + length - 1) for again, _, _, start, size, _ in find_runs(pa.array([0]), pa.array([text.as_py()], pa.string()), length) for a, n in zip(start[again].tolist(), size[again].tolist())]
                    else:
                        lost = zip(gone.values.field(0).to_pylist(), gone.values.field(1).to_pylist()) if gone.is_valid else []
                    for a, b in sorted(lost):
                        if merged and a <= merged[-1][1]:
                            merged[-1][1] = max(b, merged[-1][1])
                        else:
                            merged.append([a, b])
                    words.append(len(found))
                    removed.append(sum(b - a for a, b in merged))
                    spans.append([{"start": a, "end": b} for a, b in merged])
                    edges = [0, *[x for m in merged for x in m], len(found)]
                    kept.append(b" ".join([w for a, b in zip(edges[::2], edges[1::2]) for w in found[a:b]]).decode())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "removed", "kept"])

    return rows.join(gone, "doc_id", "left").select("doc_id", "text", "gone").mapInArrow(frugal(run), "doc_id long, n_words long, n_removed long, removed array<struct<start:long,end:long>>, kept string")
