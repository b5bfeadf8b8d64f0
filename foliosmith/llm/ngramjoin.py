"""N-gram Jaccard join by grouped prefixes.

A text's set is the distinct ``n``-word shingles of its words (A-Z folded); with fewer words, the whole sequence as one.  Texts link when
100 * intersection >= percent * union.  Steps, each a table in the shared folder:

1. Hot shingles: those that many texts have among their first by hash.  They come last in the global order (hot or not, hash),
   so that lists of a shingle stay short.  At most ``most_hot`` of them are sent to the tasks; the result is the same with any hot set.
2. Each text becomes (id, set size, digest of the set, prefix); equal digests form a class, classes with equal size and prefix form a group.
   With an overlap of at least o = ceil(percent * size / 100), prefixes of size - o + ELL shingles share ELL shingles.
3. Pairs of groups (and a group with itself) that share ELL prefix shingles and fit in size and position are expanded to their classes.
   A shingle that more than ``longest`` groups have in their prefix, or a group of very many classes, goes another way: its list of classes.
4. Pairs are verified on the whole sets, computed anew for the classes that need it: first each class with its least partner and each class of a
   long list with the list's least, then only what those links have not joined yet, as the rest can't change a component.  What a long list still has apart
   is dealt into blocks by a hash; the classes of its most frequent component meet the others only, and a block pair gives back a forest of its links.

So no pair of equal texts is made, nothing is dropped, and no task holds more than two blocks of a list.  Classes of a list that are in no
component with its many are compared with all of the list: where texts share a rare passage but are no near copies, that work is the square of their number.
Sets are compared by 64-bit hashes of their shingles.

Defined results: null, empty and blank texts have an empty set, size 0, and link with nothing, as do rows with a null id; repeated
rows are in one class (an id names one text) and count as one posting and one set; an empty input gives an empty output; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .components import connected_components, near_roots
from .storage import frugal, small_or_not, written
from .words import gram_hashes, word_chunks, word_hashes

ELL = 3
BLOCK_HASHES = 1_000_000
#: A class that is first in more pairs is a hub, and its set is shipped under so many salts.
HUB, SALTS = 256, 64


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for chunk in word_chunks(column, lower=True):
        words = word_hashes(chunk)
        for lo, hi in zip(chunk.first, chunk.first[1:]):
            yield np.unique(gram_hashes(words[lo:hi], min(n, int(hi - lo)))) if hi > lo else words[:0]


def least_overlap(size: int, percent: int) -> int:
    """The least intersection of a set of this size with any set it links with."""
    return -(-percent * size // 100)


def prefix_length(size: int, percent: int) -> int:
    return min(size, size - least_overlap(size, percent) + ELL) if size else 0


def hot_shingles(docs: DataFrame, n: int, percent: int, hot: int, most_hot: int, text_col: str) -> np.ndarray:
    """The shingles that at least ``hot`` texts have in the first part of their hash order, the most frequent first where they are too many; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            value, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count)], names=["shingle", "texts"])

        for batch in batches:
            for found in shingle_sets(batch.column(0), n):
                held.append(found[: prefix_length(len(found), percent)])
                size += len(held[-1])
                if size > 1_000_000:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    counts = docs.select(F.col(text_col)).mapInArrow(frugal(run), "shingle long, texts long").groupBy("shingle").agg(F.sum("texts").alias("texts")).filter(F.col("texts") >= hot)
    counts = written(counts, "hot")
    least = hot
    while counts.filter(F.col("texts") >= least).count() > most_hot:
        least *= 2
    found = counts.filter(F.col("texts") >= least).select("shingle").toArrow().column(0).to_numpy()
    return np.sort(found.astype(np.int64).view(np.uint64))


def described(docs: DataFrame, n: int, percent: int, hot: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, size, digest, mark, prefix) of every row; mark stands for the prefix; digest is null where the row links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sizes, digests, marks, prefixes = [], [], [], []
                for key, found in zip(part.column(0), shingle_sets(part.column(1), n)):
                    sizes.append(len(found))
                    if not len(found) or not key.is_valid:
                        for column in (digests, marks, prefixes):
                            column.append(None)
                        continue
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    at = np.searchsorted(hot, found)
                    late = (at < len(hot)) & (hot[np.minimum(at, len(hot) - 1)] == found) if len(hot) else np.zeros(len(found), bool)
                    prefixes.append(np.concatenate([found[~late], found[late]])[: prefix_length(len(found), percent)].view(np.int64))
                    marks.append(hashlib.blake2b(prefixes[-1].tobytes(), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(marks, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))], names=["doc_id", "size", "digest", "mark", "prefix"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(frugal(run), "doc_id long, size long, digest binary, mark binary, prefix array<long>")


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets of distinct hashes."""
    return len(np.intersect1d(a, b, assume_unique=True))


def unpack(raw: pa.Buffer) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint64)


def sets_of(docs: DataFrame, wanted: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """(class_id, shingles as sorted 64-bit hashes) of the wanted ids, one row an id; only sets of ids that come again are shuffled for that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), n)], pa.binary())], names=["class_id", "shingles"])

    rows = docs.select(F.col(id_col).cast("long").alias("class_id"), F.col(text_col).alias("__text")).join(small_or_not(wanted), "class_id", "left_semi")
    sets = written(rows.select("class_id", "__text").mapInArrow(frugal(run), "class_id long, shingles binary"), "sets")
    again = written(sets.groupBy("class_id").agg(F.count("*").alias("n")).filter("n > 1").select("class_id"), "again")
    if again.isEmpty():
        return sets
    few = small_or_not(again)
    one = sets.join(few, "class_id", "left_semi").groupBy("class_id").agg(F.min("shingles").alias("shingles"))
    return written(sets.join(few, "class_id", "left_anti").unionByName(one), "sets")


def shingle_lists(postings: DataFrame, longest: int, every: bool = False) -> DataFrame:
    """(shingle, group_id, info, long) of the shingles that several groups have, or one group of several classes; one row for each group, however many rows its id has,
    or ``every`` row where the rows of a group differ.

    Sorted streams: a list is held only up to ``longest`` rows; from then on its rows pass through, marked long.
    """
    names = ["shingle", "group_id", "info", "long"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mark, passed, seen = [], None, False, None

        def out(parts: list, flag: bool) -> pa.RecordBatch:
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*whole.columns, pa.array(np.full(whole.num_rows, flag))], names=names)

        def lone(part: pa.RecordBatch) -> np.ndarray:
            return (part.column(2).to_numpy() & 1) == 0

        def shared(parts: list) -> bool:
            return bool(parts) and (parts[0].column(1)[0].as_py() != parts[-1].column(1)[-1].as_py() or not lone(parts[0]).all())

        for batch in batches:
            keys, owners = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            fresh = np.concatenate([[(keys[0], owners[0]) != seen], (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])])
            seen = keys[-1], owners[-1]
            if not every and not fresh.all():
                batch = batch.filter(pa.array(fresh))
                keys, owners = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                if not len(keys):
                    continue
            cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            low, high = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            if mark is not None and keys[0] != mark:
                if shared(held):
                    yield out(held, False)
                held, passed = [], False
            ends = high - low
            inner = np.ones(len(low), dtype=bool)
            inner[-1] = False
            if held or passed:
                inner[0] = False
            several = owners[low] != owners[high - 1]
            lists = inner & (ends <= longest) & (several | ~lone(batch)[low])
            far = inner & (ends > longest) & several
            for which, flag in ((lists, False), (far, True)):
                if which.any():
                    yield out([batch.filter(pa.array(np.repeat(which, ends)))], flag)
            for k in sorted({0, len(low) - 1} - set(np.flatnonzero(inner).tolist())):
                if mark is not None and keys[low[k]] != mark:
                    if shared(held):
                        yield out(held, False)
                    held, passed = [], False
                mark = keys[low[k]]
                held.append(batch.slice(int(low[k]), int(ends[k])))
                if passed or sum(p.num_rows for p in held) > longest:
                    yield out(held, True)
                    held, passed = [], True
            mark = keys[-1]
        if shared(held):
            yield out(held, False)

    count = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return postings.select(*names[:3]).repartition(count, "shingle").sortWithinPartitions("shingle", "group_id").mapInArrow(frugal(run), "shingle long, group_id long, info long, long boolean")


def group_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(a, b) group ids that share ELL prefix shingles and whose sizes and positions allow a link; a = b for a group of several classes."""
    parts = lists.select("shingle", "group_id", F.shiftright("info", 32).alias("size"), F.shiftright("info", 1).bitwiseAND(F.lit((1 << 31) - 1)).alias("at"), F.col("info").bitwiseAND(F.lit(1)).alias("several"))
    side = lambda s: parts.select("shingle", *[F.col(c).alias(f"{c}_{s}") for c in ("group_id", "size", "at", "several")])
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    need = F.ceil(F.lit(percent) * (F.col("size_a") + F.col("size_b")) / F.lit(100.0 + percent))
    bound = F.least("at_a", "at_b") + 1 + F.least(F.col("size_a") - F.col("at_a") - 1, F.col("size_b") - F.col("at_b") - 1)
    ordered = (F.col("group_id_a") < F.col("group_id_b")) | ((F.col("group_id_a") == F.col("group_id_b")) & (F.col("several_a") > 0))
    met = side("a").join(side("b"), "shingle").filter(ordered & (F.lit(100) * small >= F.lit(percent) * large) & (bound >= need))
    counted = met.groupBy(F.col("group_id_a").alias("a"), F.col("group_id_b").alias("b")).agg(F.count("*").alias("shared"), F.min(need).alias("need"))
    return counted.filter(F.col("shared") >= F.least(F.lit(ELL), F.col("need"))).select("a", "b")


def _verify_pairs(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.zeros(batch.num_rows, dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = unpack(x.as_buffer()), unpack(y.as_buffer())
                inter = shared(a, b)
                good[k] = 100 * inter >= percent * (len(a) + len(b) - inter)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    return run


def intersections(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of the sets numbered ``rows`` with those numbered ``columns``, by products of incidence matrices of ``width`` hashes."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = count[column] > 1
    owner, column = owner[several], column[several]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(rows), len(columns)), dtype=np.float64)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[owner[a:b], column[a:b] - lo] = 1
        total += part[rows] @ part[columns].T
    return total.astype(np.int64)


def _forest(ids: np.ndarray, linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of a symmetric link matrix."""
    todo = np.ones(len(ids), dtype=bool)
    for start in range(len(ids)):
        if not todo[start]:
            continue
        todo[start] = False
        stack = [start]
        while stack:
            at = stack.pop()
            for other in np.flatnonzero(linked[at] & todo):
                todo[other] = False
                stack.append(int(other))
                yield int(ids[at]), int(ids[other])


def _verify_blocks(percent: int):
    """From rows sorted by cell and class: links that join the classes of each cell as all its links do.  In a cell of both, the classes
    marked ``joined`` are in one component, so only the others are compared, and with one of those at most one link comes back."""

    def one(rows: pa.Table) -> list[tuple[int, int]]:
        ids, at = np.unique(rows.column("class_id").to_numpy(), return_index=True)
        if len(ids) < 2:
            return []
        joined = rows.column("joined").to_numpy()[at]
        column = rows.column("shingles").combine_chunks()
        sets = [unpack(column[int(k)].as_buffer()) for k in at]
        sizes = np.array([len(s) for s in sets])
        some = np.flatnonzero(~joined)
        against = np.flatnonzero(joined) if joined.any() else some
        inter = intersections(sets, some, against)
        linked = 100 * inter >= percent * (sizes[some][:, None] + sizes[against][None, :] - inter)
        if not joined.any():
            return list(_forest(ids, linked))
        met = np.flatnonzero(linked.any(axis=1))
        return [(int(ids[some[k]]), int(ids[against[linked[k].argmax()]])) for k in met]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mark = [], None

        def out() -> pa.RecordBatch:
            found = one(pa.Table.from_batches(held)) if held else []
            a, b = zip(*found) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if mark is not None and keys[lo] != mark:
                    yield out()
                    held = []
                mark = keys[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield out()

    return run


def cells(lists: DataFrame) -> DataFrame:
    """(key, class_id, size): groups that hold every pair of classes that a list holds.

    Lists that share classes overlap.  Each list takes the least class that a list of its least class has as its own least one, and lists that agree are one
    group, unless that group has more pairs than those lists together.
    """
    centre = written(lists.groupBy("shingle").agg(F.min("class_id").alias("centre")), "centres")
    by_class = lists.join(centre, "shingle").groupBy("class_id").agg(F.min("centre").alias("first"))
    whole = written(lists.join(written(by_class, "first"), "class_id").groupBy("shingle").agg(F.min("first").alias("whole"), F.count("*").alias("n")), "wholes")
    rows = lists.join(whole.select("shingle", "whole"), "shingle")
    merged = rows.select("whole", "class_id", "size").distinct()
    merged = written(merged, "merged")
    better = merged.groupBy("whole").agg(F.count("*").alias("m")).join(whole.groupBy("whole").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("by_lists")), "whole")
    better = written(better.select("whole", (F.col("m").cast("double") * F.col("m") <= F.col("by_lists")).alias("merge")), "better")
    one = merged.join(better.filter("merge"), "whole", "left_semi").select(F.xxhash64(F.lit(1), "whole").alias("key"), "class_id", "size")
    each = rows.join(better.filter("not merge"), "whole", "left_semi").select(F.xxhash64(F.lit(0), "shingle").alias("key"), "class_id", "size")
    return one.unionByName(each)


def block_links(lists: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, block: int) -> DataFrame:
    """Links among the classes of long lists (shingle, class_id, size) that roots (id, root) have not joined yet.

    In each group that has several roots, the classes of the most frequent root are joined already: they meet the other classes only, and those meet each other.
    """
    spark = lists.sparkSession
    keyed = written(cells(lists), "cells").join(roots.select(F.col("id").alias("class_id"), "root"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    keyed = written(keyed, "keyed")
    counts = keyed.groupBy("key", "root").agg(F.count("*").alias("texts"), F.sum("size").alias("hashes"))
    most = F.max_by(F.struct("root", "texts", "hashes"), F.struct("texts", "root")).alias("most")
    per_key = counts.groupBy("key").agg(most, F.sum("texts").alias("texts"), F.sum("hashes").alias("hashes"), F.count("*").alias("n")).filter("n > 1")
    blocks = lambda texts, hashes: F.greatest(F.ceil(texts / block), F.ceil(hashes / BLOCK_HASHES), F.lit(1)).cast("int")
    plans = written(per_key.select(
        "key", F.col("most.root").alias("bulk"), blocks(F.col("most.texts"), F.col("most.hashes")).alias("nb"),
        blocks(F.col("texts") - F.col("most.texts"), F.col("hashes") - F.col("most.hashes")).alias("nr"),
    ), "plans")
    rows = keyed.join(plans, "key").withColumn("joined", F.col("root") == F.col("bulk"))
    own = F.pmod(F.xxhash64("class_id"), F.when(F.col("joined"), F.col("nb")).otherwise(F.col("nr"))).cast("int")
    with_bulk = F.transform(F.sequence(F.lit(0), F.when(F.col("joined"), F.col("nr")).otherwise(F.col("nb")) - 1), lambda k: F.when(F.col("joined"), F.xxhash64("key", F.lit(0), own, k)).otherwise(F.xxhash64("key", F.lit(0), k, own)))
    among = F.transform(F.sequence(F.lit(0), F.col("nr") - 1), lambda k: F.xxhash64("key", F.lit(1), F.least(own, k), F.greatest(own, k)))
    dealt = rows.select("class_id", "joined", F.explode(F.when(F.col("joined"), with_bulk).otherwise(F.concat(with_bulk, among))).alias("cell"))
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shown = dealt.join(sets, "class_id").repartition(count, "cell").sortWithinPartitions("cell", "class_id").select("cell", "class_id", "joined", "shingles")
    return shown.mapInArrow(frugal(_verify_blocks(percent)), "a long, b long")


def _with_sets(some: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shingles_a, shingles_b) of pairs of classes.  The set of a class that very many pairs have first is repeated by salt, so that its pairs are dealt out."""
    hubs = small_or_not(written(some.groupBy("a").agg(F.count("*").alias("n")).filter(F.col("n") > HUB).select("a", F.lit(SALTS).alias("salts")), "hubs"))
    first = sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("shingles_a")).join(hubs, "a", "left").select("a", "shingles_a", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    pairs = some.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    second = sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("shingles_b"))
    return pairs.join(first, ["a", "salt"]).join(second, "b").select("a", "b", "shingles_a", "shingles_b")


def links(docs: DataFrame, rows: DataFrame, n: int, percent: int, longest: int, block: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(classes with their digests, links between classes that keep the components)."""
    classes = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min("size").alias("size"), F.min("mark").alias("mark"))
    classes = written(classes, "classes")
    groups = written(classes.groupBy("mark", "size").agg(F.min("class_id").alias("group_id"), F.count("*").alias("members")), "groups")
    members = written(classes.join(groups.select("mark", "size", "group_id"), ["mark", "size"]).select("group_id", "class_id"), "members")
    prefixes = rows.filter("digest is not null").select(F.col("doc_id").alias("group_id"), "size", "prefix").join(small_or_not(groups.select("group_id", "members")), "group_id")
    large = F.col("members") > longest // 2
    info = F.shiftleft(F.col("size"), 32).bitwiseOR(F.shiftleft(F.col("at").cast("long"), 1)).bitwiseOR((F.col("members") > 1).cast("long"))
    exploded = prefixes.select("group_id", "size", "members", F.posexplode("prefix").alias("at", "shingle"))
    listed = written(shingle_lists(exploded.select("shingle", "group_id", info.alias("info")), longest), "lists")
    big = written(groups.filter(large).select("group_id"), "big")
    short = listed.filter("not long").join(big, "group_id", "left_anti")
    pairs = group_pairs(short, percent)
    member = lambda s: members.select(F.col("group_id").alias(s), F.col("class_id").alias(f"class_{s}"))
    pairs = pairs.join(member("a"), "a").join(member("b"), "b").filter((F.col("a") != F.col("b")) | (F.col("class_a") < F.col("class_b"))).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    pairs = written(pairs, "pairs")
    touched = written(listed.filter("not long").join(big, "group_id", "left_semi").select("shingle").distinct(), "touched")
    far = listed.filter("long").unionByName(listed.filter("not long").join(touched, "shingle", "left_semi"))
    long_lists = written(far.select("shingle", "group_id", F.shiftright("info", 32).alias("size")).join(members, "group_id").select("shingle", "class_id", "size"), "long")
    centres = written(long_lists.groupBy("shingle").agg(F.min("class_id").alias("a")), "centres")
    star = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b").unionByName(long_lists.join(centres, "shingle").filter("a < class_id").select("a", F.col("class_id").alias("b")).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class_id")).unionByName(long_lists.select("class_id")).distinct()
    sets = sets_of(docs, written(wanted, "wanted"), n, id_col, text_col)
    verified = lambda some: _with_sets(written(some, "star"), sets).mapInArrow(frugal(_verify_pairs(percent)), "a long, b long")
    near = written(verified(star), "near")
    roots = near_roots(near)
    root = lambda s: roots.select(F.col("id").alias(s), F.col("root").alias(f"root_{s}"))
    apart = pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    return classes.select("digest", "class_id"), written(near.unionByName(verified(apart)).unionByName(block_links(long_lists, roots, sets, percent, block)), "links")


def components(docs: DataFrame, n: int = 5, percent: int = 80, hot: int = 32, most_hot: int = 500_000, longest: int = 128, block: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    common = hot_shingles(docs, n, percent, hot, most_hot, text_col)
    rows = written(described(docs, n, percent, common, id_col, text_col), "described")
    classes, found = links(docs, rows, n, percent, longest, block, id_col, text_col)
    roots = connected_components(spark, found).withColumnRenamed("id", "class_id")
    known = classes.join(roots, "class_id", "left").select("digest", F.coalesce("root", "class_id").alias("component"))
    return rows.select("doc_id", "size", "digest").join(known, "digest", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without those whose component has a smaller id; rows with a null id stay."""
    found = components(docs, id_col=id_col, **options)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(small_or_not(written(gone, "gone")), id_col, "left_anti").select(*docs.columns)
