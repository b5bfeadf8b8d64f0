"""Near duplicates among embeddings by spherical-cap filters.

Filter directions are a random product code: the coordinates are turned by a random rotation, cut into ``parts`` blocks, and a direction
is one of ``code`` random unit vectors in each block, over the square root of ``parts``.  So there are code ** parts directions,
but a vector's products with all of them are sums of ``parts`` table entries, and list-decoding walks only partial
sums that can still reach the threshold.  Each vector goes to all filters whose direction it meets with at least ``alpha`` (a lower value where those are fewer than ``fewest``);
vectors that share a filter (and a label) are candidates; their cosine is then verified in double precision.

Equal vectors with equal labels form a class first; only one vector of a class is searched.  A filter's number starts with the words of its first
blocks, and a vector's filters share few such beginnings: filters are dealt in runs of numbers, as many runs a label as keep its vectors a run
under ``cell``, and a vector is shipped once to each run that it has filters in.  A run that still has too many vectors is dealt into blocks by a hash, each pair of
blocks to one cell, so that no cell is larger than two blocks, no pair is left out, and memory is bounded.  Within a cell vectors meet by filters.
A pair that shares several filters counts only in the least of them, so links need no deduplication, and a cell gives back no pairs:
the number of links of each vector, and a forest that joins what is linked.

The filters are drawn from a seed and ``alpha`` is a parameter: nothing is fitted to rows.  Recall is measured in the tests against brute force (0.99 and more at the threshold).
The code doubles while a label has too many vectors for its filters, so that chance meetings stay in proportion to the vectors.

Defined results: vectors that are null, empty, of length zero, or that hold a null or non-finite component link with
nothing, as do rows without a label or an id; vectors of different dimension never link; repeated ids are rows of one vector id each;
an empty input gives an empty output; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .components import connected_components
from .storage import frugal, small_or_not, written


class CapFilters:
    """A structured random product code of filter directions for one dimension."""

    def __init__(self, dim: int, parts: int = 4, code: int = 16, alpha: float | None = None, fewest: int = 24, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.parts, self.code, self.fewest = parts, code, min(fewest, code**parts // 2)
        self.alpha = 0.5 + 0.1 * np.log2(code / 16) if alpha is None else alpha
        self.width = -(-dim // parts)
        turn, _ = np.linalg.qr(rng.normal(size=(self.width * parts, self.width * parts)))
        self.turn = turn[:dim]
        self.words = rng.normal(size=(parts, code, self.width))
        self.words /= np.linalg.norm(self.words, axis=2, keepdims=True) * np.sqrt(parts)

    def decode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter), by row, of every filter that a unit vector meets with ``alpha``; with fewer than ``fewest`` of them, its threshold goes down by hundredths."""
        turned = (vectors @ self.turn).reshape(len(vectors), self.parts, self.width)
        products = np.einsum("npw,pcw->npc", turned, self.words)
        rest = np.concatenate([np.cumsum(products.max(axis=2)[:, ::-1], axis=1)[:, ::-1], np.zeros((len(vectors), 1))], axis=1)
        todo, least, found = np.arange(len(vectors)), self.alpha, []
        while len(todo):
            rows, ids = self._reach(products[todo], rest[todo], least)
            enough = np.bincount(rows, minlength=len(todo)) >= self.fewest
            good = enough[rows]
            found.append((todo[rows[good]], ids[good]))
            todo, least = todo[~enough], least - 0.01
        rows, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((ids, rows))
        return rows[order], ids[order]

    def _reach(self, products: np.ndarray, rest: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
        """List-decoding: extends, block by block, the partial sums whose best completion reaches ``least``."""
        rows, sums, ids = np.arange(len(products)), np.zeros(len(products)), np.zeros(len(products), dtype=np.int64)
        for part in range(self.parts):
            reach = sums[:, None] + products[rows, part] + rest[rows, part + 1][:, None]
            which, word = np.nonzero(reach >= least)
            sums = sums[which] + products[rows[which], part, word]
            ids = ids[which] * self.code + word
            rows = rows[which]
        return rows, ids


def _unit(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.linalg.norm(values, axis=1, keepdims=True)


#: Vectors of a cell: the 25th part of all, within these.
LEAST_CELL, MOST_CELL = 500, 100_000
#: Members of a filter that meet by comparing shifted lists; more by products of matrices.
FEW = 16
#: Chance members of a filter beyond which the code doubles.
CROWD = 4_000
TILE = 2_048


def marked_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, vec, content) of every row; content, two hashes of the vector, is null where the row links with nothing."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    return rows.withColumn("content", F.when(usable, F.struct(F.xxhash64("vec").alias("x"), F.xxhash64(F.lit(1), F.reverse("vec"), F.size("vec")).alias("y"))))


def code_size(n: int, parts: int, fewest: int, code: int = 16) -> int:
    """The code with which chance meetings of n vectors stay few."""
    while n * fewest / code**parts > CROWD and (2 * code) ** parts < 2**31:
        code *= 2
    return code


def _first_of(ids: pa.Array, vecs: pa.Array) -> list[int]:
    """The first row of each id and vector."""
    keys = ids.to_numpy(zero_copy_only=False)
    names, where, count = np.unique(keys, return_inverse=True, return_counts=True)
    if len(names) == len(keys):
        return list(range(len(keys)))
    seen, kept = set(), []
    for k, several in enumerate((count[where] > 1).tolist()):
        if several:
            mark = (keys[k], tuple(vecs[k].as_py()))
            if mark in seen:
                continue
            seen.add(mark)
        kept.append(k)
    return kept


def decoded(rows: DataFrame, code: int, parts: int, fewest: int, **filters) -> DataFrame:
    """Adds ``filters``, the sorted filters of each vector, to rows whose first column is the id and that have a column ``vec``; the other columns stay."""
    schema = T.StructType([*rows.schema.fields, T.StructField("filters", T.ArrayType(T.IntegerType()))])
    place = rows.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, CapFilters] = {}
        for batch in batches:
            batch = batch.take(pa.array(_first_of(batch.column(0), batch.column(place))))
            sizes = np.array([len(v) for v in batch.column(place)], dtype=np.int64)
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                coder = made.setdefault(int(dim), CapFilters(int(dim), parts=parts, code=code, fewest=fewest, **filters))
                for lo in range(0, len(at), 256):
                    part = batch.take(pa.array(at[lo : lo + 256]))
                    rows, found = coder.decode(_unit(np.asarray(part.column(place).flatten(), dtype=np.float64).reshape(-1, dim)))
                    ends = np.searchsorted(rows, np.arange(part.num_rows + 1))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(found, pa.int32()))], names=schema.names)

    return rows.mapInArrow(frugal(run), schema)


def cell_links(classes: DataFrame, least: float = 0.93, cell: int | None = None, parts: int = 4, fewest: int = 24, **filters) -> DataFrame:
    """(a, b, links) of classes (class_id, label, members, vec): with b null, the rows that a class links with in a cell; else a link of a forest."""
    spark = classes.sparkSession
    key = ["label", "dim"]
    shown = classes.select("class_id", "label", F.size("vec").alias("dim"), F.col("members").cast("int").alias("members"), "vec")
    sizes = written(shown.groupBy(*key).agg(F.count("*").alias("n")), "sizes")
    total, most = sizes.agg(F.sum("n"), F.max("n")).first()
    cell = cell or min(max((total or 0) // 25, LEAST_CELL), MOST_CELL)
    code = code_size(most or 0, parts, fewest)
    bits = (code**parts).bit_length() - 1
    # Of 2 ** g runs, a vector meets about 1 + 0.8 g + 0.05 g * g.
    width = F.coalesce(*[F.when(F.col("n") * (1 + 0.8 * g + 0.05 * g * g) / 2**g <= cell, F.lit(bits - g)) for g in range(bits + 1)], F.lit(0))
    runs = sizes.select(*key, width.alias("width"))
    dealt = decoded(shown, code, parts, fewest, **filters).join(small_or_not(runs), key)
    dealt = dealt.withColumn("run", F.explode(F.array_distinct(F.transform("filters", lambda f: F.call_function("shiftright", f, F.col("width"))))))
    counts = dealt.groupBy(*key, "run").agg(F.count("*").alias("n")).filter("n > 1")
    counts = written(counts.select(*key, "run", F.ceil(F.col("n") / (1.5 * cell)).cast("int").alias("blocks")), "runs")
    placed = dealt.join(small_or_not(counts), [*key, "run"]).withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shown = pairs.select(F.xxhash64(*key, "run", "i", "j").alias("cell"), "width", "run", "i", "j", "own", "class_id", "members", "vec", "filters", "label", "dim")
    order = ["cell", "label", "dim", "run", "i", "j", "class_id"]
    shown = shown.repartition(n, "cell").sortWithinPartitions(*order).select("cell", F.xxhash64("label", "dim", "run", "i", "j").alias("mark"), "width", "run", "i", "j", "own", "class_id", "members", "vec", "filters")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.column_stack([batch.column(c).to_numpy() for c in range(2)])
            edges = (np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist()
            if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != tuple(marks[0].tolist()):
                edges = [0, *edges]
            for lo, hi in zip([None, *edges], [*edges, batch.num_rows]):
                if lo is not None and held:
                    yield _verified(pa.Table.from_batches(held), least)
                    held = []
                if (lo or 0) < hi:
                    held.append(batch.slice(lo or 0, hi - (lo or 0)))
        if held:
            yield _verified(pa.Table.from_batches(held), least)

    return shown.mapInArrow(frugal(verify), "a long, b long, links long")


def _close(vec: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of rows have at least that cosine."""
    good = [np.einsum("nd,nd->n", vec[a[lo : lo + 20_000]], vec[b[lo : lo + 20_000]]) >= least for lo in range(0, len(a), 20_000)]
    return np.concatenate(good) if good else np.zeros(0, bool)


class _Cell:
    """The vectors of one cell, by row, with their filters; collects the links between rows."""

    def __init__(self, vec: np.ndarray, filters: np.ndarray, ends: np.ndarray, own: np.ndarray, members: np.ndarray, across: bool, least: float):
        self.vec, self.filters, self.ends, self.own, self.members, self.across, self.least = vec, filters, ends, own, members, across, least
        self.links = np.zeros(len(vec), dtype=np.int64)
        self.edges: list[np.ndarray] = []
        owner = np.repeat(np.arange(len(vec)), np.diff(ends))
        self.span = int(filters.max(initial=0)) + 1
        self.codes = owner * self.span + filters
        self.owner = owner

    def search(self, lo: int, hi: int) -> None:
        """All pairs whose least common filter is in lo .. hi - 1."""
        inside = (self.filters >= lo) & (self.filters < hi)
        rows, found = self.owner[inside], self.filters[inside]
        order = np.argsort(found, kind="stable")
        rows, found = rows[order], found[order]
        edges = np.flatnonzero(found[1:] != found[:-1]) + 1
        begin, end = np.concatenate([[0], edges]), np.concatenate([edges, [len(found)]])
        few = np.repeat((end - begin <= FEW) & (end - begin > 1), end - begin)
        self._few(rows[few], found[few])
        for a, b in zip(begin.tolist(), end.tolist()):
            if b - a > FEW:
                self._many(rows[a:b], int(found[a]))

    def _few(self, rows: np.ndarray, found: np.ndarray) -> None:
        for lag in range(1, min(FEW, len(rows))):
            same = np.flatnonzero(found[lag:] == found[:-lag])
            if not len(same):
                return
            a, b, mark = rows[same], rows[same + lag], found[same]
            if self.across:
                apart = self.own[a] != self.own[b]
                a, b, mark = a[apart], b[apart], mark[apart]
            good = _close(self.vec, a, b, self.least)
            a, b, mark = a[good], b[good], mark[good]
            for at in range(0, len(a), 20_000):
                part = slice(at, at + 20_000)
                fresh = ~self._met(a[part], b[part], mark[part])
                x, y = a[part][fresh], b[part][fresh]
                np.add.at(self.links, x, self.members[y])
                np.add.at(self.links, y, self.members[x])
                self.edges.append(np.column_stack([x, y]))

    def _met(self, a: np.ndarray, b: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Whether two rows share a filter below the mark."""
        size = self.ends[a + 1] - self.ends[a]
        which = np.repeat(np.arange(len(a)), size)
        flat = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.ends[a], size)
        names = self.filters[flat]
        lower = names < mark[which]
        which, wanted = which[lower], b[which[lower]] * self.span + names[lower]
        at = np.minimum(np.searchsorted(self.codes, wanted), len(self.codes) - 1)
        return np.bincount(which[self.codes[at] == wanted], minlength=len(a)) > 0

    def _many(self, rows: np.ndarray, mark: int) -> None:
        size = self.ends[rows + 1] - self.ends[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        names = self.filters[np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.ends[rows], size)]
        lower = names < mark
        owner, names = owner[lower], names[lower]
        _, column, count = np.unique(names, return_inverse=True, return_counts=True)
        several = count[column] > 1
        owner = owner[several]
        _, column = np.unique(column[several], return_inverse=True)
        width = int(column.max(initial=-1)) + 1

        def holds(lo: int, first: int) -> np.ndarray:
            out = np.zeros((min(TILE, len(rows) - lo), min(2 * TILE, width - first)), dtype=np.float32)
            part = (owner >= lo) & (owner < lo + TILE) & (column >= first) & (column < first + 2 * TILE)
            out[owner[part] - lo, column[part] - first] = 1
            return out

        for x in range(0, len(rows), TILE):
            for y in range(x, len(rows), TILE):
                a, b = rows[x : x + TILE], rows[y : y + TILE]
                near = self.vec[a] @ self.vec[b].T >= self.least
                if x == y:
                    near = np.triu(near, 1)
                if self.across:
                    near &= self.own[a][:, None] != self.own[b][None, :]
                if not near.any():
                    continue
                for first in range(0, width, 2 * TILE):
                    near &= holds(x, first) @ holds(y, first).T == 0
                self.links[a] += near @ self.members[b]
                self.links[b] += self.members[a] @ near
                self.edges.append(_tree(a, b, near))


def _tree(a: np.ndarray, b: np.ndarray, near: np.ndarray) -> np.ndarray:
    """A forest of the links between two lists of rows: each row takes the least row it reaches until none does."""
    least_a, least_b = a.copy(), b.copy()
    far = np.iinfo(np.int64).max
    while True:
        new_a = np.minimum(least_a, np.where(near, least_b[None, :], far).min(axis=1, initial=far))
        new_b = np.minimum(least_b, np.where(near, new_a[:, None], far).min(axis=0, initial=far))
        # A row that stands in both lists has one least row.
        rows, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        best = np.full(len(rows), far)
        np.minimum.at(best, where, np.concatenate([new_a, new_b]))
        new_a, new_b = best[where[: len(a)]], best[where[len(a) :]]
        if (new_a == least_a).all() and (new_b == least_b).all():
            edges = np.column_stack([rows, best])
            return edges[edges[:, 0] != edges[:, 1]]
        least_a, least_b = new_a, new_b


def _verified(rows: pa.Table, least: float) -> pa.RecordBatch:
    """The links of one cell: (row, null, links) and (row, row, 0)."""
    rows = rows.combine_chunks()
    rows = rows.take(pa.array(_first_of(rows.column("class_id").combine_chunks(), rows.column("vec").combine_chunks()))).combine_chunks()
    ids, own, members = (rows.column(c).to_numpy() for c in ("class_id", "own", "members"))
    lists, vecs = rows.column("filters").combine_chunks(), rows.column("vec").combine_chunks()
    run, width = rows.column("run")[0].as_py(), rows.column("width")[0].as_py()
    made = [np.zeros(0, np.int64)] * 3
    if len(ids) > 1:
        vec = _unit(np.asarray(vecs.flatten(), dtype=np.float64).reshape(len(ids), -1))
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
        cell = _Cell(vec, lists.flatten().to_numpy().astype(np.int64), ends, own, members.astype(np.int64), rows.column("i")[0] != rows.column("j")[0], least)
        cell.search(run << width, (run + 1) << width)
        linked = np.flatnonzero(cell.links)
        edges = np.unique(np.sort(np.concatenate(cell.edges), axis=1), axis=0) if cell.edges else np.zeros((0, 2), np.int64)
        made = [np.concatenate([ids[linked], ids[edges[:, 0]]]), ids[edges[:, 1]], cell.links[linked]]
    first, second, count = made
    b = pa.concat_arrays([pa.nulls(len(count), pa.int64()), pa.array(second.astype(np.int64))])
    return pa.RecordBatch.from_arrays([pa.array(first.astype(np.int64)), b, pa.array(np.concatenate([count, np.zeros(len(second), np.int64)]))], names=["a", "b", "links"])


def near_duplicates(vectors: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", **options) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    spark = vectors.sparkSession
    marked = marked_vectors(vectors, id_col, vec_col, label_col)
    usable = marked.filter("content is not null")
    classes = written(usable.groupBy("label", "content").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("members")), "classes")
    # A class is stood for by its vector of the least id; repeated rows of that id go within their batch and within each cell.
    first = usable.join(small_or_not(classes.select("label", "content", F.col("class_id").alias("vec_id"), "members")), ["label", "content", "vec_id"])
    found = written(cell_links(first.select(F.col("vec_id").alias("class_id"), "label", "members", "vec"), least, **options), "links")
    degree = found.filter("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("links").alias("outside"))
    roots = connected_components(spark, found.filter("b is not null").select("a", "b"))
    known = classes.join(degree, "class_id", "left").join(roots.select(F.col("id").alias("class_id"), "root"), "class_id", "left").select(
        "label", "content", (F.col("members") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"), F.coalesce("root", "class_id").alias("root"))
    answer = marked.select("vec_id", "label", "content").join(known, ["label", "content"], "left")
    root = F.coalesce("root", "vec_id")
    return answer.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), root.alias("component_id"), (F.col("vec_id") == root).alias("kept"))
