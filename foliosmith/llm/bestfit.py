"""Best-fit packing by exact complements: whole documents go into as few sequences of at most ``size`` tokens as a plan over lengths finds.

1. Texts are tokenized once; a document longer than ``size`` is cut into pieces of ``size`` tokens, of which the first may be shorter.  Pieces are
   written with their length and their place among the pieces of that length in their task.
2. Only lengths matter to a plan, so it is made of their histogram: at most ``size`` counts, whatever the number of documents.  From the longest
   length down, the gap that a piece leaves is looked up in the sums of one, two and three available lengths; a combination that fills it
   exactly is consumed as often as its lengths are available.  What no combination completes is packed best-fit, longest first, many
   alike sequences at a time.  A plan is a few thousand rows: (length, first piece, pieces a sequence, sequences, first sequence, offset).
3. Each piece's place among all pieces of its length (counts of tasks before it, added up for each length) gives its row of the plan, and so its sequence and offset.

Nothing but the histogram and the plan is on the driver.  The counts of tasks are broadcast if they are small, or else joined; then token ids are shuffled once.

Defined results: a null text counts as empty (its only token is the end token); repeated rows are packed once each; an empty input gives
no rows; columns other than the id and the text are ignored.  Sequence ids run from 0 without gaps; which of several pieces of equal length gets which place depends on the
partitions of the input.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .bytepairs import byte_pairs
from .storage import frugal, light_or_not, written


class Row(NamedTuple):
    """Pieces ``first`` .. ``first + each * sequences - 1`` of a length, ``each`` side by side in each of the sequences from ``sequence`` on, from ``offset``."""

    length: int
    first: int
    each: int
    sequences: int
    sequence: int
    offset: int


class Complements:
    """Available lengths, and which sums of one, two and three of them there are."""

    def __init__(self, available: np.ndarray):
        """``available``: how many pieces there are of each length from 0 on."""
        self.left = available.astype(np.int64).copy()
        self.size = len(available) - 1
        self._index()

    def _index(self) -> None:
        self.single = self.left > 0
        wide = 1 << (2 * self.size + 1).bit_length()
        waves = np.fft.rfft(self.single, wide)
        self.pair = np.fft.irfft(waves * waves, wide)[: self.size + 1] > 0.5
        self.triple = np.fft.irfft(waves * np.fft.rfft(self.pair, wide), wide)[: self.size + 1] > 0.5

    def _times(self, lengths: Counter) -> int:
        return min(int(self.left[x]) // n for x, n in lengths.items())

    def _pair(self, gap: int, rest: Counter) -> Counter | None:
        """``rest`` with the available pair of the sum ``gap`` that is most even, which leaves long and short pieces for others."""
        short = np.arange(gap // 2, 0, -1)
        for x in short[self.single[short] & self.single[gap - short]]:
            if self._times(found := rest + Counter((int(x), int(gap - x)))):
                return found
        return None

    def filling(self, length: int, most: int) -> Counter | None:
        """Available lengths that make a whole sequence with ``length``: alone, or with one to ``most`` others."""
        own, gap = Counter((length,)), self.size - length
        if not gap:
            return own
        if self.single[gap] and self._times(found := own + Counter((gap,))):
            return found
        if most > 1 and self.pair[gap] and (found := self._pair(gap, own)):
            return found
        if most > 2 and self.triple[gap]:
            third = np.flatnonzero(self.single[1:gap])[::-1] + 1
            for x in third[self.pair[gap - third]]:
                if found := self._pair(int(gap - x), own + Counter((int(x),))):
                    return found
        return None

    def take(self, lengths: Counter) -> int:
        """Consumes a combination as often as it is available; how often that is."""
        times = self._times(lengths)
        gone = False
        for x, n in lengths.items():
            self.left[x] -= n * times
            gone |= not self.left[x]
        if gone:
            self._index()
        return times


def _best_fit(left: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Packs what is left, longest first, each piece where the least room remains: (sequences, (length, pieces) of each)."""
    size = len(left) - 1
    groups: dict[int, list[tuple[int, list]]] = {}
    room = np.zeros(size + 1, dtype=bool)

    def put(gap: int, many: int, runs: list) -> None:
        if many:
            groups.setdefault(gap, []).append((many, runs))
            room[gap] = True

    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(room[length:])
            gap = length + int(fits[0]) if len(fits) else size
            many, runs = groups[gap].pop() if len(fits) else (-(-n // (size // length)), [])
            if len(fits) and not groups[gap]:
                room[gap] = False
            each = gap // length
            whole = min(many, n // each)
            put(gap - each * length, whole, [*runs, (length, each)])
            n -= whole * each
            many -= whole
            if many and n:
                put(gap - n * length, 1, [*runs, (length, n)])
                many, n = many - 1, 0
            if runs:
                put(gap, many, runs)
    for found in groups.values():
        yield from found


def _complete(available: np.ndarray, most: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Sequences that up to ``most`` complements fill exactly, then best-fit: (sequences, (length, pieces) of each)."""
    index, made = Complements(available), []
    for length in range(index.size, 0, -1):
        while index.left[length] and (lengths := index.filling(length, most)):
            made.append((index.take(lengths), sorted(lengths.items(), reverse=True)))
    return [*made, *_best_fit(index.left)]


def plan(available: np.ndarray) -> list[Row]:
    """A place for each of ``available[x]`` pieces of length x, for x from 1 to ``len(available) - 1``, the size of a sequence.

    Complements of up to three pieces use up short pieces, which best-fit then lacks; where that costs more than it saves, single complements are taken.
    """
    made = min((_complete(available, most) for most in (3, 2, 1)), key=lambda m: sum(many for many, _ in m))
    rows, used, sequence = [], [0] * len(available), 0
    for many, runs in made:
        offset = 0
        for length, each in runs:
            rows.append(Row(length, used[length], each, many, sequence, offset))
            used[length] += each * many
            offset += each * length
        sequence += many
    return rows


#: A length and a place among its pieces as one sortable number.
PLACE_BITS = 48


def places(rows: list[Row]) -> tuple[np.ndarray, np.ndarray]:
    """The plan as sorted keys and columns."""
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, len(Row._fields))
    return (table[:, 0] << PLACE_BITS) | table[:, 1], table


def placed(keys: np.ndarray, table: np.ndarray, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of the nth pieces of their lengths."""
    row = table[np.searchsorted(keys, (length << PLACE_BITS) | nth, side="right") - 1]
    beside = nth - row[:, 1]
    return row[:, 4] + beside // row[:, 2], row[:, 5] + beside % row[:, 2] * length


PIECE = "piece int, start long, length long, part int, nth long, ids binary"
FOUND = "piece int, start long, length long, ids binary, sequence_id long, offset long"


def cut_pieces(docs: DataFrame, vocabulary: str, end_id: int, size: int) -> DataFrame:
    """(id, piece, start, length, part, nth, ids in the bytes that the vocabulary needs) of (id, text); ``nth`` counts the pieces of a length in a task."""
    schema = T.StructType([docs.schema.fields[0], *T._parse_datatype_string(PIECE).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = byte_pairs(vocabulary), TaskContext.get().partitionId(), [0] * (size + 1)
        if end_id >= 1 << 8 * words.dtype.itemsize:
            raise ValueError(f"the end token {end_id} does not fit the vocabulary's ids")
        end = np.array([end_id], words.dtype)
        for batch in batches:
            rows, held, lo = [], 0, 0
            for k in range(batch.num_rows):
                ids = np.concatenate([words.ids(batch.column(1)[k].as_py() or ""), end])
                at, stop = 0, (len(ids) - 1) % size + 1
                for piece in range(-(-len(ids) // size)):
                    n = stop - at
                    rows.append((k, piece, at, n, seen[n], ids[at:stop].tobytes()))
                    seen[n] += 1
                    held += len(rows[-1][-1])
                    at, stop = stop, stop + size
                if held > 4_000_000 or k + 1 == batch.num_rows:
                    owner, pieces, starts, lengths, nth, raw = zip(*rows)
                    names = [f.name for f in schema.fields]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([part] * len(rows), pa.int32()), pa.array(nth, pa.int64()), pa.array(raw, pa.binary())], names=names)
                    rows, held = [], 0

    return docs.mapInArrow(frugal(run), schema)


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, size: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces with their places: (id, piece, start, length, ids as little-endian 32-bit binary, sequence_id, offset)."""
    pieces = written(cut_pieces(docs.select(F.col(id_col), F.col(text_col).alias("__text")), vocabulary, end_id, size), "pieces")
    key = pieces.columns[0]
    counts = written(pieces.groupBy(F.col("part").alias("__part"), F.col("length").alias("__length")).agg(F.count("*").alias("n")), "piece-counts")
    available = np.zeros(size + 1, dtype=np.int64)
    for row in counts.groupBy("__length").agg(F.sum("n").alias("n")).collect():  # at most one row a length
        available[row["__length"]] = row["n"]
    keys, table = places(plan(available))
    before = Window.partitionBy("__length").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(counts.select("__part", "__length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base")), "piece-bases")
    own = pieces.join(light_or_not(bases), (F.col("part") == F.col("__part")) & (F.col("length") == F.col("__length")))
    own = own.select(F.col(f"`{key}`"), "piece", "start", "length", "ids", (F.col("__base") + F.col("nth")).alias("__nth"))
    schema = T.StructType([own.schema.fields[0], *T._parse_datatype_string(FOUND).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = byte_pairs(vocabulary).dtype
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                some = batch.slice(lo, 1000)
                sequence, offset = placed(keys, table, some.column(3).to_numpy(), some.column(5).to_numpy())
                ids = [np.frombuffer(x.as_buffer(), dtype).astype("<u4").tobytes() for x in some.column(4)]
                yield pa.RecordBatch.from_arrays([*some.columns[:4], pa.array(ids, pa.binary()), pa.array(sequence), pa.array(offset)], names=[f.name for f in schema.fields])

    return own.mapInArrow(frugal(run), schema)
