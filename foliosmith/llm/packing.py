"""Sum-of-squares online packing of tokenised texts into sequences of at most ``size`` tokens.

Each task packs the texts of its own input partition, in order, with no shuffle:
full sequences are cut off a long text; the rest, of s < size tokens, goes to the fill level h (an
open sequence holding h tokens, or a new one) with h + s <= size for which the sum of the squares of
N(level), the number of open sequences at each level, becomes least.  N is the level array.
At the end of the partition open sequences are cut
into one another until they are full; of the one left over, sequences of power-of-two lengths
are cut, which need no padding.  Before that it takes ``max_open`` open sequences (4,096 here, some 30 MB), which the sum of squares is far from on mixed lengths (some 300);
only where lengths never match, as with texts that are all longer than half a sequence, it bounds the memory.  So memory is bounded, every token lies in exactly one piece, and no token of padding is needed.

Defined results: a null text counts as empty (its only token is the end token); repeated rows are packed
once each; an empty input gives an empty output; extra columns are ignored.  ``sequence_id`` is
partition * 2**40 + a count, so it is stable as long as the input partitions are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from .bytepairs import bytes_of_letters
from .storage import frugal

#: Bytes that an entry of a cache takes besides its contents.
ENTRY = 180
_SIMPLE = re.compile(r"[\x09-\x0d\x20-\x7eÀ-ÖØ-öø-ÿ]*\Z")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\sa-z\dß-öø-ÿ]+")
#: Stands for the end of a word in what is merged; texts that hold it are not simple.
END = "\x01"
_GAP = re.compile(r"[\x09-\x0d\x20]")


class WordTokenizer:
    """Token ids of whole texts from a vocabulary that drops white space and marks the ends of words.

    The vocabulary's pre-tokenizer never joins text across white space, so the ids of a text are those of its chunks one after the other.
    Plain Latin letters, digits and signs are taken apart here and merged by a faster library, many at once: the end of a word is a byte of its own there, which
    merges with the letter before it first, as those pairs have the lowest ids of all.  Chunks with other characters go to the full tokenizer.
    """

    def __init__(self, path: str, limit: int = 64_000_000, longest: int = 64, stretch: int = 100_000):
        """``limit``: bytes that the cache of other chunks may hold, about; ``longest``: bytes of a chunk that is kept; ``stretch``: characters that are merged at once."""
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        letters, suffix = bytes_of_letters(), self.full.model.end_of_word_suffix
        self.special = tuple(t.content for t in self.full.get_added_tokens_decoder().values())
        ranks = {}
        for token, k in self.full.get_vocab(with_added_tokens=False).items():
            plain = token.removesuffix(suffix)
            ranks[bytes(letters[c] for c in plain) + (END.encode() if plain != token else b"")] = k
        if max(ranks[bytes([b, 1])] for b in range(256)) >= min(k for raw, k in ranks.items() if len(raw.removesuffix(b"\x01")) > 1):
            raise ValueError(f"{path} does not merge ends of words first")
        self.merge = tiktoken.Encoding("words", pat_str=f"[^{END}]+{END}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.chunks: dict[str, bytes] = {}
        self.limit, self.longest, self.stretch, self.held = limit, longest, stretch, 0

    def _simple(self, text: str) -> bool:
        return _SIMPLE.match(text) is not None and ("<" not in text or not any(s in text for s in self.special))

    def _merged(self, text: str) -> bytes:
        pieces = _PIECES.findall(text.lower())
        return np.array(self.merge(END.join(pieces) + END), "<u4").tobytes() if pieces else b""

    def _other(self, chunk: str) -> bytes:
        """Ids of a chunk with other characters; those that are short are kept."""
        found = self.chunks.get(chunk)
        if found is None:
            found = np.array(self.full.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
            if len(chunk) <= self.longest:
                if self.held > self.limit:
                    self.chunks.clear()
                    self.held = 0
                self.chunks[chunk] = found
                self.held += ENTRY + 4 * len(chunk) + len(found)
        return found

    def _part(self, text: str) -> bytes:
        if self._simple(text):
            return self._merged(text)
        out, run = [], []
        for chunk in text.encode().split():  # white space of ASCII alone
            chunk = chunk.decode()
            if self._simple(chunk):
                run.append(chunk)
                continue
            out += [self._merged(" ".join(run)), self._other(chunk)] if run else [self._other(chunk)]
            run = []
        return b"".join([*out, self._merged(" ".join(run))])

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a whole text."""
        out, at = [], 0
        while len(text) - at > self.stretch:
            cut = _GAP.search(text, at + self.stretch)
            if not cut:
                break
            out.append(self._part(text[at : cut.start()]))
            at = cut.start()
        return b"".join([*out, self._part(text[at:])])


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of a vocabulary file, kept by each Python worker."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Packer:
    """Online packing of byte strings of 4-byte ids; ``add`` and ``finish`` yield (document, start, ids, sequence, offset)."""

    def __init__(self, size: int = 4096, max_open: int | None = None):
        """``max_open``: open sequences that are held, as many as a sequence has tokens if it is not given."""
        self.size, self.max_open = size, max_open or size
        self.levels = np.zeros(size + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.count = 0
        self.next = 0

    def _emit(self, pieces: list) -> Iterator[tuple]:
        """Closes a sequence."""
        sequence, offset = self.next, 0
        self.next += 1
        for document, start, ids in pieces:
            yield document, start, ids, sequence, offset
            offset += len(ids) // 4

    def _level_for(self, s: int) -> int:
        """The level whose use makes the sum of squared counts least: the change is 2 (N[h+s] - N[h]) + 2, without the first part if full, without the second if new."""
        gain = 2 * (self.levels[s:] - self.levels[: len(self.levels) - s]) + 2
        gain[-1] = 1 - 2 * self.levels[self.size - s]
        gain[self.levels[: len(gain)] == 0] = np.iinfo(np.int64).max
        gain[0] = 2 * self.levels[s] + 1
        return int(gain.argmin())

    def add(self, document, ids: bytes) -> Iterator[tuple]:
        whole = len(ids) // 4 // self.size * self.size
        for at in range(0, whole, self.size):
            yield from self._emit([(document, at, ids[4 * at : 4 * (at + self.size)])])
        s = len(ids) // 4 - whole
        if not s:
            return
        level = self._level_for(s)
        pieces = []
        if level:
            pieces = self._take(level)
        pieces.append((document, whole, ids[4 * whole :]))
        if level + s == self.size:
            yield from self._emit(pieces)
        else:
            self._put(level + s, pieces)
            if self.count > self.max_open:
                yield from self._merge(self.max_open // 2)

    def _take(self, level: int) -> list:
        pieces = self.open[level].pop()
        self.levels[level] -= 1
        self.count -= 1
        return pieces

    def _put(self, level: int, pieces: list) -> None:
        self.open.setdefault(level, []).append(pieces)
        self.levels[level] += 1
        self.count += 1

    def _merge(self, leave: int) -> Iterator[tuple]:
        """Cuts the emptiest open sequences into the fullest until ``leave`` are open."""
        while self.count > leave:
            used = np.flatnonzero(self.levels)
            high, low = int(used[-1]), int(used[0])
            target = self._take(high)
            donor = self._take(low)
            room = self.size - high
            if low < room:
                self._put(high + low, target + donor)
                continue
            left = []
            for document, start, ids in donor:
                n = len(ids) // 4
                now = min(n, room)
                if now:
                    target.append((document, start, ids[: 4 * now]))
                    room -= now
                if now < n:
                    left.append((document, start + now, ids[4 * now :]))
            yield from self._emit(target)
            if left:
                self._put(sum(len(x[2]) // 4 for x in left), left)

    def finish(self) -> Iterator[tuple]:
        yield from self._merge(1)
        for level in list(self.open):
            while self.open[level]:
                pieces, rest = self._take(level), level
                while rest:
                    room = 1 << (rest.bit_length() - 1)
                    rest -= room
                    now = []
                    while room:
                        document, start, ids = pieces[0]
                        n = min(room, len(ids) // 4)
                        now.append((document, start, ids[: 4 * n]))
                        room -= n
                        if n < len(ids) // 4:
                            pieces[0] = (document, start + n, ids[4 * n :])
                        else:
                            pieces.pop(0)
                    yield from self._emit(now)


SCHEMA = "ids binary, start long, length long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, end_id: int = 2, size: int = 4096, max_open: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of packed sequences: (id, ids as little-endian 32-bit binary, start, length, doc_tokens, sequence_id, offset)."""
    shown = docs.select(F.col(id_col), F.col(text_col).alias("__text"))
    schema = T.StructType([shown.schema.fields[0], *T._parse_datatype_string(SCHEMA).fields])
    id_type = shown.schema.fields[0]
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(vocabulary)
        packer, base = Packer(size, max_open), TaskContext.get().partitionId() << 40
        kind, rows, held = None, [], 0

        def table() -> pa.RecordBatch:
            documents, starts, ids, sequences, offsets = zip(*rows) if rows else ((),) * 5
            return pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in documents], kind), pa.array(ids, pa.binary()), pa.array(starts, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([d[1] for d in documents], pa.int64()), pa.array([base + s for s in sequences], pa.int64()), pa.array(offsets, pa.int64())],
                names=[id_type.name, *[f.name for f in schema.fields[1:]]],
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            keys, texts = batch.column(0), batch.column(1)
            for k in range(batch.num_rows):
                ids = words.ids(texts[k].as_py() or "") + end
                for row in packer.add((keys[k].as_py(), len(ids) // 4), ids):
                    rows.append(row)
                    held += len(row[2])
                if held > 4_000_000:
                    yield table()
                    rows, held = [], 0
        if kind is not None:
            rows += packer.finish()
            yield table()

    return shown.mapInArrow(frugal(run), schema)
