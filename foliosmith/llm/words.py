"""Vectorised word kernel: word spans and 64-bit word hashes of many texts at once.

A word is ``[^\\x20\\x09-\\x0D]+``.  Texts come as one Arrow string array; they are cut
into chunks of whole texts of about ``CHUNK`` bytes so that the working arrays
(about 30 bytes a text byte) stay small whatever the size of the Arrow batch.
Equal words have equal hashes everywhere; different words collide with
probability of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        factors = np.full(size, base, dtype=np.uint64)
        factors[0] = 1
        have = _powers[base] = np.multiply.accumulate(factors)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Chunk(NamedTuple):
    """Whole texts ``lo .. hi-1`` of a batch; word ``first[k] .. first[k+1]-1`` belong to text ``lo + k``."""

    lo: int
    hi: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = column.buffers()[2] if n else None
    return offsets, np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)


def text_chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, offsets from 0, bytes) of runs of whole texts of about ``limit`` bytes."""
    offsets, data = text_bytes(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, offsets[lo : hi + 1] - offsets[lo], data[offsets[lo] : offsets[hi]]
        lo = hi


def cut_points(solid: np.ndarray, limit: int) -> list[int]:
    """Ends of slices of at most ``limit`` bytes where a byte of no term is there to cut at, or else of more."""
    ends, at = [], 0
    while len(solid) - at > limit:
        back = np.flatnonzero(~solid[at : at + limit])
        if len(back):
            at += int(back[-1]) + 1
        else:
            ahead = np.flatnonzero(~solid[at + limit :])
            if not len(ahead):
                break
            at += limit + int(ahead[0]) + 1
        ends.append(at)
    return [*ends, len(solid)] if not ends or ends[-1] < len(solid) else ends


def word_chunks(column: pa.Array, lower: bool = False, limit: int = CHUNK) -> Iterator[Chunk]:
    """The words of each text; ``lower`` folds A-Z first."""
    for lo, hi, offsets, data in text_chunks(column, limit):
        if lower:
            data = _LOWER[data]
        solid = ~_SPACE[data]
        begin, end = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        filled = offsets[1:] > offsets[:-1]
        at, last = offsets[:-1][filled], offsets[1:][filled] - 1
        begin[at], end[last] = solid[at], solid[last]
        starts = np.flatnonzero(begin)
        yield Chunk(lo, hi, data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def word_hashes(chunk: Chunk) -> np.ndarray:
    """A 64-bit hash of each word of the chunk."""
    n = len(chunk.data)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE[chunk.data] * _power(_BASE, n), out=total[1:])
    return mix((total[chunk.ends] - total[chunk.starts]) * _power(_UNBASE, n + 1)[chunk.starts])


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` consecutive entries; ``len(words) - n + 1`` of them."""
    count = max(0, len(words) - n + 1)
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ words[k : k + count]) * np.uint64(0x2127599BF4325C37)
        out ^= out >> np.uint64(29)
    return mix(out)


def gram_valid(chunk: Chunk, n: int) -> np.ndarray:
    """For each run of ``n`` words of the chunk, whether it lies in one text."""
    count = max(0, len(chunk.starts) - n + 1)
    valid = np.ones(count, dtype=bool)
    for edge in chunk.first[1:-1]:
        valid[max(0, edge - n + 1) : edge] = False
    return valid
