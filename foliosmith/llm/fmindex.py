"""A compressed full-text index over integer symbols: BWT, wavelet matrix of packed bits with rank blocks, vectorised backward search."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Prefix doubling; where all suffixes differ within d symbols it takes log2(d) sorts."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank, width = rank.astype(np.int64), 1
    while True:
        follow = np.zeros(n, dtype=np.int64)
        follow[: max(0, n - width)] = rank[width:] + 1
        key = rank * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank, width = fresh, 2 * width
        if not n or rank[order[-1]] == n - 1 or width > n:
            return order


class BitVector:
    """Packed bits with the number of ones before each 64-bit block."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.blocks = np.zeros(len(bits) // 64 + 1, dtype=np.uint64)
        self.blocks.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.blocks), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.blocks[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each position."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)


class FMIndex:
    """Index of texts of symbols 1 .. sigma, joined by separators (symbol 0) that match nothing."""

    def __init__(self, texts: list[np.ndarray]):
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.zeros(int(ends[-1]), dtype=np.int64)
        for text, end in zip(texts, ends):
            self.text[end - 1 - len(text) : end - 1] = text
        sigma = int(self.text.max(initial=0))
        distinct = self.text + len(texts)
        distinct[ends - 1] = np.arange(len(texts))  # separators that differ, so no suffixes agree beyond one
        self.suffixes = suffix_array(distinct)
        bwt = self.text[self.suffixes - 1]
        self.starts = np.zeros(sigma + 2, dtype=np.int64)
        np.cumsum(np.bincount(self.text, minlength=sigma + 1), out=self.starts[1:])
        self.levels: list[tuple[int, BitVector, int]] = []
        base = np.zeros(sigma + 1, dtype=np.int64)
        names = np.arange(sigma + 1)
        for shift in range(max(1, sigma.bit_length()) - 1, -1, -1):
            bits = (bwt >> shift) & 1 == 1
            vector, zeros = BitVector(bits), int(len(bits) - bits.sum())
            self.levels.append((shift, vector, zeros))
            base = np.where((names >> shift) & 1 == 1, zeros + vector.ones(base), base - vector.ones(base))
            bwt = np.concatenate([bwt[~bits], bwt[bits]])
        self.base = base

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search: the intervals of the patterns with ``symbols`` put before them."""
        n, at = len(symbols), np.concatenate([low, high])
        both = np.concatenate([symbols, symbols])
        for shift, vector, zeros in self.levels:
            ones = vector.ones(at)
            at = np.where((both >> shift) & 1 == 1, zeros + ones, at - ones)
        at = at - self.base[both] + self.starts[both]
        return at[:n], at[n:]

    def repeated(self, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics by backward search from each text position in ``ends`` (inclusive), as far as ``length``.

        Returns, of the positions whose ``length`` symbols occur at least twice, (index into ends, low, high).  A search ends
        as soon as its interval holds one suffix, the position itself.
        """
        at = np.arange(len(ends))
        symbols = self.text[ends]
        low, high = self.starts[symbols], self.starts[symbols + 1]
        for back in range(1, length):
            active = high - low > 1
            at, low, high = at[active], low[active], high[active]
            low, high = self.step(self.text[ends[at] - back], low, high)
        active = high - low > 1
        return at[active], low[active], high[active]
