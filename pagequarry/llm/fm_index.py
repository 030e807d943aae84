"""A compressed FM-index over word symbols: wavelet matrix of the BWT, packed bits with a third of their size in counts."""

from __future__ import annotations

import numpy as np

U = np.uint64


class Bits:
    """A bit vector with rank: 64-bit words, the ones before each run of eight words, and before each word within its run (16 bits)."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])[:-1]
        self.run = before[::8].copy()
        self.inside = (before - np.repeat(self.run, 8)[: len(before)]).astype(np.uint16)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones in [0, i)."""
        w = i >> 6
        low = (U(1) << (i & 63).astype(np.uint64)) - U(1)
        return self.run[w >> 3] + self.inside[w] + np.bitwise_count(self.words[w] & low)


class FMIndex:
    """Backward search for patterns of up to ``depth`` symbols of ``text`` (ints, 0 kept for separators).

    Suffixes are sorted by prefix doubling on their first ``depth`` symbols or more, ties by position:
    enough for intervals of patterns that long.
    """

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.sigma = int(text.max()) + 1
        rank = text.astype(np.int64)
        k = 1
        while k < depth:
            nxt = np.full(n, 0, dtype=np.int64)
            nxt[: n - k] = rank[k:] + 1
            key = rank * (int(nxt.max()) + 2) + nxt
            _, rank = np.unique(key, return_inverse=True)
            k *= 2
        order = np.argsort(rank, kind="stable")
        bwt = text[order - 1]
        self.count = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))])
        self.levels: list[tuple[int, Bits, int]] = []
        row = bwt.astype(np.int64)
        for shift in range(max(1, (self.sigma - 1).bit_length()) - 1, -1, -1):
            bit = (row >> shift) & 1
            self.levels.append((shift, Bits(bit), int(n - bit.sum())))
            row = np.concatenate([row[bit == 0], row[bit == 1]])

        # where each symbol's run begins at the bottom of the matrix
        self.base = self._down(np.arange(self.sigma), np.zeros(self.sigma, dtype=np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((c >> shift) & 1, zeros + ones, i - ones)
        return i

    def step(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with ``c`` put before them."""
        both = self._down(np.concatenate([c, c]), np.concatenate([lo, hi]))
        start = self.count[c] - self.base[c]
        return both[: len(c)] + start, both[len(c) :] + start


def matching_statistics(index: FMIndex, text: np.ndarray, end: np.ndarray, most: int, least_hits: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """For each place in ``end`` (exclusive): how many symbols before it, up to ``most``, occur together at least
    ``least_hits`` times in the index, and the first row of the interval of that many."""
    length = np.zeros(len(end), dtype=np.int64)
    first = np.zeros(len(end), dtype=np.int64)
    live = np.arange(len(end))
    lo = np.zeros(len(end), dtype=np.int64)
    hi = np.full(len(end), len(text), dtype=np.int64)
    for j in range(1, most + 1):
        at = end[live] - j
        ok = at >= 0
        live, lo, hi, at = live[ok], lo[ok], hi[ok], at[ok]
        if j == 1:
            c = text[at]
            lo, hi = index.count[c], index.count[c + 1]
        else:
            lo, hi = index.step(text[at], lo, hi)
        ok = (hi - lo >= least_hits) & (text[at] > 0)
        live, lo, hi = live[ok], lo[ok], hi[ok]
        if not len(live):
            break
        length[live] = j
        first[live] = lo
    return length, first
