"""A compressed FM-index over whole-number symbols, queried for many patterns at once.

The rows are suffixes sorted by their first ``depth`` symbols, which is enough
for patterns up to that length: an interval's ends always lie between suffixes
that differ within the pattern. Occurrences are counted in a wavelet matrix whose
levels are bit vectors with one running count for every 64 bits.
"""

from __future__ import annotations

import numpy as np



class Bits:
    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1].astype(np.int32)
        self.zeros = int(n - bits.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class FMIndex:
    def __init__(self, text: np.ndarray, depth: int):
        """``text``: symbols from 0; 0 separates and is never looked for; ``depth``: of the longest pattern."""
        self.depth = depth
        n = len(text)
        rank = text.astype(np.int64)
        width = 1
        while width < depth:
            after = np.zeros(n, np.int64)
            after[:n - width] = rank[width:] + 1
            keys, rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)
            width *= 2
        self.rows = np.argsort(rank, kind="stable")       # text place of each row
        last = text[self.rows - 1].astype(np.int64)       # the place before; the first symbol's is the last
        sigma = int(text.max(initial=0)) + 1
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))
        self.levels, self.shifts = [], list(range(max(1, (sigma - 1).bit_length()) - 1, -1, -1))
        for s in self.shifts:
            bit = ((last >> s) & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            last = np.concatenate((last[bit == 0], last[bit == 1]))
        # where each symbol's run begins once all levels are done
        symbol, at = np.arange(sigma), np.zeros(sigma, np.int64)
        for s, level in zip(self.shifts, self.levels, strict=True):
            at = self._down(level, (symbol >> s) & 1, at)
        self.run = at

    @staticmethod
    def _down(level: Bits, bit: np.ndarray, i: np.ndarray) -> np.ndarray:
        ones = level.rank(i)
        return np.where(bit == 1, level.zeros + ones, i - ones)

    def occurrences(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol is among the last-column entries before ``i``."""
        for s, level in zip(self.shifts, self.levels, strict=True):
            i = self._down(level, (symbol >> s) & 1, i)
        return i - self.run[symbol]

    def search(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: put a symbol in front of each pattern."""
        head = self.first[symbols]
        return head + self.occurrences(symbols, lo), head + self.occurrences(symbols, hi)

    def matches(self, text: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search for text[start:start + length] of each start, all at
        once. A pattern is dropped when only one row is left: that is itself.
        Gives the starts still matched at full length and their row intervals."""
        active = start
        if length > self.depth:
            raise ValueError(f"the index is sorted by {self.depth} symbols, not {length}")
        s = text[active + length - 1]
        lo, hi = self.first[s], self.first[s + 1]
        for j in range(length - 2, -1, -1):
            many = hi - lo > 1
            active, lo, hi = active[many], lo[many], hi[many]
            lo, hi = self.search(text[active + j], lo, hi)
        many = hi - lo > 1
        return active[many], lo[many], hi[many]
