"""FM-index over a sequence of word ids: suffix array, wavelet matrix with rank directories, sampled suffix positions.

Every operation works on arrays of queries at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Prefix doubling; each round sorts only the suffixes that are still tied. The last symbol must occur once and be the smallest."""
    n = len(s)
    following = np.zeros(n, np.int64)
    following[:-1] = s[1:]
    key = (s.astype(np.int64) << 32) | following
    sa = np.argsort(key, kind="stable")
    slots = np.arange(n)
    rank = np.empty(n, np.int64)
    key, width = key[sa], 2
    while True:
        first = np.ones(len(slots), bool)
        first[1:] = key[1:] != key[:-1]
        group = np.flatnonzero(first)
        sizes = np.diff(np.append(group, len(slots)))
        rank[sa[slots]] = np.repeat(slots[group], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return sa
        at = sa[slots]
        then = np.zeros(len(at), np.int64)
        inside = at + width < n
        then[inside] = rank[at[inside] + width] + 1
        key = rank[at] * (n + 1) + then
        order = np.argsort(key, kind="stable")
        sa[slots] = at[order]
        key, width = key[order], width * 2


class Bits:
    """A bit vector with a rank directory: a count before each word of 64 bits."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return ((self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.depth = len(symbols), max(1, int(sigma - 1).bit_length())
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for shift in range(self.depth - 1, -1, -1):
            ones = ((symbols >> shift) & 1).astype(bool)
            self.levels.append(Bits(ones))
            self.zeros.append(int(len(ones) - np.count_nonzero(ones)))
            symbols = np.concatenate((symbols[~ones], symbols[ones]))
        # after the last level the symbols are grouped; where each group begins
        self.first = np.zeros(sigma + 1, np.int64)
        present, at = np.unique(symbols, return_index=True)
        self.first[present] = at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position; the symbols must occur."""
        for level, zeros, shift in zip(self.levels, self.zeros, range(self.depth - 1, -1, -1), strict=True):
            ones = level.rank(at)
            at = np.where((symbol >> shift) & 1, zeros + ones, at - ones)
        return at - self.first[symbol]

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and how often it occurs before."""
        symbol = np.zeros(len(at), np.int64)
        for level, zeros in zip(self.levels, self.zeros, strict=True):
            one, ones = level.get(at), level.rank(at)
            symbol = symbol * 2 + one
            at = np.where(one, zeros + ones, at - ones)
        return symbol, at - self.first[symbol]


class FMIndex:
    """symbols: ids from 1 on; an end mark 0 is appended. sample: each suffix position that it divides is kept."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        s = np.append(symbols, 0).astype(np.int64)
        sa = suffix_array(s)
        self.n = len(s)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(s, minlength=sigma))))
        self.bwt = WaveletMatrix(s[sa - 1], sigma)
        kept = sa % sample == 0
        self.sampled, self.samples = Bits(kept), sa[kept]

    def intervals(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search. patterns: a row each, right-aligned, -1 before a shorter one; every symbol must occur in the text. Row intervals [low, high)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            live = np.flatnonzero((patterns[:, j] >= 0) & (low < high))
            if not len(live):
                continue
            c = patterns[live, j]
            ranks = self.bwt.rank(np.concatenate((c, c)), np.concatenate((low[live], high[live])))
            low[live], high[live] = self.before[c] + ranks[: len(live)], self.before[c] + ranks[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: each walks backwards to a sampled row."""
        found, todo, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            there = self.sampled.get(at)
            found[todo[there]] = self.samples[self.sampled.rank(at[there])] + steps
            todo, at = todo[~there], at[~there]
            if len(todo):
                symbol, rank = self.bwt.access_rank(at)
                at = self.before[symbol] + rank
            steps += 1
        return found
