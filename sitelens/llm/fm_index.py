"""FM-index over a sequence of small integers: wavelet matrix ranks, backward
search of many patterns at once, and location by sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order of ``s`` by prefix doubling; only unsettled suffixes are sorted again."""
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(s, kind="stable")
    first = np.ones(n, bool)
    first[1:] = s[order][1:] != s[order][:-1]
    starts = np.flatnonzero(first)
    rank = np.empty(n, np.int64)  # place of the first suffix of the same group
    rank[order] = starts[np.cumsum(first) - 1]
    h = 1
    while True:
        size = np.diff(np.append(np.flatnonzero(first), n))
        open_ = np.repeat(size > 1, size)
        if not open_.any():
            return order
        at = np.flatnonzero(open_)
        who = order[at]
        nxt = np.where(who + h < n, rank[np.minimum(who + h, n - 1)] + 1, 0)
        key = rank[who] * np.int64(n + 2) + nxt
        by = np.argsort(key, kind="stable")
        who, key = who[by], key[by]
        order[at] = who
        first[at] = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(first)
        rank[order] = starts[np.cumsum(first) - 1]
        h *= 2


class WaveletMatrix:
    """Rank and access of a sequence over [0, 2**levels)."""

    def __init__(self, s: np.ndarray, levels: int) -> None:
        self.n, self.levels = len(s), max(1, levels)
        self.ones: list[np.ndarray] = []   # prefix counts of one bits, per level
        self.zeros: list[int] = []
        cur = s
        for level in range(self.levels - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(np.int32)
            self.ones.append(np.concatenate((np.zeros(1, np.int32), np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(cur) - bit.sum()))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol ``c`` before place ``i``."""
        lo = np.zeros_like(i)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((c >> level) & 1).astype(bool)
            ol, oi = self.ones[k][lo], self.ones[k][i]
            lo = np.where(one, self.zeros[k] + ol, lo - ol)
            i = np.where(one, self.zeros[k] + oi, i - oi)
        return i - lo

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.levels):
            ones = self.ones[k]
            bit = ones[i + 1] - ones[i]
            out = out * 2 + bit
            i = np.where(bit == 1, self.zeros[k] + ones[i], i - ones[i])
        return out


class FMIndex:
    """Index of one shard; symbols are at least 1, an end mark 0 is added."""

    def __init__(self, s: np.ndarray, sigma: int, sample: int = 16) -> None:
        s = np.append(s, 0)
        self.n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]  # the symbol before each suffix, cyclic
        self.wave = WaveletMatrix(bwt, int(sigma).bit_length())
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.bincount(s, minlength=sigma + 1))))
        marked = sa % sample == 0
        self.marks = np.concatenate((np.zeros(1, np.int64), np.cumsum(marked)))
        self.samples = sa[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of equally long patterns, one a row."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            a = self.before[c] + self.wave.rank(c, lo[live])
            b = self.before[c] + self.wave.rank(c, hi[live])
            lo[live], hi[live] = a, b
            hi[live[b <= a]] = 0
            live = live[b > a]
            if not len(live):
                break
        return lo, np.maximum(hi, lo * (hi == 0))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walk back to a sampled one."""
        rows = rows.astype(np.int64).copy()
        out = np.full(len(rows), -1, np.int64)
        steps = np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            r = rows[live]
            hit = self.marks[r + 1] > self.marks[r]
            done = live[hit]
            out[done] = self.samples[self.marks[r[hit]]] + steps[done]
            live, r = live[~hit], r[~hit]
            c = self.wave.access(r)
            rows[live] = self.before[c] + self.wave.rank(c, r)
            steps[live] += 1
        return out
