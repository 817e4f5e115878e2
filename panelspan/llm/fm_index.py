"""An FM-index over integer symbols: backward search through a wavelet matrix, located by sampled suffix positions.

All searches run on arrays of patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order, by prefix doubling. ``symbols`` must end in a symbol that occurs once and is the least."""
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    rank = rank.astype(np.int64)
    step = 1
    order = np.argsort(rank, kind="stable")
    # Only suffixes whose rank is still shared are sorted again.
    while True:
        sorted_rank = rank[order]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = sorted_rank[1:] != sorted_rank[:-1]
        begin = np.flatnonzero(new)
        rank[order] = np.repeat(begin, np.diff(np.append(begin, n)))
        size = np.diff(np.append(begin, n))
        tied = np.repeat(size > 1, size)
        if not tied.any():
            return order
        slots = np.flatnonzero(tied)
        rows = order[slots]
        key = rank[rows] * np.int64(n + 1) + rank[np.minimum(rows + step, n - 1)]
        by = np.argsort(key, kind="stable")
        order[slots] = rows[by]
        fresh = key[by]
        # Ranks of tied suffixes become the slot at which their key begins.
        first = np.concatenate([[True], fresh[1:] != fresh[:-1]])
        at = np.flatnonzero(first)
        rank[order[slots]] = np.repeat(slots[at], np.diff(np.append(at, len(slots))))
        step *= 2


class WaveletMatrix:
    """rank(symbol, position): how often a symbol occurs before a position."""

    def __init__(self, symbols: np.ndarray):
        self.bits = max(1, int(symbols.max(initial=0)).bit_length())
        self.ones, self.zeros = [], []
        for level in reversed(range(self.bits)):
            bit = (symbols >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit, dtype=np.int32)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        begins = np.zeros(len(symbols), np.int64)
        ends = ends.astype(np.int64)
        for k, level in enumerate(reversed(range(self.bits))):
            one = ((symbols >> level) & 1).astype(bool)
            b, e = self.ones[k][begins], self.ones[k][ends]
            begins = np.where(one, self.zeros[k] + b, begins - b)
            ends = np.where(one, self.zeros[k] + e, ends - e)
        return ends - begins


class FMIndex:
    """``symbols``: 2 and above; 1 separates texts, and no pattern holds it. Every ``sample``-th position is kept."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        symbols = np.asarray(symbols, np.int64)
        self.size = len(symbols) + 1
        walls = symbols == 1
        # Separators are told apart while sorting, so that no comparison runs on into the next text.
        apart = np.where(walls, np.cumsum(walls), symbols + int(walls.sum()))
        order = suffix_array(np.append(apart, 0))
        text = np.append(symbols, 0)
        last = text[order - 1]
        counts = np.bincount(text)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.wavelet = WaveletMatrix(last)
        self.last = last
        # Positions after a separator are kept as well: steps to the left end there.
        kept = (order % sample == 0) | (last <= 1)
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.positions = order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the sorted suffixes that begin with each row of ``patterns`` (all of one length)."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.size, np.int64)
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[:, column]
            known = (symbol >= 0) & (symbol < len(self.before) - 1)
            high = np.where(known, high, low)
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            s = symbol[live]
            low[live], high[live] = self.before[s] + self.wavelet.rank(s, low[live]), self.before[s] + self.wavelet.rank(s, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: steps to the left until a sampled one."""
        rows = rows.astype(np.int64)
        steps = np.zeros(len(rows), np.int64)
        moving = np.flatnonzero(~self.kept[rows])
        while len(moving):
            symbol = self.last[rows[moving]]
            rows[moving] = self.before[symbol] + self.wavelet.rank(symbol, rows[moving])
            steps[moving] += 1
            moving = moving[~self.kept[rows[moving]]]
        return self.positions[self.kept_before[rows]] + steps
