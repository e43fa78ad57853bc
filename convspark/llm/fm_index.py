"""FM-index of one shard: a suffix array, a wavelet matrix over its Burrows-Wheeler transform, sampled positions.

Symbols are integers from 1; 0 is a boundary that no phrase can span. All steps work on arrays of rows at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order. Boundaries differ from each other, earlier ones being smaller.

    The last symbol must be a boundary. Prefix doubling sorts only what is still tied: a rank is the first place of
    its group, so it is final once a group has one member.
    """
    n = len(symbols)
    bounds = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + (len(bounds) - 1)
    rank[bounds] = np.arange(len(bounds))
    order = np.argsort(rank, kind="stable")
    places, step = np.arange(n), 0
    while len(places):
        at = order[places]
        key = rank[at] if not step else rank[at] * n + rank[at + step]
        if step:
            by = np.argsort(key, kind="stable")
            at, key = at[by], key[by]
            order[places] = at
        new = np.r_[True, key[1:] != key[:-1]]
        rank[at] = places[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
        alone = new & np.r_[new[1:], True]
        places = places[~alone]
        step = 2 * step or 1
    return order


class WaveletMatrix:
    """Ranks over a sequence of integers below 2 ** bits: one packed bit vector a level."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels = []
        for level in range(bits - 1, -1, -1):
            ones = (values >> level & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(values) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]
            self.levels.append((level, words, before, len(values) - int(ones.sum())))
            values = np.r_[values[~ones], values[ones]]

    @staticmethod
    def _ones(words, before, i):
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return before[i >> 6] + np.bitwise_count(words[i >> 6] & below)

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the first i values that equal the symbol end, on the last level."""
        for level, words, before, zeros in self.levels:
            ones = self._ones(words, before, i)
            i = np.where(symbol >> level & 1, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i and their places on the last level."""
        symbol = np.zeros_like(i)
        for level, words, before, zeros in self.levels:
            bit = (words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
            ones = self._ones(words, before, i)
            i = np.where(bit, zeros + ones, i - ones)
            symbol |= bit.astype(np.int64) << level
        return symbol, i


class FMIndex:
    def __init__(self, symbols: np.ndarray, largest: int, sample: int = 16):
        symbols = symbols.astype(np.int64)
        suffixes = suffix_array(symbols)
        previous = symbols[suffixes - 1]
        previous[suffixes == 0] = 0
        self.ranks = WaveletMatrix(previous, max(1, int(largest).bit_length()))
        counts = np.bincount(symbols, minlength=largest + 1)
        every = np.arange(largest + 1)
        #: first row of a symbol, less the place where its values start on the last level
        self.shift = np.r_[0, np.cumsum(counts)[:-1]] - self.ranks.place(every, np.zeros_like(every))
        # a walk to the left ends at a sampled position, before it can reach a boundary
        marked = (suffixes % sample == 0) | (previous == 0)
        self.marked, self.nth = marked, np.cumsum(marked) - 1
        self.sampled = suffixes[marked]
        self.rows = len(symbols)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the phrases (rows of symbols, filled up with 0 to the right) by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.rows, np.int64)
        live = np.arange(len(phrases))
        for back in range(1, phrases.shape[1] + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - back].astype(np.int64)
            low[live] = self.ranks.place(symbol, low[live]) + self.shift[symbol]
            high[live] = self.ranks.place(symbol, high[live]) + self.shift[symbol]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: walk to the left until a sampled position."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.marked[rows])
        while len(live):
            symbol, place = self.ranks.access(rows[live])
            rows[live] = place + self.shift[symbol]
            steps[live] += 1
            live = live[~self.marked[rows[live]]]
        return self.sampled[self.nth[rows]] + steps
