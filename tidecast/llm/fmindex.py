"""A compressed full-text index of word sequences: suffix order, wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with one running count per word; `ones(i)` counts before place i."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(n, np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class Wavelet:
    """Wavelet matrix: one bit vector per bit of the symbols, highest first."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels, row = [], symbols
        for shift in range(max(1, int(size - 1).bit_length()) - 1, -1, -1):
            bit = (row >> shift & 1).astype(np.uint8)
            self.levels.append((shift, Bits(bit), int(len(bit) - bit.sum())))
            row = np.concatenate([row[bit == 0], row[bit == 1]])
        self.starts = self.down(np.zeros(size, np.int64), np.arange(size))

    def down(self, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where(symbol >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        return self.down(at, symbol) - self.starts[symbol]


def doubled(ranks: np.ndarray, step: int) -> np.ndarray:
    """Ranks of sequences twice (or `step` further) as long, from ranks of their two parts."""
    after = np.zeros_like(ranks)
    after[: max(0, len(ranks) - step)] = ranks[step:]
    return np.unique(ranks * np.int64(len(ranks) + 1) + after, return_inverse=True)[1].astype(np.int64) + 1


class Index:
    """Index of word sequences that are kept apart by a separator; suffixes are ordered by 128 words.

    So sequences of at most 128 words can be searched.
    """

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, window: int):
        if not 32 < window <= 64:
            raise ValueError("windows of 33 to 64 words")
        self.window = window
        joined = np.concatenate(sequences)
        names, dense = np.unique(joined, return_inverse=True)
        self.sizes = np.array([len(x) for x in sequences])
        if self.sizes.max(initial=0) > 128:
            raise ValueError("a sequence is longer than the order of the suffixes")
        self.begins = np.cumsum(self.sizes + 1) - self.sizes  # place 0 and the end of each are separators
        text = np.zeros(len(joined) + len(sequences) + 1, np.int64)
        text[np.repeat(self.begins - np.cumsum(self.sizes) + self.sizes, self.sizes) + np.arange(len(joined))] = dense + 1
        self.text, self.alphabet = text, len(names) + 1
        ranks = text + 1
        for step in (1, 2, 4, 8, 16):
            ranks = doubled(ranks, step)
        self.order = np.argsort(doubled(doubled(ranks, 32), 64), kind="stable")
        # suffixes that share a window are neighbours in that order: number the windows, own the smallest
        same = doubled(ranks, window - 32)[self.order]
        fresh = np.concatenate([[True], same[1:] != same[:-1]])
        owner_at = np.full(len(text), np.iinfo(np.int64).max)
        for_place = np.searchsorted(self.begins, np.arange(len(text)), side="right") - 1
        inside = for_place >= 0
        owner_at[inside] = owners[for_place[inside]]
        least = np.minimum.reduceat(owner_at[self.order], np.flatnonzero(fresh))
        self.least = least[np.cumsum(fresh) - 1]
        self.last = Wavelet(text[self.order - 1], self.alphabet)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.alphabet))[:-1]])

    def least_owners(self) -> list[np.ndarray]:
        """Stream every sequence, last word first, and report its windows' smallest owner in the index.

        All sequences take a step together. A state is the interval of suffixes that start with what was
        read; from `window` words on, its first suffix names the window that starts here.
        """
        n = len(self.sizes)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.text))
        out = [np.full(max(0, size - self.window + 1), np.iinfo(np.int64).max) for size in self.sizes]
        for read in range(1, int(self.sizes.max(initial=0)) + 1):
            on = np.flatnonzero(self.sizes >= read)
            symbol = self.text[self.begins[on] + self.sizes[on] - read]
            low[on] = self.smaller[symbol] + self.last.rank(symbol, low[on])
            high[on] = self.smaller[symbol] + self.last.rank(symbol, high[on])
            if read >= self.window:
                for i, owner in zip(on.tolist(), np.where(low[on] < high[on], self.least[np.minimum(low[on], len(self.least) - 1)], np.iinfo(np.int64).max).tolist()):
                    out[i][self.sizes[i] - read] = owner
        return out
