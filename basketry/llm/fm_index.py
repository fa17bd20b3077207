"""A compressed FM-index over integer words: wavelet-matrix ranks, backward search, matching statistics.

All functions work on whole arrays of positions, so many texts are searched in step.
"""

from __future__ import annotations

import numpy as np


class BitRank:
    """Packed bits with counts of ones before each 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.concatenate((bits.astype(np.uint8), np.zeros(-len(bits) % 64 + 64, np.uint8)))
        self._words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self._words).astype(np.int64)
        self._before = np.concatenate((np.zeros(1, np.int64), np.cumsum(ones)[:-1])).astype(np.int32)
        self.zeros = int(len(bits) - bits.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = self._words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self._before[word] + np.bitwise_count(low)


class WaveletMatrix:
    """Occurrences of a symbol before a position, in one bit rank per level."""

    def __init__(self, text: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self._bits = []
        rest = text
        for level in range(self.levels - 1, -1, -1):
            bit = (rest >> level & 1).astype(bool)
            self._bits.append(BitRank(bit))
            rest = np.concatenate((rest[~bit], rest[bit]))

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where the symbol's occurrences before `at` end in the last level; less the value at 0 it is their number."""
        for k, ranks in enumerate(self._bits):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            ones = ranks.ones(at)
            at = np.where(one, ranks.zeros + ones, at - ones)
        return at


def sorted_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by the first `depth` symbols or more, and whether a suffix differs from its predecessor there.

    Prefix doubling, the last step by as much as is missing, so that the order is by exactly `depth` symbols.
    """
    n = len(text)
    rank, reach = text.astype(np.int64), 1
    _, rank = np.unique(rank, return_inverse=True)
    while reach < depth:
        step = min(reach, depth - reach)
        behind = np.zeros(n, np.int64)
        behind[: n - step] = rank[step:] + 1
        _, rank = np.unique(rank * (n + 1) + behind, return_inverse=True)
        reach += step
    order = np.argsort(rank, kind="stable")
    ranked = rank[order]
    return order, np.concatenate((np.ones(1, bool), ranked[1:] != ranked[:-1]))


class FMIndex:
    """Index of a text for patterns of up to `depth` symbols. Symbol 0 separates pieces and ends the text."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        self.n, self.depth = len(text), depth
        # rows of equal `depth` symbols form a class; the index needs no order inside one
        order, new = sorted_suffixes(text, depth)
        self.positions = order
        self._bwt = WaveletMatrix(text[order - 1], symbols)
        counts = np.bincount(text, minlength=symbols)
        every = np.arange(symbols)
        self._base = np.concatenate((np.zeros(1, np.int64), np.cumsum(counts)[:-1])) - self._bwt.place(every, np.zeros(symbols, np.int64))
        self.class_of = np.cumsum(new) - 1
        self._starts = np.concatenate((np.flatnonzero(new), [self.n]))

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: intervals of the patterns with the symbol in front."""
        base = self._base[symbol]
        return base + self._bwt.place(symbol, low), base + self._bwt.place(symbol, high)

    def class_least(self, values: np.ndarray) -> np.ndarray:
        """Smallest value of the positions in each class."""
        return np.minimum.reduceat(values[self.positions], self._starts[:-1])

    def statistics(self, pieces: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Matching statistics, capped at `depth`, of pieces that the index holds, from their ends to their beginnings.

        Yields (which, step, class): pieces whose last `step` words begin with `depth` words found in the index, and the class
        of rows that begin with these. Beyond `depth` symbols the interval is widened to its class, its parent of that depth.
        """
        by_length = np.argsort(-lengths, kind="stable")
        starts, lengths = starts[by_length], lengths[by_length]
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), self.n)
        for step in range(1, int(lengths[0]) + 1 if len(lengths) else 1):
            active = int(np.searchsorted(-lengths, -step, side="right"))
            low, high = self.extend(pieces[starts[:active] + lengths[:active] - step], low[:active], high[:active])
            if step < self.depth:
                continue
            found = self.class_of[low]
            if not (high > low).all():
                raise ValueError("a piece is not in the index")
            low, high = self._starts[found], self._starts[found + 1]
            yield by_length[:active], step, found
