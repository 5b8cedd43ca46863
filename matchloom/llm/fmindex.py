"""A compressed full-text index over words: a wavelet matrix of the Burrows-Wheeler transform.

Rows are sorted by their first `depth` words, ties by place, which is all that patterns of
at most `depth` words need.  All queries take arrays, one entry per lane.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A packed bit vector with ranks: one bit and half a bit of counts per entry."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(n // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(counts) - counts).astype(np.int32)
        self.ones = int(counts.sum())

    def rank(self, place: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = place >> 6
        below = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class FMIndex:
    """symbols: the text as integers from 1, 0 between its parts and at its end."""

    def __init__(self, symbols: np.ndarray, depth: int):
        if depth < 2:
            raise ValueError("depth must be 2 or more")
        n = len(symbols)
        self.n, self.depth = n, depth
        order = np.concatenate([symbols, np.zeros(depth, np.int64)]).astype(np.int64)
        power = 1
        while 2 * power < depth:
            order = self._ranked(order, np.concatenate([order[power:], np.zeros(power, np.int64)]))
            power *= 2
        # neighbours that overlap name the first depth, and depth - 1, words
        full = self._ranked(order[:n], order[depth - power : depth - power + n])
        less = self._ranked(order[:n], order[depth - 1 - power : depth - 1 - power + n])
        rows = np.argsort(full, kind="stable")
        sorted_full, sorted_less = full[rows], less[rows]
        heads = np.ones(n, bool)
        heads[1:] = sorted_full[1:] != sorted_full[:-1]
        self.heads = Bits(heads)
        self.first = rows[heads].astype(np.int32)
        shorter = np.ones(n, bool)
        shorter[1:] = sorted_less[1:] != sorted_less[:-1]
        self.shorter = Bits(shorter)
        self.shorter_start = np.flatnonzero(shorter).astype(np.int32)

        last = symbols[rows - 1].astype(np.int64)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.levels = max(1, int(symbols.max(initial=0)).bit_length())
        self.matrix: list[tuple[Bits, int]] = []
        for level in reversed(range(self.levels)):
            bit = (last >> level) & 1
            bits = Bits(bit.astype(bool))
            self.matrix.append((bits, n - bits.ones))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        every = np.arange(len(self.below) - 1)
        self.begins = self._descend(np.zeros(len(every), np.int64), every)

    @staticmethod
    def _ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs from 1, with (0, 0) kept at 0."""
        pairs = a * (int(b.max(initial=0)) + 1) + b
        values, place = np.unique(pairs, return_inverse=True)
        return place.astype(np.int64) + (0 if len(values) and values[0] == 0 else 1)

    def _descend(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.matrix):
            one = bits.rank(place)
            place = np.where((symbol >> (self.levels - 1 - k)) & 1, zeros + one, place - one)
        return place

    def extend(self, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The first row of symbol + pattern from the first row of pattern, or the row behind the last from that of pattern."""
        return self.below[symbol] - self.begins[symbol] + self._descend(row, symbol)

    def drop_last(self, low: np.ndarray) -> np.ndarray:
        """The first row of a pattern of depth words without its last, from the pattern's."""
        return self.shorter_start[self.shorter.rank(low + 1) - 1].astype(np.int64)

    def earliest(self, low: np.ndarray) -> np.ndarray:
        """The first place of the text where a pattern of depth words stands."""
        return self.first[self.heads.rank(low + 1) - 1]


def window_rows(index: FMIndex, symbols: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Matching statistics, cut at depth, of streamed parts symbols[begins:ends] of the indexed text.

    All parts move from their ends to their begins in step.  (place, first row of its interval) of each window of
    depth words, in no order.  As the index holds what is streamed, no interval is empty, and
    the row that begins it says all: where the interval ends is the next head.
    """
    places, rows = [], []
    order = np.argsort(begins - ends, kind="stable")
    begins, ends = begins[order], ends[order]
    sizes = ends - begins
    low = np.zeros(len(begins), np.int64)
    for step in range(int(sizes.max(initial=0))):
        lanes = int(np.searchsorted(-sizes, -step, "left"))  # parts longer than step, as they are in order of size
        low = low[:lanes]
        if step >= index.depth:
            low = index.drop_last(low)
        at = ends[:lanes] - 1 - step
        low = index.extend(low, symbols[at])
        if step >= index.depth - 1:
            places.append(at)
            rows.append(low)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *rows])
