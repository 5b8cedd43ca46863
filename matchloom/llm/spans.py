"""Spans of bytes in a slice of texts, found by any rule and named by 64-bit hashes.

The same names as those of text.Words, for rules that cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .text import _byte_codes, _power_tables, mix

Finder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def byte_set(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


class Spans:
    """data: the texts' bytes, A-Z lowered if asked; starts, ends: the spans' places in it; first: for each text the place of its
    first span, one more than texts.  Null texts count as empty."""

    def __init__(self, texts: pa.Array, find: Finder, lower: bool = False):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        if lower:
            data = data + np.uint8(32) * ((data >= 65) & (data <= 90))
        self.data, self.offsets = data, offsets - offsets[0]
        self.starts, self.ends = find(self.data, self.offsets)
        self.first = np.searchsorted(self.starts, self.offsets)

    def names(self) -> np.ndarray:
        up, down = _power_tables(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_byte_codes(False)[self.data] * up[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts])

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def runs_outside(apart: np.ndarray) -> Finder:
    """Spans are the longest runs of bytes outside a set; none crosses from one text to the next."""

    def find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = ~apart[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        return starts, np.flatnonzero(inside[:-1] & (~inside[1:] | edge))

    return find
