"""Word kernels for the Arrow batches of a Spark task.

A word is a run of bytes outside 0x20 and 0x09-0x0D.  These bytes never occur
inside a UTF-8 sequence, so splitting bytes equals splitting code points.  Words
are named by 64-bit hashes: two different words of one corpus share a name with
probability about (distinct words)^2 / 2^65.

Null texts count as empty.  Work is done in slices of a few MB, so memory does
not depend on the size of a partition; one text longer than a slice makes a slice
of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
# 1: ASCII letters and digits, 2: ASCII punctuation but the apostrophe
_KIND = np.array([1 if chr(i).isalnum() and i < 128 else 2 if 32 < i < 127 and i != 39 else 0 for i in range(256)], np.uint8)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(2)
def _byte_codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        codes[ord("A") : ord("Z") + 1] = codes[ord("a") : ord("z") + 1]
    return codes


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """base^i and base^-i modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE_BYTES)
        _powers[:] = [
            np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]))
            for b in (_BASE, pow(_BASE, -1, 1 << 64))
        ]
    return _powers


class Words:
    """The words of a slice of texts.

    starts, ends: byte places in data; names: 64-bit hashes; first: for each text
    the place of its first word, one more than texts.
    """

    def __init__(self, texts: pa.Array, lower: bool = False, punctuation: bool = False, pieces: bool = False):
        """punctuation: runs of ASCII punctuation are words of their own; pieces: words are cut only
        between an ASCII letter or digit and ASCII punctuation that is no apostrophe."""
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        base = int(offsets[0]) if len(texts) else 0
        stop = int(offsets[-1]) if len(texts) else 0
        raw = texts.buffers()[2]
        self.data = data = np.frombuffer(raw, np.uint8)[base:stop] if raw is not None else np.zeros(0, np.uint8)
        self.offsets = offsets = (offsets - base) if len(texts) else np.zeros(1, np.int64)
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        if punctuation and n:
            edge[1:n] |= _PUNCTUATION[data[1:]] != _PUNCTUATION[data[:-1]]
        if pieces and n:
            edge[1:n] |= _KIND[data[1:]] * _KIND[data[:-1]] == 2
        self.starts = np.flatnonzero(inside[1:] & (~inside[:-1] | edge)).astype(np.int64)
        self.ends = np.flatnonzero(inside[:-1] & (~inside[1:] | edge)).astype(np.int64)
        self.first = np.searchsorted(self.starts, offsets)
        up, down = _power_tables(n + 1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_byte_codes(lower)[data] * up[:n], out=self._sums[1:])
        self._down = down
        self.names = self.spans(self.starts, self.ends)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of any byte ranges."""
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        """For each word the place of its text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def grams(names: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n neighbouring names; the last n-1 places have none."""
    m = max(0, len(names) - n + 1)
    out = np.full(m, int(n) * 0xA24BAED4963EE407 % 2**64, np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + names[j : j + m])
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about limit bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(sizes) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
