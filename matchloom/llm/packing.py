"""Best-fit decreasing packing of documents into windows of equal length.

A document longer than a window is first cut into full windows; what remains is one
piece below a window's length.  Pieces are dealt by hash to groups of about GROUP pieces; each group
is packed by itself, longest piece first, into the open window that it fits tightest,
found in a segment tree over the free space of the open windows.  Of a group's
padding only a few windows' worth is due to the group's edge, so it does not grow.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ids_and_texts, schema, written
from .text import slices
from .tokens import encoder

GROUP = 50_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class OpenWindows:
    """A segment tree of how many open windows have which free space."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, change: int) -> None:
        i, count = free + self.leaves, self.count
        while i:
            count[i] += change
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least free space of an open window that is at least need."""
        i, count = need + self.leaves, self.count
        if count[i]:
            return need
        while i > 1:
            if not i & 1 and count[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if count[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return None


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each length, given longest first; each is 1 to size."""
    tree, by_free, used = OpenWindows(size), {}, []
    window, offset = [], []
    for n in lengths:
        free = tree.tightest(n) if n < size else None
        if free is None:
            w, free = len(used), size
            used.append(0)
        else:
            w = by_free[free].pop()
            tree.add(free, -1)
        window.append(w)
        offset.append(used[w])
        used[w] += n
        if free > n:
            by_free.setdefault(free - n, []).append(w)
            tree.add(free - n, 1)
    return window, offset


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end: int, size: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for batch in slices(batches, "text"):
        ids, counts = encode(batch.column("text"), end)
        raw = memoryview(ids.astype("<u4")).cast("B")
        begin = np.cumsum(counts) - counts
        n = -(-counts // size)
        doc = np.repeat(np.arange(len(counts)), n)
        start = (np.arange(len(doc)) - (np.cumsum(n) - n)[doc]) * size
        length = np.minimum(size, counts[doc] - start)
        at = (begin[doc] + start).tolist()
        crc = [zlib.crc32(raw[4 * a : 4 * (a + b)]) for a, b in zip(at, length.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(doc)), *(pa.array(x, pa.int64()) for x in (start, length, crc, counts[doc]))],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
        )


def _pack(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
    window, offset = best_fit_decreasing(rows["length"].tolist(), size)
    rows["offset"] = np.array(offset, np.int64)
    rows["sequence_id"] = (rows["bin"].to_numpy() << 32) + np.array(window, np.int64)
    return rows.drop(columns="bin")


def packed(docs: DataFrame, tokenizer: str, end: int, size: int = 4096) -> DataFrame:
    """Documents -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone.  Rows repeated under one doc_id are each
    packed; rows with a null doc_id are left out; an empty table gives no rows.
    """
    pieces = written(ids_and_texts(docs).mapInArrow(partial(_pieces, path=tokenizer, end=end, size=size), schema(_PIECES)), "pieces")
    groups = max(1, -(-pieces.count() // GROUP))
    dealt = pieces.withColumn("bin", F.pmod(F.xxhash64("doc_id", "start"), F.lit(groups)))
    return dealt.groupBy("bin").applyInPandas(partial(_pack, size=size), schema(f"{_PIECES}, offset long, sequence_id long")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )
