"""Token ids of whole texts, and their patched frame-of-reference files.

Encoding.  The tokenizers that are meant here (lower-casing BPE with word ends, as
word_bpe_49k.json) drop white space and never let a token cross it, so a text's ids are the ids
of its words in turn; a worker encodes each distinct word once and gathers.

File format.  Blocks of 128 ids: their minimum is taken off, and the rest is packed at
the width that holds PERCENTILE of the block's values.  Values that need more bits
keep their low bits in place and have their place and high bits in the block's
exception list.  A payload is

    "PFR1", ids (u32), blocks (u32), start byte of each block (u32 each), blocks
    block: minimum (u32), width (u8), exceptions (u8), 16 * width packed bytes,
           places (u8 each), high bits (u32 each)

all little-endian, the last block filled up with its minimum.  Payloads are rows of
Parquet files, written and committed by Spark, so any store and any lost executor will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import ids_and_texts, schema
from .text import Words, slices

BLOCK, PERCENTILE = 128, 90
SEGMENT_IDS = 1 << 20
_CACHED_WORDS = 2_000_000
_SEGMENTS = "part int, seg int, seg_start long, n_ids long, doc_ids array<long>, lengths binary, ids binary"


class _Encoder:
    """Ids by word, kept for the words met so far in this worker: sorted names, and where their ids stand in a pool."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.names, self.begin, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, names: np.ndarray, texts: list[str]) -> None:
        """Add words, given in the order of their names."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        stop = self.used + int(size.sum())
        if stop > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), stop), np.uint32)])
        self.pool[self.used : stop] = np.fromiter(chain.from_iterable(found), np.uint32, stop - self.used)
        at = np.searchsorted(self.names, names)
        self.begin = np.insert(self.begin, at, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.names = np.insert(self.names, at, names)
        self.used = stop

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, each with the end id; number of ids of each)."""
        # white space, and places between a letter or digit and punctuation, are never inside a token, and case does not
        # count: but apostrophes, marks on what precedes them, and the special strings are left in their words
        plain = not any(pc.any(pc.match_substring(texts, x)).as_py() for x in self.special)
        words = Words(texts, lower=plain, pieces=plain)
        names, first, place = np.unique(words.names, return_index=True, return_inverse=True)
        if len(self.names) > _CACHED_WORDS:
            self._clear()
        at = np.searchsorted(self.names, names)
        known = at < len(self.names)
        known[known] = self.names[at[known]] == names[known]
        if not known.all():
            data, new = words.data.tobytes(), first[~known]
            cuts = zip(words.starts[new].tolist(), words.ends[new].tolist(), strict=True)
            self._learn(names[~known], [data[a:b].decode() for a, b in cuts])
            at = np.searchsorted(self.names, names)
        each = self.size[at][place]
        done = np.concatenate([[0], np.cumsum(each)])
        ids = self.pool[np.repeat(self.begin[at][place] - done[:-1], each) + np.arange(done[-1])]
        stops = done[words.first[1:]]
        counts = np.diff(done[words.first])
        return np.insert(ids, stops, np.uint32(end)), counts + 1


@lru_cache(2)
def encoder(path: str) -> _Encoder:
    return _Encoder(path)


def pack(ids: np.ndarray) -> bytes:
    """Patched frame-of-reference bytes of unsigned 32-bit ids; none give a header alone."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.zeros(blocks * BLOCK, np.int64)
    full[:n] = ids
    if n < len(full):
        full[n:] = ids[(blocks - 1) * BLOCK :].min()
    full = full.reshape(blocks, BLOCK)
    least = full.min(axis=1) if blocks else np.zeros(0, np.int64)
    rest = full - least[:, None]
    bits = np.ceil(np.log2(rest + 1)).astype(np.int64)
    width = np.sort(bits, axis=1)[:, BLOCK * PERCENTILE // 100] if blocks else np.zeros(0, np.int64)
    over = bits > width[:, None]
    n_over = over.sum(axis=1)
    sizes = 6 + 16 * width + 5 * n_over
    starts = 12 + 4 * blocks + np.cumsum(sizes) - sizes
    out = np.zeros(12 + 4 * blocks + int(sizes.sum()), np.uint8)
    out[:4] = np.frombuffer(b"PFR1", np.uint8)
    out[4:12] = np.array([n, blocks], "<u4").view(np.uint8)
    out[12 : 12 + 4 * blocks] = starts.astype("<u4").view(np.uint8)
    out[starts[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts + 4], out[starts + 5] = width, n_over
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        low = ((rest[rows][:, :, None] >> np.arange(w)) & 1).astype(np.uint8)
        out[starts[rows][:, None] + 6 + np.arange(16 * w)] = np.packbits(low.reshape(len(rows), -1), axis=1, bitorder="little")
    row, place = np.nonzero(over)
    turn = np.arange(len(row)) - (np.cumsum(n_over) - n_over)[row]
    behind = starts + 6 + 16 * width
    out[behind[row] + turn] = place
    high = (rest[row, place] >> width[row]).astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(behind + n_over)[row][:, None] + 4 * turn[:, None] + np.arange(4)] = high
    return out.tobytes()


def unpack(payload: bytes) -> np.ndarray:
    """The ids of a payload, exactly."""
    data = np.frombuffer(payload, np.uint8)
    if data[:4].tobytes() != b"PFR1":
        raise ValueError("not a token payload")
    n, blocks = data[4:12].copy().view("<u4").tolist()
    starts = data[12 : 12 + 4 * blocks].copy().view("<u4").astype(np.int64)
    least = data[starts[:, None] + np.arange(4)].copy().view("<u4").astype(np.int64).reshape(-1)
    width, n_over = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    rest = np.zeros((blocks, BLOCK), np.int64)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        low = np.unpackbits(data[starts[rows][:, None] + 6 + np.arange(16 * w)], axis=1, bitorder="little")
        rest[rows] = low.reshape(len(rows), BLOCK, w) @ (1 << np.arange(w, dtype=np.int64))
    row = np.repeat(np.arange(blocks), n_over)
    turn = np.arange(len(row)) - (np.cumsum(n_over) - n_over)[row]
    behind = starts + 6 + 16 * width
    place = data[behind[row] + turn]
    high = data[(behind + n_over)[row][:, None] + 4 * turn[:, None] + np.arange(4)].copy().view("<u4").astype(np.int64).reshape(-1)
    rest[row, place] |= high << width[row]
    return (rest + least[:, None]).ravel()[:n].astype(np.uint32)


def _segments(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    encode, seg, begun = encoder(path), 0, 0
    docs: list = []
    sizes: list = []
    ids: list = []
    held = 0

    def row() -> pa.RecordBatch:
        columns = [[part], [seg], [begun], [held], [np.concatenate(docs)], [pack(np.concatenate(sizes))], [pack(np.concatenate(ids))]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = ["part", "seg", "seg_start", "n_ids", "doc_ids", "lengths", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in slices(batches, "text"):
        got, counts = encode(batch.column("text"), end)
        docs.append(batch.column("doc_id").to_numpy())
        sizes.append(counts)
        ids.append(got)
        held += len(got)
        if held >= SEGMENT_IDS:
            yield row()
            seg, begun, held = seg + 1, begun + held, 0
            docs, sizes, ids = [], [], []
    if held:
        yield row()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int) -> None:
    """Encode whole texts, append the end id to each, and write them in ascending doc_id order.

    Null and empty texts hold the end id alone.  Rows repeated under one doc_id are all
    written, in the order of their texts; rows with a null doc_id are left out; an empty
    table gives an empty folder of files.  Part k of the folder holds the k-th range of ids.
    """
    ordered = ids_and_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(partial(_segments, path=tokenizer, end=end), schema(_SEGMENTS)).write.parquet(folder)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            counts, ids = unpack(row["lengths"]).astype(np.int64), unpack(row["ids"])
            stops = np.cumsum(counts)
            place = np.concatenate([[0], 4 * stops]).astype(np.int32)
            raw = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(place), pa.py_buffer(ids.astype("<u4"))])
            start = row["before"] + row["seg_start"] + stops - counts
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(counts), raw], names=["doc_id", "start", "n_tokens", "ids"]
            )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (unsigned 32-bit, little-endian) of each document.

    Only the totals of the parts, one row for each task that wrote, are summed in one place.
    """
    rows = spark.read.schema(schema(_SEGMENTS)).parquet(folder)
    totals = rows.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    # one small row for each writing task
    placed = rows.drop("n_ids").join(F.broadcast(before), "part")
    return placed.mapInArrow(_decoded, schema("doc_id long, start long, n_tokens long, ids binary"))
