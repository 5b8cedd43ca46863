"""Substring dedup with an FM-index per shard.

A window of `window` words that also starts earlier in the corpus is a repeat, and every
word under a repeat goes.

Routing.  A window's route is the least hash of its three-word runs, so equal windows have equal
routes.  Neighbouring windows of a document with one route make a segment, and segments go to shards by route.
Routes whose run of words the corpus has once cannot repeat; a Bloom filter of fixed size over the
routes that it has more often keeps the others off the network.  It only lets too much through.
A route with more than HOT segments is split: its windows travel one by one, routed by all their words.  Such routes
are known by a Bloom filter too, which splits a few others with them, everywhere alike.

Shards.  Before the shuffle a task settles the segments of which it has met the same words earlier
in the corpus' order: all their windows are repeats.  What is left of one shard is sorted by (doc_id, start) and
indexed, then streamed through backward search; the earliest row of a
window's interval tells whether the window stands earlier.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fmindex import FMIndex, window_rows
from .tables import free_name, ids_and_texts, one_row_per_id, schema, written
from .text import Words, grams, mix, slices

RUN, HOT, FILTER_BITS, SHARD_SEGMENTS = 3, 5000, 26, 8000
_SEGMENTS = "route long, doc_id long, start int, windows int, words string"
_SPANS = "doc_id long, first int, last int"
_ODD = 0xD1342543DE82EF95


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if width > done else values


class Segments:
    """The segments of a slice: route, text, start (word in the text), at (word in the slice), windows."""

    def __init__(self, words: Words, window: int):
        self.words, self.window = words, window
        names, doc = words.names, words.doc_of()
        m = max(0, len(names) - window + 1)
        none = np.zeros(0, np.int64)
        self.runs = grams(names, RUN)
        self.least = _sliding_least(self.runs, window - RUN + 1)[:m] if m else none.astype(np.uint64)
        whole = doc[:m] == doc[window - 1 : window - 1 + m]
        self._cut(doc, whole, self.least)

    def _cut(self, doc: np.ndarray, whole: np.ndarray, route: np.ndarray, single: np.ndarray | None = None) -> None:
        begins = whole.copy()
        joined = whole[1:] & whole[:-1] & (doc[1 : len(whole)] == doc[: max(0, len(whole) - 1)]) & (route[1:] == route[:-1])
        if single is not None:
            joined &= ~single[1:]
        begins[1:] &= ~joined
        self.whole, self.doc = whole, doc
        self.at = np.flatnonzero(begins)
        stops = whole.copy()
        stops[:-1] &= ~joined
        self.windows = np.flatnonzero(stops) + 1 - self.at
        self.route = route[self.at]
        self.text = doc[self.at]
        self.start = self.at - self.words.first[self.text]

    def weights(self) -> np.ndarray:
        """How often each segment holds the run of words that is its route; a window that repeats inside one makes that two or more."""
        sizes = self.windows + self.window - RUN
        if not len(sizes):
            return sizes
        begins = np.cumsum(sizes) - sizes
        place = np.repeat(self.at - begins, sizes) + np.arange(sizes.sum())
        return np.add.reduceat((self.runs[place] == np.repeat(self.route, sizes)).astype(np.int64), begins)

    def split(self, hot: np.ndarray) -> None:
        """Windows with a hot route, by the filter's bits, get segments and routes of their own."""
        single = _passes(self.least, hot)
        if single.any():
            self._cut(self.doc, self.whole, np.where(single, self.contents(np.arange(len(self.least)), self.window), self.least), single)

    def contents(self, at: np.ndarray, size) -> np.ndarray:
        """Hashes of runs of words."""
        n = len(self.words)
        up = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _ODD, np.uint64)]))
        down = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)]))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words.names * up[:n])])
        return mix((sums[at + size] - sums[at]) * down[at])


def _routes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        route, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(route.view(np.int64)), pa.array(n)], names=["route", "n"])

    for batch in slices(batches, "text"):
        found = Segments(Words(batch.column("text")), window)
        held.append(np.repeat(found.route, np.minimum(found.weights(), 2)))
        size += len(held[-1])
        if size > 2_000_000:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def _passes(route: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(route), bool)
    for shift in (0, 32):
        place = (route >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
        out &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def _filter(routes: DataFrame) -> np.ndarray:
    """The bits of a Bloom filter over the routes, made by Spark: at most 2^FILTER_BITS of them, in words of 64."""
    mask = (1 << FILTER_BITS) - 1
    placed = routes.select(F.explode(F.array(*(F.shiftrightunsigned("route", s).bitwiseAND(mask) for s in (0, 32)))).alias("b"))
    cells = placed.groupBy(F.shiftright("b", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow().to_pandas()
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    bits[cells["cell"].to_numpy(np.int64)] = cells["bits"].to_numpy(np.int64).view(np.uint64)
    return bits


def _shipped(batches: Iterator[pa.RecordBatch], window: int, shared, hot) -> Iterator[pa.RecordBatch]:
    bits = shared.value
    seen: dict[int, tuple[int, int]] = {}
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        found = Segments(words, window)
        if hot is not None:
            found.split(hot.value)
        # windows with a route of their own passed the filter by their hot route
        go = np.flatnonzero(_passes(found.least[found.at], bits)) if len(found.at) else found.at
        if not len(go):
            continue
        doc = batch.column("doc_id").to_numpy()[found.text[go]]
        start, windows = found.start[go], found.windows[go]
        keys = found.contents(found.at[go], windows + window - 1).tolist()
        order = np.lexsort((start, doc)).tolist()
        settled = np.zeros(len(go), bool)
        if len(seen) > 2_000_000:
            seen.clear()
        docs, starts = doc.tolist(), start.tolist()
        for i in order:
            place = (docs[i], starts[i])
            if seen.setdefault(keys[i], place) < place:
                settled[i] = True
            else:
                seen[keys[i]] = place
        first = words.starts[found.at[go]].tolist()
        last = words.ends[found.at[go] + windows + window - 2].tolist()
        raw = words.data.tobytes()
        text = [None if s else raw[a:b] for s, a, b in zip(settled.tolist(), first, last, strict=True)]
        columns = [found.route[go].view(np.int64), doc, start.astype(np.int32), windows.astype(np.int32)]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), pa.array(text, pa.binary()).cast(pa.string())], names=["route", "doc_id", "start", "windows", "words"]
        )


def _shard_spans(rows: pd.DataFrame, window: int) -> pd.DataFrame:
    """Spans of words under the windows of a shard's segments that stand earlier in the shard."""
    rows = rows.sort_values(["doc_id", "start"], ignore_index=True)
    words = Words(pa.array(rows["words"], pa.string()))
    symbols_of = np.unique(words.names, return_inverse=True)[1].astype(np.int64) + 1
    symbols = np.insert(symbols_of, words.first[1:], 0)
    begins = words.first[:-1] + np.arange(len(rows))
    ends = words.first[1:] + np.arange(len(rows))
    index = FMIndex(symbols, window)
    place, low = window_rows(index, symbols, begins, ends)
    again = np.sort(place[index.earliest(low) < place])
    segment = np.searchsorted(begins, again, "right") - 1
    word = rows["start"].to_numpy()[segment] + again - begins[segment]
    new = np.ones(len(again), bool)
    new[1:] = (again[1:] != again[:-1] + 1) | (segment[1:] != segment[:-1])
    stop = np.roll(new, -1)
    if len(stop):
        stop[-1] = True
    return pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[segment[new]], "first": word[new].astype(np.int32), "last": (word[stop] + window).astype(np.int32)})


def _stayed(batch: pa.RecordBatch, spans_in: str = "spans") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words, removed words and what stays of each text, joined by one space."""
    words = Words(batch.column("text"))
    spans = batch.column(spans_in)
    flat = spans.flatten()
    base = np.repeat(words.first[:-1], pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, base + flat.field("first").to_numpy(), 1)
    np.add.at(cover, base + flat.field("last").to_numpy(), -1)
    gone = np.cumsum(cover)[:-1] > 0
    doc = words.doc_of()
    removed = np.bincount(doc[gone], minlength=batch.num_rows)
    doc, starts, sizes = doc[~gone], words.starts[~gone], (words.ends - words.starts)[~gone]
    spaced = np.zeros(len(doc), np.int64)
    spaced[:-1] = doc[1:] == doc[:-1]
    stop = np.cumsum(sizes + spaced)
    place = np.repeat(starts - (stop - sizes - spaced), sizes + spaced) + np.arange(stop[-1] if len(stop) else 0)
    out = np.append(words.data, np.uint8(32))[place]
    out[(stop - 1)[spaced > 0]] = 32
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, sizes + spaced, minlength=batch.num_rows))]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(out)])
    return words.counts(), removed, texts.cast(pa.string())


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        counts, removed, texts = _stayed(batch)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), texts]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept"])


def _cleaned(batches: Iterator[pa.RecordBatch], spans_in: str) -> Iterator[pa.RecordBatch]:
    """The columns but the spans, with the texts that lose words replaced, and dropped if nothing stays."""
    for batch in slices(batches, "text"):
        _, removed, texts = _stayed(batch, spans_in)
        changed = pa.array(removed > 0)
        text = pc.if_else(changed, texts, batch.column("text").cast(pa.string()))
        size = pc.if_else(changed, pc.utf8_length(text).cast(pa.int64()), batch.column("n_chars"))
        new = {"text": text, "n_chars": size}
        names = [c for c in batch.schema.names if c != spans_in]
        out = pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names=names)
        yield out.filter(pc.invert(pc.and_(changed, pc.fill_null(pc.equal(text, ""), False))))


def repeated_spans(source: DataFrame, window: int) -> DataFrame:
    """doc_id, first, last: spans of words [first, last) under windows that also start earlier; spans may overlap."""
    spark = source.sparkSession
    counts = written(
        source.mapInArrow(partial(_routes, window=window), schema("route long, n long")).groupBy("route").agg(F.sum("n").alias("n")).where("n > 1"), "routes"
    )
    # 8 MB each, whatever the input
    shared = spark.sparkContext.broadcast(_filter(counts))
    busy = counts.where(F.col("n") > HOT)
    hot = None if busy.isEmpty() else spark.sparkContext.broadcast(_filter(busy))
    segments = written(source.mapInArrow(partial(_shipped, window=window, shared=shared, hot=hot), schema(_SEGMENTS)), "segments")
    settled = segments.where("words is null").select("doc_id", F.col("start").alias("first"), (F.col("start") + F.col("windows") + window - 1).cast("int").alias("last"))
    open_rows = segments.where("words is not null")
    shards = max(1, -(-open_rows.count() // SHARD_SEGMENTS))
    sharded = open_rows.select(F.pmod(F.xxhash64("route"), F.lit(shards)).alias("shard"), "doc_id", "start", "words")
    found = sharded.groupBy("shard").applyInPandas(partial(_shard_spans, window=window), schema(_SPANS))
    return settled.unionByName(found)


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """Documents -> doc_id, n_words, n_removed, kept (what stays, words joined by one space).

    Words are runs outside 0x20 and 0x09-0x0D, unchanged.  A word goes if a window of
    `window` (4 or more) words over it also starts earlier: in a smaller doc_id, or
    earlier in the document.  Windows are judged on the input.

    Null and empty texts have no words.  Of rows repeated under one doc_id the one with the least
    text counts; rows with a null doc_id are left out; other columns are not read; an empty table gives no rows.
    Long texts are taken whole: a text longer than a slice of 1 MB makes a slice of its own, of some 50 bytes for each of its own.
    """
    source = one_row_per_id(ids_and_texts(docs))
    spans = repeated_spans(source, window).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    return source.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_kept, schema("doc_id long, n_words long, n_removed long, kept string"))


def without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """The documents with the repeated words taken out of the texts in which there are any; a text of which
    nothing stays is dropped.  Texts without repeats stay as they are, null and empty ones too.  Needs a long n_chars column;
    other columns are kept, whatever they are called."""
    docs = one_row_per_id(docs)
    spans_in = free_name(docs, "spans")
    spans = repeated_spans(ids_and_texts(docs), window).groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias(spans_in))
    return docs.join(spans, "doc_id", "left").select(*docs.columns, spans_in).mapInArrow(partial(_cleaned, spans_in=spans_in), docs.schema)
