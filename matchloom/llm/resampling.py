"""Importance resampling towards a target's distribution of hashed word runs.

Features are all runs of 1 to 3 words, each in one of BUCKETS buckets by the CRC-32 of its bytes.  A bucket's gain is a whole number, from its
shares in the target and in all documents.

Bit-sliced aggregation.  The bucket counts of a document are written as planes of BUCKETS bits: plane i holds bit i of every count.  So are
the gains, with planes of their own for positive and negative ones.  A document's weight, the sum of count times gain, is the sum over all pairs of planes
of 2^(i + j) times the number of bits set in both, less the same for the negative planes: whole numbers throughout, so the weights are exact.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .importance import kth_largest
from .spans import Spans, byte_set, runs_outside
from .tables import ids_and_texts, schema, written
from .text import slices

BUCKETS, LONGEST = 10_000, 3
#: texts whose planes are held at once
BLOCK = 256
_LONG_WORD = 48
_WORDS = runs_outside(byte_set(bytes([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])))


@lru_cache(1)
def _byte_table() -> np.ndarray:
    """The CRC-32 table, by its polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


@lru_cache(1)
def _shift_tables() -> np.ndarray:
    """[i, byte of the value, byte]: what a CRC becomes when 2^i bytes follow, before theirs is added; linear, so a table for each byte does."""
    values = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    found = [_byte_table()[values & 255] ^ (values >> 8)]
    for _ in range(31):
        found.append(_shifted(found[-1], found[-1]))
    return np.stack(found)


def _shifted(crc: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


def followed_by(crc: np.ndarray, sizes: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The CRC-32 of strings one after the other, from the first's, and the second's size and CRC-32."""
    out = crc.copy()
    for i, table in enumerate(_shift_tables()):
        if not (sizes >> i).any():
            break
        some = (sizes >> i) & 1 == 1
        out[some] = _shifted(out[some], table)
    return out ^ rest


def word_crcs(words: Spans) -> np.ndarray:
    """The CRC-32 of every word, byte place by byte place; long words one by one."""
    sizes = words.ends - words.starts
    order = np.argsort(-np.where(sizes > _LONG_WORD, 0, sizes), kind="stable")
    starts, left, table = words.starts[order], np.where(sizes > _LONG_WORD, 0, sizes)[order], _byte_table()
    state = np.full(len(order), 0xFFFFFFFF, np.uint32)
    longer = len(order) - np.searchsorted(left[::-1], np.arange(_LONG_WORD + 1), "right")
    for place, n in enumerate(longer[:-1].tolist()):
        if not n:
            break
        s = state[:n]
        state[:n] = table[(s ^ words.data[starts[:n] + place]) & 255] ^ (s >> 8)
    out = np.empty(len(order), np.uint32)
    out[order] = ~state
    for i in np.flatnonzero(sizes > _LONG_WORD).tolist():
        out[i] = zlib.crc32(words.data[words.starts[i] : words.ends[i]])
    return out


def features(texts: pa.Array) -> tuple[Spans, np.ndarray, np.ndarray]:
    """The words of the texts; bucket and text of each of their runs."""
    words = Spans(texts, _WORDS, lower=True)
    doc, crc, sizes = words.doc_of(), word_crcs(words), words.ends - words.starts
    spaced = followed_by(np.full(len(crc), zlib.crc32(b" "), np.uint32), sizes, crc)
    run, buckets, docs = crc, [crc], [doc]
    for k in range(1, LONGEST):
        m = max(0, len(crc) - k)
        run = followed_by(run[:m], sizes[k : k + m] + 1, spaced[k : k + m])
        whole = doc[:m] == doc[k : k + m]
        buckets.append(run[whole])
        docs.append(doc[:m][whole])
    return words, (np.concatenate(buckets) % BUCKETS).astype(np.int64), np.concatenate(docs)


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in slices(batches, "text"):
        total += np.bincount(features(batch.column("text"))[1], minlength=BUCKETS)
    bucket = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(total[bucket])], names=["bucket", "n"])


def bucket_totals(texts: DataFrame) -> np.ndarray:
    """How many features of all texts fall into each bucket."""
    got = texts.select("text").mapInArrow(_totals, schema("bucket int, n long")).groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target's share / raw share)), one added to every bucket."""
    s, t = float(raw.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((b + 1.0) * s / ((a + 1.0) * t))) for a, b in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def _words_of(bits: np.ndarray) -> np.ndarray:
    """Rows of BUCKETS bits as rows of 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)]).view(np.uint64)


def planes(values: np.ndarray) -> np.ndarray:
    """[i, row, word]: bit i of every number, packed; as many planes as the largest number needs."""
    return np.stack([_words_of((values >> i) & 1 == 1) for i in range(max(1, int(values.max(initial=0)).bit_length()))])


def bit_sliced_weights(counts: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """For each row of counts the sum of count times gain; up, down: the planes of positive gains and of negative ones without their sign."""
    out = np.zeros(len(counts), np.int64)
    for i, plane in enumerate(planes(counts)):
        rows = np.flatnonzero(plane.any(axis=1))
        some = plane[rows]
        for signed, sign in ((up, 1), (down, -1)):
            for j, gain in enumerate(signed):
                out[rows] += sign * (np.bitwise_count(some & gain).sum(axis=1, dtype=np.int64) << (i + j))
    return out


def _weighed(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    gains = shared.value
    up, down = planes(np.maximum(gains, 0)[None])[:, 0], planes(np.maximum(-gains, 0)[None])[:, 0]
    for batch in slices(batches, "text"):
        words, bucket, doc = features(batch.column("text"))
        order = np.argsort(doc, kind="stable")
        bucket, doc = bucket[order], doc[order]
        weights = np.zeros(batch.num_rows, np.int64)
        cuts = np.searchsorted(doc, [*range(0, batch.num_rows, BLOCK), batch.num_rows])
        for at, a, b in zip(range(0, batch.num_rows, BLOCK), cuts, cuts[1:], strict=False):
            n = min(BLOCK, batch.num_rows - at)
            counts = np.bincount((doc[a:b] - at) * BUCKETS + bucket[a:b], minlength=n * BUCKETS).reshape(n, BUCKETS)
            weights[at : at + n] = bit_sliced_weights(counts, up, down)
        columns = [batch.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array(np.bincount(doc, minlength=batch.num_rows), pa.int64()), pa.array(weights)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])


def ranked(df: DataFrame, *order) -> DataFrame:
    """The rows with their rank in the whole table's order: ranges of rows are numbered each, behind the totals of those before them."""
    cut = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = cut.groupBy("_range").agg(F.count("*").alias("_n"))
    # one row for each range, as many as there are shuffle partitions
    before = totals.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return cut.join(F.broadcast(before), "_range").withColumn("rank", within + F.col("_before")).drop("_range", "_before")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42) -> DataFrame:
    """Documents and the target's texts -> doc_id, n_features, weight, score, rank of every document.

    score: the weight and a Gumbel draw, in thousandths, by the document's id and the seed.  The floor(percent N / 100) highest scores of the N
    documents with `least_words` words or more are drawn: their rank is their turn, ties to the smaller doc_id; the others have none.

    Null and empty texts have no features, weight 0 and are never drawn; without a target text the gains tell only of the documents' own rare
    features.  Long texts are taken whole, in slices.  Rows repeated under one doc_id share the draw and are judged each; equal ones may stand in
    either order.  Rows with a null doc_id are left out, other columns are not read; an empty table gives no rows.
    """
    source = ids_and_texts(docs)
    gains = bucket_gains(bucket_totals(source), bucket_totals(target.select(F.col("text").cast("string").alias("text"))))
    # BUCKETS numbers
    shared = source.sparkSession.sparkContext.broadcast(gains)
    weighed = source.mapInArrow(partial(_weighed, shared=shared), schema("doc_id long, n_words long, n_features long, weight long"))
    draw = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((draw + 0.5) / 4294967296.0)))
    scored = written(weighed.withColumn("score", F.col("weight") + gumbel), "scores")
    able = scored.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    lowest = kth_largest(able, "score", k)
    if lowest is None:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    best = F.col("score") >= F.lit(lowest)
    drawn = ranked(able.where(best), F.desc("score"), F.asc("doc_id"), F.asc("n_features"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")).cast("long"))
    rest = scored.where((F.col("n_words") < least_words) | ~best).withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn.select(*columns).unionByName(rest.select(*columns))
