"""Hashed n-gram counts and scores, shared by the generative and the class models."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import schema
from .text import Words, grams, slices

BUCKETS = 1 << 16


def buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Words]:
    """(bucket, text) of each word, run of punctuation, and pair of neighbours, A-Z lowered."""
    words = Words(texts, lower=True, punctuation=True)
    doc = words.doc_of()
    pairs = grams(words.names, 2)
    inside = doc[: len(pairs)] == doc[len(doc) - len(pairs) :]
    found = np.concatenate([words.names, pairs[inside]])
    return (found % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([doc, doc[: len(pairs)][inside]]), words


def _counted(batches: Iterator[pa.RecordBatch], classes: int, texts: bool) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2 * classes if texts else classes, BUCKETS), np.int64)
    for batch in slices(batches, "text"):
        bucket, doc, _ = buckets(batch.column("text"))
        kinds = batch.column("class").to_numpy().astype(np.int64)
        total[:classes] += np.bincount(kinds[doc] * BUCKETS + bucket, minlength=classes * BUCKETS).reshape(classes, BUCKETS)
        if texts:
            doc, bucket = np.divmod(np.unique(doc * BUCKETS + bucket), BUCKETS)
            total[classes:] += np.bincount(kinds[doc] * BUCKETS + bucket, minlength=classes * BUCKETS).reshape(classes, BUCKETS)
    kind, bucket = np.nonzero(total)
    yield pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[kind, bucket])], names=["class", "bucket", "n"]
    )


def class_counts(docs: DataFrame, classes: int, texts: bool = False) -> np.ndarray:
    """text, class -> counts [class, bucket], over all rows; the result has a fixed size.

    texts: behind these, as many rows again that count the texts with the n-gram, not its places.
    """
    rows = docs.mapInArrow(partial(_counted, classes=classes, texts=texts), schema("class int, bucket int, n long"))
    got = rows.groupBy("class", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    out = np.zeros((2 * classes if texts else classes, BUCKETS))
    out[got["class"], got["bucket"]] = got["n"]
    return out


def _summed(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        bucket, doc, words = buckets(batch.column("text"))
        n = len(words.first) - 1
        sums = [np.bincount(doc, w[bucket], minlength=n) for w in weights]
        columns = [batch.column("doc_id"), pa.array(words.counts(), pa.int64()), pa.array(list(np.stack(sums, axis=1)), pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "sums"])


def summed(texts: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, text -> doc_id, n_tokens, sums: for each row of weights the sum over the text's n-grams."""
    return texts.select("doc_id", "text").mapInArrow(partial(_summed, weights=weights), schema("doc_id long, n_tokens long, sums array<double>"))


def drawn_labels(labels: DataFrame, sample: int) -> DataFrame:
    """At most sample rows of doc_id, class in the order of a hash."""
    return labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
