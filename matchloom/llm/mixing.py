"""Mixing to target weights with soft domain membership.

A classifier over hashed words and word pairs, trained on labelled rows, gives every
document posterior probabilities over the domains.  Nonnegative rates r, one per
document, are then fitted by projected gradients to the least squares problem

    minimise  sum over domains d of (sum over documents i of r_i n_i p_id - T_d)^2

starting at r = 1.  The gradient of all documents is a function of one number per
domain, summed by Spark in each step; a document replays the steps so far from its
posteriors, so no rates are moved or stored between steps.  Steps are preconditioned by
the domain Gram matrix of the documents whose rate is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed import BUCKETS, class_counts, drawn_labels, summed
from .rules import label_rows
from .tables import free_name, ids_and_texts, schema, written
from .text import lists

DOMAINS = ["clean", "low", "toxic"]
TARGETS = {"clean": 0.96, "low": 0.02, "toxic": 0.02}
_TEMPERATURES = [1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0]


def _softmax(sums: str, temperature: float) -> Column:
    logits = F.transform(sums, lambda x: x / temperature)
    high = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - high))
    total = F.aggregate(exps, F.lit(0.0), lambda a, x: a + x)
    return F.transform(exps, lambda x: x / total)


def posteriors(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> DataFrame:
    """doc_id, n_tokens, p: an array of one probability per domain, for every document.

    At most `sample` labelled rows train the classifier; the softmax temperature is the one
    of a few under which all labelled documents' domains are likeliest.  With no
    labels every domain is equally likely.
    """
    source = ids_and_texts(docs)
    domain = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).otherwise(0).cast("int")
    known = label_rows(labels).select("doc_id", domain.alias("class"))
    # at most `sample` rows
    counts = class_counts(source.join(F.broadcast(drawn_labels(known, sample)), "doc_id"), len(DOMAINS))
    share = counts.sum(axis=0) / max(1.0, counts.sum())
    totals = counts.sum(axis=1, keepdims=True)
    weights = np.log((counts + 0.1 + BUCKETS * share) / (totals + 1.1 * BUCKETS))
    weights -= weights.mean(axis=0)
    sums = written(summed(source, weights), "logits")
    best = 1.0
    if counts.sum():
        judged = sums.join(known, "doc_id")
        loss = [F.avg(-F.log(_softmax("sums", t)[F.col("class")] + 1e-12)) for t in _TEMPERATURES]
        found = judged.agg(*loss).first()
        best = min((x, t) for x, t in zip(found, _TEMPERATURES, strict=True))[1] if found[0] is not None else 1.0
    return sums.select("doc_id", "n_tokens", _softmax("sums", best).alias("p"))


def _rate(steps: list[list[float]]) -> Column:
    """A document's rate after the steps taken."""
    if not steps:
        return F.lit(1.0)
    dot = lambda s: sum((F.col("p")[d] * s[d] for d in range(len(steps[0]))), F.lit(0.0))
    return F.aggregate(F.array(*(F.array(*map(F.lit, s)) for s in steps)), F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - dot(s)))


def _totals(batches: Iterator[pa.RecordBatch], taken: np.ndarray, tries: np.ndarray) -> Iterator[pa.RecordBatch]:
    """For the steps taken and each next step tried: the task's domain totals and Gram matrix of the documents with a positive rate, as one row of numbers."""
    n = tries.shape[1]
    out = np.zeros((len(tries), n + n * n))
    for batch in batches:
        p = batch.column("p").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        tokens = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(float)
        rate = np.ones(len(p))
        for step in taken:
            rate = np.maximum(0.0, rate - p @ step)
        for i, step in enumerate(tries):
            r = np.maximum(0.0, rate - p @ step)
            out[i, :n] += (r * tokens) @ p
            out[i, n:] += ((p * (tokens * (r > 0))[:, None]).T @ p).ravel()
    yield pa.RecordBatch.from_arrays([lists(out.ravel(), np.array([0, out.size]), pa.float64())], names=["sums"])


def fitted_rates(mass: DataFrame, targets: list[float], steps: int = 100, tolerance: float = 1e-6) -> tuple[Column, float]:
    """The rate column for rows of n_tokens and p, under which domain totals come nearest to targets, and how
    far the farthest of them stays off, as a share of all.

    Each step tries the preconditioned gradient and the plain one at a few lengths, one of which always helps, and takes the best.
    Steps end when that share is within the tolerance, when the sum of squares falls by a thousandth no more (no rates meet the targets then, if a
    domain has too few likely documents, say), or after `steps`.
    """
    n, goal = len(targets), np.array(targets, float)
    taken: list[list[float]] = []

    def totals(tries: list[list[float]]) -> np.ndarray:
        task = partial(_totals, taken=np.array(taken).reshape(-1, n), tries=np.array(tries))
        parts = mass.select("p", "n_tokens").mapInArrow(task, schema("sums array<double>")).select(F.posexplode("sums").alias("place", "x"))
        found = parts.groupBy("place").agg(F.sum("x").alias("x")).toArrow().to_pandas()
        out = np.zeros(len(tries) * (n + n * n))
        out[found["place"]] = found["x"]
        return out.reshape(len(tries), -1)

    now = totals([[0.0] * n])[0]
    most = max(1e-12, float(np.linalg.eigvalsh(now[n:].reshape(n, n)).max(initial=0.0)))
    off = now[:n] - goal
    worst = lambda: float(np.abs(off).max() / max(1.0, goal.sum()))
    while worst() > tolerance and len(taken) < steps:
        matrix = now[n:].reshape(n, n)
        lead = np.linalg.lstsq(matrix + 1e-9 * max(1.0, np.trace(matrix)) * np.eye(n), off, rcond=None)[0]
        tries = [(lead * x).tolist() for x in (1.0, 0.5, 0.2, 0.05)] + [(off * x / most).tolist() for x in (1.0, 4.0, 16.0)]
        found = totals(tries)
        square = ((found[:, :n] - goal) ** 2).sum(axis=1)
        best = int(np.argmin(square))
        if square[best] >= (off**2).sum() * (1 - 1e-3):
            break
        taken.append(tries[best])
        now = found[best]
        off = now[:n] - goal
    return _rate(taken), worst()


def mixture(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = TARGETS, tokens: float | None = None, sample: int = 20_000, seed: int = 5) -> DataFrame:
    """Documents -> doc_id, n_tokens, p, rate, copies, residual.

    weights: the share of each domain in the mixture, scaled to sum 1; tokens: its size,
    by default that of the documents.  copies is the rate rounded up or down by a hash
    of doc_id, with its mean at the rate.  residual, one number for all rows, is how far the farthest domain's total stays off
    its target, as a share of all tokens: over 1e-6 only if no rates meet the targets.

    Null and empty texts have no tokens and even posteriors; long texts are taken whole, in slices.  Rows repeated under one
    doc_id each get the rate; rows with a null doc_id are left out; other columns are not read; an empty table gives no rows.
    Of temperatures that fit alike the lower one is taken.  Words that share one of the 65,536 hash buckets count as one word.
    """
    mass = written(posteriors(docs, labels, sample), "posteriors")
    total = tokens if tokens is not None else float(mass.agg(F.sum("n_tokens")).first()[0] or 0)
    scale = sum(weights.values()) or 1.0
    rate, residual = fitted_rates(mass, [total * weights.get(d, 0.0) / scale for d in DOMAINS])
    uniform = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return mass.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + uniform).cast("long")).withColumn("residual", F.lit(residual))


def mixed(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents, each as often as its copies say, with their columns, whatever these are called; a row without a doc_id goes."""
    copies, copy = free_name(docs, "copies"), free_name(docs, "copy")
    times = mixture(docs, labels, **settings).where("copies > 0").groupBy("doc_id").agg(F.max("copies").alias(copies))
    return docs.join(times, "doc_id").withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
