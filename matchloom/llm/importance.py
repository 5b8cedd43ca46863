"""Quality by importance resampling.

A document's importance is 1 / (1 + odds of low text + odds of toxic text), over the share of clean
rows.  Adding a Gumbel draw to its logarithm and taking the k largest keys samples k documents
without replacement, with chances in proportion to the importance.

Both odds come from models over hashed words and word pairs, each a mean of log ratios over
the text's n-grams, so that a long text has no other range than a short one.  For low text
the raw text of every document is held against the target's, labelled clean documents.  As toxic
text differs from it in few words alone, its contrast is labelled toxic documents: ratios of numbers of
texts, drawn back to 0 by three standard errors.

Labelled rows (at most `sample`) train two models, each on one half by a hash; a
document is judged by the model of the other half, so no label judges itself.
What a mean says about the odds is a logistic curve through all labelled rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashed import BUCKETS, class_counts, drawn_labels, summed
from .rules import label_rows, counted_labels
from .tables import ids_and_texts, written

_KINDS = ["low", "toxic"]


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a column, by ever finer histograms; None if there are fewer than k or k < 1."""
    values = df.select(F.col(column).alias("x")).where("x is not null")
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("*")).first()
    if k < 1 or n < k:
        return None
    above = 0
    while low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        place = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1))
        parts = values.where(F.col("x").between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        for row in sorted(parts.collect(), key=lambda r: -r.b):
            if above + row.n >= k:
                low, high = row.lo, row.hi
                break
            above += row.n
    return low


def _log_ratio(bad: np.ndarray, good: np.ndarray, of: tuple[float, float], share: np.ndarray, prior: float, errors: float) -> np.ndarray:
    """log(bad / good) for each bucket, drawn back to 0 by so many standard errors; prior: the weight of the raw text's share."""
    bad, good = bad + prior * share, good + prior * share
    ratio = np.log(bad / (of[0] + prior)) - np.log(good / (of[1] + prior))
    return np.sign(ratio) * np.maximum(0.0, np.abs(ratio) - errors * np.sqrt(1 / bad + 1 / good))


def _models(source: DataFrame, known: DataFrame, half: Column, sample: int) -> np.ndarray:
    """Weights [half that is judged, kind, bucket]; without clean labels, or labels of a kind to learn from, zeros."""
    # at most `sample` ids
    drawn = drawn_labels(known, sample).where("toxic or not low").withColumn("class", (half * 2 + F.col("toxic").cast("int")).cast("int"))
    texts = source.join(F.broadcast(drawn), "doc_id").select("text", "class")
    counts, in_texts = class_counts(texts, 4, texts=True).reshape(2, 2, 2, BUCKETS)
    number = np.zeros(4)
    for row in texts.groupBy("class").count().collect():
        number[row["class"]] = row["count"]
    raw, raw_texts = class_counts(source.withColumn("class", F.lit(0)), 1, texts=True)
    share, share_texts = (raw + 1) / (raw.sum() + BUCKETS), (raw_texts + 0.5) / (source.count() + 1)
    weights = np.zeros((2, 2, BUCKETS))
    for judged in range(2):
        (clean, _), (clean_texts, toxic_texts), n = counts[1 - judged], in_texts[1 - judged], number.reshape(2, 2)[1 - judged]
        if n[0]:
            weights[judged, 0] = _log_ratio(raw, clean, (raw.sum(), clean.sum()), share, BUCKETS, 0)
        if n[0] and n[1]:
            weights[judged, 1] = _log_ratio(toxic_texts, clean_texts, (n[1], n[0]), share_texts, 5, 3)
    return weights


def _log_odds(judged: DataFrame, kind: str) -> Column | None:
    """The log odds of a kind against clean by its mean, from all labelled rows of both; None if one of them has none."""
    value = F.col(f"{kind}_mean")
    both = judged.where(F.col(kind) | ~(F.col("low") | F.col("toxic"))).select(value.alias("value"), (~F.col(kind)).alias("good"))
    middle, spread = both.agg(F.avg("value"), F.stddev_pop("value")).first()
    if not spread:
        return None
    found = counted_labels(both.withColumn("value", (F.col("value") - middle) / spread), 100)
    x = np.stack([found.value.to_numpy() + 0.005, np.ones(len(found))], axis=1)
    bad, n = found.bad.to_numpy(float), (found.bad + found.good).to_numpy(float)
    if not bad.sum() or bad.sum() == n.sum():
        return None
    line = np.zeros(2)
    for _ in range(100):  # Newton's steps, held short; the small ridge keeps the curve finite where the kinds part
        p = 1 / (1 + np.exp(-np.clip(x @ line, -50, 50)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (n * p - bad) + 1e-3 * line)
        line -= step * min(1.0, 3 / max(1e-9, np.abs(step).max()))
    # a mean that falls with the odds says nothing
    slope = max(0.0, float(line[0]))
    return F.greatest(F.lit(-40.0), F.least(F.lit(40.0), (value - middle) / spread * slope + float(line[1])))


def _bound(found: pd.DataFrame, cost: float) -> float | None:
    """The key below which rejecting costs least, as expected over the Gumbel draws; None if rejecting costs more than it saves."""
    weight, good, bad = (found[c].to_numpy(float) for c in ("value", "good", "bad"))
    if not len(weight):
        return None
    bounds = np.arange(weight.min() - 4, weight.max() + 4, 0.02)
    gain = [((bad - cost * good) * np.exp(-np.exp(np.minimum(weight - b, 50)))).sum() for b in bounds]
    return float(bounds[int(np.argmax(gain))]) if max(gain) > 0 else None


def importance(docs: DataFrame, labels: DataFrame, keep: int | None = None, sample: int = 20_000, cost: float = 5.0, seed: int = 11) -> DataFrame:
    """Documents -> doc_id, n_tokens, log_weight, key, kept.

    keep: how many documents the Gumbel top-k takes (more, if keys tie).  Without it k is
    calibrated, from the weights alone: as many as are expected to have a key no lower than the bound with the least error expected
    of all labelled rows' draws, where a clean row lost counts as `cost` low or toxic rows kept; the draw then takes the k largest
    keys.  With no labelled good row, or none of the others, everything is kept.

    A null or empty text has log weight 0; long texts are taken whole, in slices.  Rows repeated under one doc_id share the
    draw; rows with a null doc_id are left out; other columns are not read; an empty table gives no rows.
    Words and pairs that share one of the 65,536 hash buckets count as one.
    """
    source = ids_and_texts(docs)
    known = label_rows(labels).select("doc_id", (F.col("quality") != 1).alias("low"), (F.col("toxic") != 0).alias("toxic"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2))
    weights = _models(source, known, half, sample)
    # the last sum counts the n-grams
    means = written(
        summed(source, np.concatenate([weights.reshape(4, BUCKETS), np.ones((1, BUCKETS))])).select(
            "doc_id", "n_tokens", *[(F.get("sums", (half * 2 + i).cast("int")) / F.greatest(F.col("sums")[4], F.lit(1.0))).alias(f"{kind}_mean") for i, kind in enumerate(_KINDS)]
        ), "means",
    )
    judged = means.join(known, "doc_id")
    odds = [F.exp(x) for kind in _KINDS if (x := _log_odds(judged, kind)) is not None]
    if odds:
        clean = judged.agg(F.avg((~(F.col("low") | F.col("toxic"))).cast("double"))).first()[0]
        log_weight = F.when(F.col("n_tokens") > 0, -F.log1p(sum(odds, F.lit(0.0))) - F.lit(float(np.log(clean)))).otherwise(0.0)
    else:
        # the mean ratio, for a text of the usual length
        log_weight = -F.col("low_mean") * F.lit(float(means.agg(F.avg("n_tokens")).first()[0] or 0))
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = means.withColumn("log_weight", log_weight).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))).select("doc_id", "n_tokens", "log_weight", "key")
    if keep is None:
        rows = keyed.join(known, "doc_id").select(F.col("log_weight").alias("value"), (~(F.col("low") | F.col("toxic"))).alias("good"))
        bound = _bound(counted_labels(rows, 100), cost) if odds else None
        # as many as are expected above the bound over all draws, whatever this draw gives
        keep = None if bound is None else round(keyed.agg(F.sum(-F.expm1(-F.exp(F.col("log_weight") - F.lit(bound))))).first()[0] or 0.0)
    # the Gumbel top-k: everything down to the k-th largest key
    bound = None if keep is None else float("inf") if keep < 1 else kth_largest(keyed, "key", keep)
    return keyed.withColumn("kept", F.lit(True) if bound is None else F.col("key") >= F.lit(bound))


def good_documents(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that importance keeps, with their columns."""
    return docs.join(importance(docs, labels, **settings).where("kept").select("doc_id").distinct(), "doc_id", "left_semi")
