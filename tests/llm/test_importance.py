"""The quality model worked out by hand: weights, means, odds and the bound."""

import math
import random
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from matchloom.llm.hashed import BUCKETS, buckets
from matchloom.llm.importance import _bound, _log_odds, _models, importance
from matchloom.llm.rules import counted_labels

HALF = "pmod(doc_id, 2)"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    good, low, toxic = ([f"{c}{i}" for i in range(n)] for c, n in (("g", 30), ("l", 30), ("t", 3)))
    rows, labels = [], []
    for i in range(600):
        kind = rng.choice(["good", "good", "low", "toxic"])
        words = [rng.choice(low if kind == "low" and rng.random() < 0.5 else toxic if kind == "toxic" and rng.random() < 0.3 else good) for _ in range(rng.randint(5, 60))]
        rows.append((i, " ".join(words) + rng.choice(["", ".", "!!"])))
        if i % 4:
            labels.append((i, kind == "low", kind == "toxic"))
    rows += [(700, None), (701, "")]
    return rows, labels, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, low boolean, toxic boolean")


def of(text):
    return buckets(pa.array([text or ""]))[0].tolist()


def weights_by_hand(rows, labels):
    texts, out = dict(rows), np.zeros((2, 2, BUCKETS))
    raw, raw_texts = Counter(), Counter()
    for _, t in rows:
        raw.update(of(t))
        raw_texts.update(set(of(t)))
    for judged in (0, 1):
        clean, clean_texts, toxic_texts, n, m = Counter(), Counter(), Counter(), 0, 0
        for i, low, toxic in labels:
            if i % 2 == judged:
                continue
            if toxic:
                toxic_texts.update(set(of(texts[i])))
                m += 1
            elif not low:
                clean.update(of(texts[i]))
                clean_texts.update(set(of(texts[i])))
                n += 1
        total, good = sum(raw.values()), sum(clean.values())
        for b in raw:
            share = (raw[b] + 1) / (total + BUCKETS)
            x, y = raw[b] + BUCKETS * share, clean[b] + BUCKETS * share
            out[judged, 0, b] = math.log(x / (total + BUCKETS)) - math.log(y / (good + BUCKETS))
            share = (raw_texts[b] + 0.5) / (len(rows) + 1)
            x, y = toxic_texts[b] + 5 * share, clean_texts[b] + 5 * share
            ratio = math.log(x / (m + 5)) - math.log(y / (n + 5))
            out[judged, 1, b] = math.copysign(max(0.0, abs(ratio) - 3 * math.sqrt(1 / x + 1 / y)), ratio)
    return out, set(raw)


def test_weights_of_both_halves(corpus):
    rows, labels, docs, known = corpus
    got = _models(docs, known, F.expr(HALF), 10_000)
    want, seen = weights_by_hand(rows, labels)
    at = sorted(seen)
    assert np.allclose(got[:, :, at], want[:, :, at])
    assert np.abs(got[:, 1, at]).max() > 0


def test_odds_are_calibrated_and_rise_with_the_mean(spark):
    """With an intercept, a logistic curve expects as many bad rows as there are."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 800)
    low = rng.random(800) < 1 / (1 + np.exp(-(2 * x - 1)))
    table = spark.createDataFrame([(float(a), bool(b), False) for a, b in zip(x, low, strict=True)], "low_mean double, low boolean, toxic boolean")
    got = table.select("low_mean", "low", _log_odds(table, "low").alias("o")).toPandas()
    p = 1 / (1 + np.exp(-got["o"]))
    assert p.sum() == pytest.approx(low.sum(), rel=0.01)
    order = got.sort_values("low_mean")["o"].to_numpy()
    assert (np.diff(order) >= 0).all() and np.corrcoef(got["o"], 2 * got["low_mean"] - 1)[0, 1] > 0.99
    # a mean that falls with the odds says nothing, and one kind alone has no odds
    turned = table.withColumn("low_mean", -F.col("low_mean"))
    assert turned.select(_log_odds(turned, "low").alias("o")).distinct().count() == 1
    assert _log_odds(table.where("not low"), "low") is None


def test_bound_has_the_least_expected_error(spark):
    rng = random.Random(4)
    rows = [(rng.gauss(0, 0.3), True) for _ in range(200)] + [(rng.gauss(-3, 1.0), False) for _ in range(120)]
    found = counted_labels(spark.createDataFrame(rows, "value double, good boolean"), 100)
    bound = _bound(found, 5.0)

    def error(b):
        # a key is the weight and a Gumbel draw, so it lies under b with probability exp(-exp(weight - b))
        under = [math.exp(-math.exp(min(w - b, 50))) for w, _ in rows]
        return sum(5 * u if good else 1 - u for u, (_, good) in zip(under, rows, strict=True))

    best = min(error(-8 + 0.05 * i) for i in range(240))
    assert error(bound) <= best * 1.02 + 1e-9
    assert _bound(found[found.bad > 10**9], 5.0) is None


def test_keys_draw_the_largest(spark, corpus):
    """The k kept are those with the largest keys, and lower weights are kept less often."""
    _, labels, docs, _ = corpus
    table = spark.createDataFrame([(i, 0 if low else 1, int(toxic)) for i, low, toxic in labels], "doc_id long, quality int, toxic int")
    got = importance(docs, table, keep=50).toPandas().sort_values("key", ascending=False)
    assert got["kept"].tolist() == [True] * 50 + [False] * (len(got) - 50)
    free = importance(docs, table).toPandas().set_index("doc_id")
    bad = [i for i, low, toxic in labels if low or toxic]
    good = [i for i, low, toxic in labels if not (low or toxic)]
    assert free.loc[good, "kept"].mean() > 0.95 > free.loc[bad, "kept"].mean()
    assert free.loc[700, "log_weight"] == free.loc[701, "log_weight"] == 0.0
    assert brute.words(None) == []
