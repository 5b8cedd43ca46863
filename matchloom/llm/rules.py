"""Quality rules: an isolation forest on rule statistics.

Every text gets its rule statistics.  A forest is grown on at most `sample` labelled
good rows with a small share of bad ones among them: its splits then reach as far as the bad rows do, and these
stay rare enough to stand apart.  A document's anomaly is 2^(-mean path length / expected length).  The
threshold makes the least error over all labelled rows, good and bad.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import ids_and_texts, schema, written
from .text import Words, grams, mix, slices

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in STATISTICS)


def _per_text(places: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """How many of the ascending places lie between neighbouring edges."""
    return np.diff(np.searchsorted(places, edges))


def _repeated(keys: np.ndarray) -> np.ndarray:
    _, place, n = np.unique(keys, return_inverse=True, return_counts=True)
    return n[place] > 1


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        words = Words(batch.column("text"))
        data, texts = words.data, len(words.first) - 1
        spaced = np.isin(data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
        points = np.flatnonzero(~spaced & ((data & 0xC0) != 0x80))
        symbols = np.flatnonzero(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8)))

        # lines that hold a word, named by text and content
        newline = np.flatnonzero(data == 10)
        begins = np.unique(np.concatenate([words.offsets[:-1], newline + 1]))
        begins = begins[begins < len(data)]
        # a line stops at the next newline from its begin on, or at the end of its text
        stop_of = np.minimum(np.append(newline, len(data))[np.searchsorted(newline, begins)], words.offsets[np.searchsorted(words.offsets, begins, "right")])
        held = np.searchsorted(words.starts, stop_of) > np.searchsorted(words.starts, begins)
        begins, stop_of = begins[held], stop_of[held]
        text_of = np.searchsorted(words.offsets, begins, "right") - 1
        lines = words.spans(begins, stop_of) ^ mix(text_of.astype(np.uint64))
        first = np.zeros(len(lines), bool)
        first[np.unique(lines, return_index=True)[1]] = True
        dup_lines = np.bincount(text_of[~first], minlength=texts)

        # words in windows of three that a text has twice or more
        doc = words.doc_of()
        threes = grams(words.names, 3)
        inside = doc[: len(threes)] == doc[len(doc) - len(threes) :]
        again = np.zeros(len(doc) + 2, bool)
        again[np.flatnonzero(inside)[_repeated(threes[inside] ^ mix(doc[: len(threes)][inside].astype(np.uint64)))]] = True
        covered = again[: len(doc)].copy()
        covered[1:] |= again[: max(0, len(doc) - 1)]
        covered[2:] |= again[: max(0, len(doc) - 2)]
        repeats = np.bincount(doc[covered], minlength=texts)

        columns = [words.counts(), _per_text(points, words.offsets), _per_text(symbols, words.offsets), dup_lines, repeats]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *STATISTICS])


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the five counts of each whole text; null and empty texts count nothing."""
    return ids_and_texts(docs).mapInArrow(_statistics, schema(_SCHEMA))


def features() -> list:
    """Logs, as most rates are 0 or near it and a random split falls evenly over their range."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [F.log1p("n_words"), F.log1p(F.col("word_chars") / n), *(F.log1p(100 * F.col(c) / n) for c in STATISTICS[2:])]


def _expected(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.maximum(n, 1).astype(float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits, as arrays (tree, node); a leaf has feature -1."""

    def __init__(self, rows: np.ndarray, trees: int = 200, per_tree: int = 512, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.per_tree = min(per_tree, max(1, len(rows)))
        depth = max(1, int(np.ceil(np.log2(max(2, self.per_tree)))))
        nodes = 2 ** (depth + 1) - 1
        self.depth = depth
        self.feature = np.full((trees, nodes), -1, np.int64)
        self.cut = np.zeros((trees, nodes))
        self.path = np.zeros((trees, nodes))
        for t in range(trees if len(rows) else 0):
            todo = [(0, 0, rows[rng.choice(len(rows), self.per_tree, replace=False)])]
            while todo:
                node, level, part = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                wide = np.flatnonzero(high > low)
                if level == depth or len(part) < 2 or not len(wide):
                    self.path[t, node] = level + _expected(np.array(len(part)))
                    continue
                f = rng.choice(wide)
                cut = rng.uniform(low[f], high[f])
                self.feature[t, node], self.cut[t, node] = f, cut
                left = part[:, f] <= cut
                todo += [(2 * node + 1, level + 1, part[left]), (2 * node + 2, level + 1, part[~left])]

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        total = np.zeros(len(rows))
        every = np.arange(len(rows))
        for feature, cut, path in zip(self.feature, self.cut, self.path, strict=True):
            node = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                node = np.where(f < 0, node, 2 * node + 1 + (rows[every, f] > cut[node]))
            total += path[node]
        scale = float(_expected(np.array(self.per_tree))) or 1.0
        return 2.0 ** (-total / len(self.feature) / scale)


def _scored(batches: Iterator[pa.RecordBatch], forest: IsolationForest) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.stack([batch.column(f"f{i}").to_numpy() for i in range(len(STATISTICS))], axis=1)
        columns = [*(batch.column(c) for c in ["doc_id", *STATISTICS]), pa.array(forest.anomaly(rows))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *STATISTICS, "anomaly"])


def label_rows(labels: DataFrame) -> DataFrame:
    """One row per labelled doc_id: the least quality, the most toxic; a null toxic counts as 0, a null quality is no label."""
    return (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    )


def counted_labels(rows: DataFrame, scale: int) -> pd.DataFrame:
    """value, good -> value, good, bad: how many rows of each, over all rows, in rising steps of 1 / scale within -40 to 40."""
    step = F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("value"))) * scale)
    # at most 80 * scale + 1 rows
    found = rows.groupBy(step.alias("b")).agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")).toArrow().to_pandas().sort_values("b")
    return found.assign(value=found.b / scale)


def _threshold(found: pd.DataFrame, cost: float, step: float = 1e-3) -> float | None:
    """The value from which on rejecting costs least, where a good row rejected counts as `cost` bad ones kept; None if it saves nothing.

    Of equal ones the highest, moved half way down to the next labelled row, which it may reject as little.
    """
    good, bad = found.good.to_numpy(float), found.bad.to_numpy(float)
    gain = (bad - cost * good)[::-1].cumsum()[::-1]
    if not len(gain) or gain.max() <= 0:
        return None
    at = int(np.flatnonzero(gain == gain.max())[-1])
    value = found.value.to_numpy(float)
    return float(value[at]) if at == 0 else float(value[at] + value[at - 1] + step) / 2


def quality_rules(docs: DataFrame, labels: DataFrame, min_words: int = 50, max_repeat_percent: int = 50, sample: int = 20_000, share: float = 0.02, cost: float = 2.0) -> DataFrame:
    """Documents -> doc_id, the five counts, anomaly, base_failed, kept.

    base_failed: fewer than min_words words, or more than max_repeat_percent of them in
    repeated windows.  kept: not base_failed, and an anomaly below the threshold.
    The threshold is the one with the least error, where a labelled good row rejected counts as `cost` labelled
    bad rows kept, over all labelled rows that pass the base rules; of equal ones the highest.
    With no labelled row of either kind there, or if no threshold saves anything, base_failed alone decides.
    share: how many bad rows there are for each good one that the forest is grown on.

    Null and empty texts have no words and fail; long texts are taken whole, in slices.  Rows repeated under one doc_id are
    each judged; rows with a null doc_id are left out; other columns are not read; an empty table gives no rows.
    """
    numbers = [x.alias(f"f{i}") for i, x in enumerate(features())]
    stats = written(rule_statistics(docs).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    ), "statistics")
    known = label_rows(labels).select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    passed = stats.where("not base_failed").join(known, "doc_id")
    names = [f"f{i}" for i in range(len(numbers))]
    # the forest's rows: a bounded sample in the order of a hash
    rows = passed.select("doc_id", "good", *numbers).orderBy(F.xxhash64("doc_id"), "doc_id", *names)
    sound = rows.where("good").limit(sample).toArrow().to_pandas()
    drawn = pd.concat([sound, rows.where("not good").limit(max(1, round(share * len(sound)))).toArrow().to_pandas()])
    forest = IsolationForest(drawn[names].to_numpy(float))
    score = partial(_scored, forest=forest)
    kinds = schema(_SCHEMA + ", anomaly double")
    judged = passed.select("doc_id", *STATISTICS, *numbers).mapInArrow(score, kinds).join(known, "doc_id")
    bound = _threshold(counted_labels(judged.select(F.col("anomaly").alias("value"), "good"), 1000), cost) if len(sound) else None
    found = stats.select("doc_id", *STATISTICS, *numbers).mapInArrow(score, kinds)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_percent)
    fine = F.lit(True) if bound is None else F.col("anomaly") < F.lit(bound)
    return found.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine)
