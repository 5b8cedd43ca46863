import hashlib
import math
import random
import re
import string
import zlib

import brute
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchloom.llm import queries as Q
from matchloom.llm.classlm import END, _classed, _number, _packed, _steps, _unpacked, class_scores, exchange_clusters, word_classes
from matchloom.llm.importance import good_documents, importance, kth_largest
from matchloom.llm.mixing import fitted_rates, mixed, mixture
from matchloom.llm.neardup import near_duplicates, one_of_each
from matchloom.llm.neighbours import nearest
from matchloom.llm.packing import packed
from matchloom.llm.repeats import repeated_windows, without_repeats
from matchloom.llm.rules import IsolationForest, quality_rules
from matchloom.llm.text import Words
from matchloom.llm.tokens import read_token_files, write_token_files
from matchloom.llm.urls import host_and_path, lexical_features, suffix_statistics, url_verdicts

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = list(enumerate(brute.texts()))
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 else "en", None, len(t or ""), "x", 1) for i, t in reversed(DOCS)]
    # a row without an id, and columns named as operators might name their own
    rows.append((None, "no id", None, None, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, token string, label int").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, int(len(t or "") > 60), int(i % 11 == 0)) for i, t in DOCS if i % 2 == 0] + [(4, 1, None), (None, 1, 0), (99_999, 1, 0), (6, None, 1)]
    return spark.createDataFrame(rows, LABELS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, width, percent):
    assert by_id(near_duplicates(docs, width, percent)) == brute.near_duplicates(DOCS, width, percent)


def test_near_duplicates_of_a_hot_group(spark):
    base = brute.words(brute.texts(1, 9)[0]) + [f"w{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        for j in range(i % 7):
            w[(i * 31 + j * 17) % len(w)] = f"new{i}-{j}"
        rows.append((i, " ".join(w)))
    got = by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))
    assert got == brute.near_duplicates(rows, 3, 85)


@pytest.mark.parametrize("own", ["apart", "shared", "nested"])
def test_near_duplicates_of_a_template(spark, own):
    """Pages of one template below the bound of the centre, whose own words are all different, from few, or those of one before with one more."""
    rng, rows = random.Random(own), []
    for i in range(400):
        words = {
            "apart": [f"o{i}_{j}" for j in range(11)],
            "shared": [f"p{rng.randrange(4)}_{j}" for j in range(5)] + [f"o{i % 50}_{j}" for j in range(7)] + [f"q{rng.randrange(60)}" for _ in range(2)],
            "nested": [f"n{i // 8}_{j}" for j in range(4 + i % 8)],
        }[own]
        rows.append((i, " ".join([f"c{j}" for j in range(40)] + words + [f"c{j}" for j in range(40, 91)])))
    got = by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85))
    assert got == brute.near_duplicates(rows, 3, 85)


def test_near_duplicates_of_a_large_template(spark):
    """5,000 pages of 91 common and 11 own words link with nothing, and make no pairs."""
    rows = spark.range(5000).select(
        F.col("id").alias("doc_id"),
        F.concat_ws(" ", *[F.lit(f"c{j}") for j in range(40)], *[F.concat(F.lit("o"), "id", F.lit(f"_{j}")) for j in range(11)], *[F.lit(f"c{j}") for j in range(40, 91)]).alias("text"),
    )
    got = near_duplicates(rows, 3, 85).agg(F.count("*"), F.count_if("kept")).first()
    assert tuple(got) == (5000, 5000)


def test_near_duplicates_of_repeated_ids(spark):
    """Of rows under one doc_id the least text counts, whatever the order of rows."""
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(1, base + " z"), (1, base + " a"), (2, base + " a"), (3, None), (3, "x"), (3, None), (4, base + " z")]
    least = {1: base + " a", 2: base + " a", 3: None, 4: base + " z"}
    for table in (rows, rows[::-1]):
        got = near_duplicates(spark.createDataFrame(table, "doc_id long, text string"), 3, 85).collect()
        assert len(got) == 4
        assert {r[0]: tuple(r)[1:] for r in got} == brute.near_duplicates(sorted(least.items()), 3, 85)


def test_near_duplicates_of_many_components_round_one_template(spark):
    """Families of near copies that differ from a common template alike, by too much to be linked with it."""
    rng = np.random.default_rng(12)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for family in range(12):
        own = list(base)
        for at in rng.choice(190, 6 + family, replace=False):
            own[at] = f"f{family}-{at}"
        for member in range(30):
            w = list(own)
            for at in rng.choice(190, member % 4, replace=False):
                w[at] = f"m{family}-{member}-{at}"
            rows.append((len(rows), " ".join(w)))
    assert by_id(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)) == brute.near_duplicates(rows, 3, 85)


def test_one_of_each(docs, empty):
    kept = one_of_each(docs)
    want = [i for i, x in brute.near_duplicates(DOCS, 5, 80).items() if x[2]]
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == want
    assert one_of_each(empty).isEmpty() and near_duplicates(empty).isEmpty()


@pytest.mark.parametrize("window", [4, 20, 33])
def test_repeats(docs, window):
    assert by_id(repeated_windows(docs, window)) == brute.repeats(DOCS, window)


def test_repeats_of_hot_routes(spark, monkeypatch):
    import matchloom.llm.repeats as R

    monkeypatch.setattr(R, "SHARD_SEGMENTS", 50)
    rows = [(i, f"a{i} b{i} the same very common line of words here c{i % 3} d{i % 2} " * 3) for i in range(400)]
    monkeypatch.setattr(R, "HOT", 100)
    got = by_id(repeated_windows(spark.createDataFrame(rows, "doc_id long, text string"), 10))
    assert got == brute.repeats(rows, 10)


def test_without_repeats(docs, empty):
    want = {i: x for i, x in brute.repeats(DOCS, 20).items() if not (x[1] and not x[2])}
    kept = without_repeats(docs.where("doc_id is not null"), 20)
    assert kept.columns == docs.columns
    texts = dict(DOCS)
    assert {r.doc_id: r.text for r in kept.collect()} == {i: x[2] if x[1] else texts[i] for i, x in want.items()}
    assert repeated_windows(empty).isEmpty()


def test_token_files(spark, docs, empty, tmp_path):
    write_token_files(docs, str(tmp_path / "a"), PATH, 1)
    whole, at = Tokenizer.from_file(PATH), 0
    want = {}
    for i, t in DOCS:
        ids = whole.encode(t or "", add_special_tokens=False).ids + [1]
        want[i] = (at, len(ids), np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert by_id(read_token_files(spark, str(tmp_path / "a"))) == {i: (a, n, bytearray(b)) for i, (a, n, b) in want.items()}
    write_token_files(empty, str(tmp_path / "b"), PATH, 1)
    assert read_token_files(spark, str(tmp_path / "b")).isEmpty()


def test_packing(docs, empty):
    size, whole = 64, Tokenizer.from_file(PATH)
    rows = packed(docs, PATH, 2, size).collect()
    texts, got, sequences = dict(DOCS), {}, {}
    for r in rows:
        ids = whole.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.doc_tokens == len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        got.setdefault(r.doc_id, []).append((r.start, r.length, len(ids)))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(got) == set(texts)
    for pieces in got.values():
        at = 0
        for start, n, total in sorted(pieces):
            assert start == at
            at += n
        assert at == total
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= size
    assert len(sequences) <= 1.05 * sum(r.length for r in rows) / size + 1
    assert packed(empty, PATH, 2).isEmpty()


def test_rules(docs, labels, empty):
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    assert set(got) == {i for i, _ in DOCS}
    for i, t in DOCS:
        n, chars, symbols, dup, again = brute.statistics(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, again), t
        assert r.base_failed == (n < 50 or 100 * again > 50 * n)
        assert not (r.base_failed and r.kept)
    assert quality_rules(empty, labels).isEmpty()
    alone = quality_rules(docs, labels.limit(0)).collect()
    assert all(r.kept != r.base_failed for r in alone)


def test_rules_threshold_reads_bad_labels(spark):
    words = lambda i, mark: " ".join(f"w{i}x{j}{mark if j % 2 else ''}" for j in range(60 + i % 50))
    # of 300 good rows, ten are full of symbols, as all 60 bad rows are
    table = spark.createDataFrame([(i, words(i, "##" if i >= 290 else "")) for i in range(360)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, int(i < 300), 0) for i in range(360) if i % 2], LABELS)
    for cost in (1.0, 2.0):
        rows = quality_rules(table, labelled, cost=cost).orderBy("doc_id").collect()
        kept, anomaly = np.array([r.kept for r in rows]), np.array([r.anomaly for r in rows])
        assert kept[:290].sum() >= 280 and kept[300:].sum() <= 30
        # no threshold on the anomalies makes less error over the labelled rows
        i = np.arange(360)
        error = lambda keep: cost * ((i % 2 == 1) & (i < 300) & ~keep).sum() + ((i % 2 == 1) & (i >= 300) & keep).sum()
        assert error(kept) <= min(error(anomaly < x) for x in np.floor(np.append(anomaly, 2) * 1000) / 1000)
    alone = quality_rules(table, labelled.where("quality = 0")).collect()
    assert all(r.kept for r in alone)


def test_forest_against_brute_force():
    rng = np.random.default_rng(3)
    rows = rng.normal(size=(300, 5))
    forest = IsolationForest(rows, trees=7, per_tree=64)

    def length(t, x, node=0, depth=0):
        if forest.feature[t, node] < 0:
            return forest.path[t, node]
        side = 2 if x[forest.feature[t, node]] > forest.cut[t, node] else 1
        assert depth <= forest.depth
        return length(t, x, 2 * node + side, depth + 1)

    def expected(n):
        return 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)

    wild = np.vstack([rows[:20], rows[:3] * 50])
    want = [2 ** -(sum(length(t, x) for t in range(7)) / 7 / expected(64)) for x in wild]
    assert forest.anomaly(wild) == pytest.approx(want)
    assert min(want[20:]) > max(want[:20]) - 0.1 and max(want) < 1


def test_importance_is_a_gumbel_top_k(spark):
    """kept are the k documents with the largest keys, and a key is the log weight with a Gumbel draw of the document's own."""
    rows = [(i, ("plain words of a good text number %d and so on " % i) * (1 + i % 3) if i % 4 else "### buy $$$ now %d" % i) for i in range(300)] + [(7, "again")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    some = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 300, 3)], LABELS)
    for keep in (None, 1, 40):
        got = importance(table, some, keep=keep).collect()
        keys = sorted((r.key for r in got), reverse=True)
        k = sum(r.kept for r in got)
        assert k == (keep or k) and all(r.kept == (r.key >= keys[k - 1]) for r in got)
        if keep is None:
            # k comes from the weights alone: the documents expected above the bound of least expected error
            weight = np.array([r.log_weight for r in got])
            sign = np.array([0 if r.doc_id % 3 else 1 if r.doc_id % 4 == 0 else -5 for r in got])
            grid = np.arange(weight.min() - 4, weight.max() + 4, 0.02)
            above = [-np.expm1(-np.exp(weight - b)) for b in grid]
            assert abs(k - above[int(np.argmax([(sign * (1 - p)).sum() for p in above]))].sum()) < 3
    draws = {}
    for r in got:
        draws.setdefault(r.doc_id, set()).add(round(r.key - r.log_weight, 9))
    assert all(len(x) == 1 for x in draws.values())
    mean, spread = np.mean([x for d in draws.values() for x in d]), np.std([x for d in draws.values() for x in d])
    assert abs(mean - 0.577) < 0.25 and abs(spread - 1.283) < 0.25


def test_importance(spark, docs, labels, empty):
    rows = [(i, ("plain words of a good text number %d and so on " % i) * 5) for i in range(200)]
    rows += [(i, ("$$$ ### buy%d !!! ||| now$$$ " % i) * 8) for i in range(200, 240)]
    few = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 240, 3)], LABELS)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in importance(table, few).where("kept").collect()}
    assert kept >= set(range(200)) and len(kept) <= 210
    assert importance(table, few, keep=17).where("kept").count() == 17
    assert importance(table, few, keep=0).where("kept").count() == 0
    assert importance(table, few.limit(0)).where("not kept").isEmpty()
    assert {r.doc_id for r in importance(docs, labels).collect()} == {i for i, _ in DOCS}
    assert importance(empty, labels).isEmpty()


def test_importance_reads_both_kinds_of_labels(spark):
    rng = np.random.default_rng(5)
    words, insults = [f"word{i}" for i in range(300)], ["dolt", "oaf", "cad"]
    kind = rng.choice(["clean", "low", "toxic"], 1500, p=[0.7, 0.15, 0.15])

    def text(k):
        found = rng.choice(words, rng.integers(5, 12) * 8 ** rng.integers(0, 3)).tolist()  # few words or many
        if k == "toxic":
            found[len(found) // 2 : 0] = [str(rng.choice(insults))] * (1 + len(found) // 50)
        return " | ".join(found) if k == "low" else " ".join(found)

    table = spark.createDataFrame([(i, text(k)) for i, k in enumerate(kind)], "doc_id long, text string")
    some = spark.createDataFrame([(i, int(k != "low"), int(k == "toxic")) for i, k in enumerate(kind) if i % 3], LABELS)
    kept = np.array([r.kept for r in importance(table, some).orderBy("doc_id").collect()])
    for k, low, high in (("clean", 0.98, 1), ("low", 0, 0.05), ("toxic", 0, 0.5)):
        assert low <= kept[kind == k].mean() <= high, k
    # without a kind of labels, nothing is rejected for it
    alone = importance(table, some.where("quality = 1 and toxic = 0"))
    assert alone.where("not kept").isEmpty()


def test_kth_largest(spark):
    x = np.random.default_rng(2).normal(size=2000).round(2).tolist()
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for k in (1, 2, 500, 2000):
        assert kth_largest(df, "x", k, bins=16) == sorted(x)[-k]
    assert kth_largest(df, "x", 2001) is None


def test_class_scores(docs, empty):
    got = {r.doc_id: r for r in class_scores(docs, heads=30, tails=16, least=2, classes=8).collect()}
    want = brute.unigrams(DOCS)
    assert set(got) == set(want)
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert class_scores(empty).isEmpty()


def test_class_model_beats_unigrams_on_held_out_texts(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        w = []
        for j in range(60):
            w.append(f"{'ab'[j % 2]}{rng.integers(40)}")
        rows.append((i, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    base, score = class_scores(table, heads=8, tails=8, classes=6).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base * 0.9


def test_class_scores_against_brute_force(spark):
    """Where every word is a head, classes come from the exchange over all pairs; the score is then worked out word by word."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"{'ab'[j % 2]}{rng.integers(6)}" for j in range(rng.integers(0, 30)))) for i in range(80)] + [(80, None), (81, "new Words b1")]
    got = by_id(class_scores(spark.createDataFrame(rows, "doc_id long, text string"), heads=1000, tails=4, classes=5))
    seqs = {i: [*map(str.lower, (t or "").split()), None] for i, t in rows}
    train = {i: x for i, x in seqs.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    counts: dict = {}
    for x in train.values():
        for w in x:
            counts[w] = counts.get(w, 0) + 1
    name = lambda w: int(END) if w is None else int(Words(pa.array([w]), lower=True).names[0])
    heads = sorted({name(w): w for w in counts}.items())
    units = {w: u for u, (_, w) in enumerate(heads)}
    pairs = np.zeros((len(heads) + 4,) * 2)
    for x in train.values():
        for a, b in zip([None, *x], x, strict=False):
            pairs[units[a], units[b]] += 1
    cls = np.unique(exchange_clusters(pairs, 5), return_inverse=True)[1]
    k = int(cls.max()) + 1
    of = lambda w: cls[units[w]] if w in units else None
    moves, tokens, words = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for x in train.values():
        for a, b in zip([None, *x], x, strict=False):
            moves[of(a), of(b)] += 1
    for w, n in counts.items():
        tokens[of(w)] += n
        words[of(w)] += 1
    for i, x in seqs.items():
        if all(w in units for w in x):  # an unseen word's class is that of its ending's unit
            want = sum(
                math.log10((moves[of(a), of(b)] + 1) / (moves[of(a)].sum() + k)) + math.log10((counts[b] + 1) / (tokens[of(b)] + words[of(b)] + 1))
                for a, b in zip([None, *x], x, strict=False)
            )
            assert got[i][5] == pytest.approx(want), i
    assert sum(all(w in units for w in x) for x in seqs.values()) > 60


def test_packed_places():
    rng = np.random.default_rng(5)
    for sizes in ([], [1], [3, 1, 2000, 1]):
        first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        places = rng.integers(0, 1 << rng.integers(1, 31, first[-1]))
        places[:5] = [0, 127, 128, (1 << 14) - 1, 1 << 28][: len(places)]
        got, begins = _unpacked(_packed(places, first))
        assert got.tolist() == places.tolist() and begins.tolist() == first.tolist()


@pytest.mark.parametrize("classes", [200, 256, 257, 700])
def test_many_classes_keep_their_numbers(classes):
    """Classes above 255 take two bytes each, and come back as they went in."""
    kind = _number(classes)
    places = [[0, 1, 2], [2], [1, 0]]
    texts = pd.DataFrame({"doc_id": [1, 2, 3], "words": _packed(np.concatenate(places), np.array([0, 3, 4, 6]))})
    words = pd.DataFrame({"place": [0, 1, 2], "n": [1, 0, 5], "class": [classes - 1, 0, classes // 2]})
    out = pa.RecordBatch.from_pandas(_classed(texts, words, kind))
    for batch in (out, out.slice(1)):
        before, cls, first = _steps(batch, 3, kind)
        want = [w for row in places[-batch.num_rows :] for w in words["class"].to_numpy()[row]]
        assert cls.tolist() == want and before[first].tolist() == [3] * batch.num_rows
    with pytest.raises(ValueError):
        _number(1 << 17)


def test_word_classes_against_brute_force(spark):
    """Words in rounds: each goes to the class under which what stands before it is likeliest, and the counts follow."""
    rng = np.random.default_rng(21)
    k, of_tail = 4, np.array([0, 2])
    rows, counts = [], rng.integers(20, 60, (2 * k, k)).astype(float)
    for w in range(60):
        found = [(int(c), int(rng.integers(1, 9))) for c in rng.choice(2 * k, rng.integers(1, 6), replace=False)]
        rows.append((w, w % 2, found))
        for c, n in found:
            counts[c, of_tail[w % 2]] += n
    table = spark.createDataFrame(rows, "name long, tail int, found array<struct<code: int, n: long>>")
    got = by_id(word_classes(table, counts, of_tail, rounds=2))

    def choose(now):
        p = [[math.log((now[c][j] + 0.5) / sum(now[x][j] + 0.5 for x in range(2 * k))) for j in range(k)] for c in range(2 * k)]
        return [max(range(k), key=lambda j: (round(sum(n * p[c][j] for c, n in found), 9), -j)) for _, _, found in rows]

    def value(now):
        f = lambda x: x * math.log(x) if x > 0 else 0
        return sum(map(f, now.ravel())) - sum(f(x) for x in now.sum(axis=0))

    used, best = counts, value(counts)
    for _ in range(2):
        now = counts.copy()
        for (_, tail, found), j in zip(rows, choose(used), strict=True):
            for c, n in found:
                now[c, of_tail[tail]] -= n
                now[c, j] += n
        if value(now) <= best + 1e-5 * abs(best):
            break
        used, best = now, value(now)
    assert best > value(counts)
    assert [got[w][0] for w in range(60)] == choose(used)


def test_exchange_never_lowers_the_likelihood():
    rng = np.random.default_rng(5)
    pairs = rng.poisson(1.0, (24, 24)).astype(float) * rng.integers(0, 9, (24, 1))

    def value(cls, k):
        m = np.eye(k)[cls].T @ pairs @ np.eye(k)[cls]
        f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
        return f(m) - f(m.sum(axis=0)) - f(m.sum(axis=1))

    found = [value(exchange_clusters(pairs, 5, s), 5) for s in (0, 1, 2, 6)]
    assert found == sorted(found) and found[-1] > found[0]
    # no single move of the last result would help
    cls = exchange_clusters(pairs, 5, 50)
    top = value(cls, 5)
    for u in range(24):
        for c in range(5):
            other = cls.copy()
            other[u] = c
            assert value(other, 5) <= top + 1e-6


def test_mixture(spark, docs, labels, empty):
    rng = np.random.default_rng(6)
    kinds = [["clean", "fine", "good"], ["low", "junk"], ["bad", "rude"]]
    rows, known = [], []
    for i in range(600):
        k = int(rng.choice(3, p=[0.6, 0.25, 0.15]))
        rows.append((i, " ".join(rng.choice(kinds[k], 30))))
        if i % 2:
            known.append((i, int(k != 1), int(k == 2)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    goal = {"clean": 0.5, "low": 0.2, "toxic": 0.3}
    got = mixture(table, spark.createDataFrame(known, LABELS), goal, tokens=20_000)
    sums = got.agg(*(F.sum(F.col("rate") * F.col("n_tokens") * F.col("p")[d]) for d in range(3)), F.min("rate")).first()
    assert list(sums[:3]) == pytest.approx([10_000, 4_000, 6_000], rel=0.02) and sums[3] >= 0
    assert got.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0] == pytest.approx(20_000, rel=0.1)
    assert {r.doc_id for r in mixture(docs, labels).collect()} == {i for i, _ in DOCS}
    assert mixture(empty, labels).isEmpty() and mixed(docs, labels).columns == docs.columns
    assert mixture(docs, labels.limit(0)).count() == len(DOCS)


def test_rates_against_brute_force(spark):
    """The fitted rates solve the nonnegative least squares problem: totals are met where they can be, and else no step along any document's own gradient helps."""
    rng = np.random.default_rng(9)
    p = rng.dirichlet([0.4, 0.4, 0.4], 150)
    n = rng.integers(1, 400, 150)
    table = spark.createDataFrame([(i, int(t), x.tolist()) for i, (t, x) in enumerate(zip(n, p, strict=True))], "doc_id long, n_tokens long, p array<double>")
    total = float(n.sum())
    for goal in ([0.7, 0.2, 0.1], [0.05, 0.9, 0.05], [1.0, 0.0, 0.0]):
        rate, residual = fitted_rates(table, [total * g for g in goal])
        r = np.array([x.rate for x in table.select("doc_id", rate.alias("rate")).orderBy("doc_id").collect()])
        assert (r >= 0).all()
        off = (r * n) @ p - total * np.array(goal)
        assert np.abs(off).max() / total == pytest.approx(residual, abs=1e-6)
        # plain projected gradients, document by document
        slow, step = np.ones(150), 1 / np.linalg.norm(n[:, None] * p, 2) ** 2
        for _ in range(20_000):
            slow = np.maximum(0, slow - step * n * (p @ ((slow * n) @ p - total * np.array(goal))))
        least = np.abs((slow * n) @ p - total * np.array(goal)).max() / total
        assert residual <= least + 0.02, (goal, residual, least)
    assert fitted_rates(table.limit(0), [0.0, 0.0, 0.0])[1] == 0


def test_clashing_columns_and_repeated_ids(spark, labels):
    """Columns that have the operators' own names stay as they are, and rows repeated under one id have a defined result."""
    long_text = " ".join(f"word{i}" for i in range(70))
    names = "doc_id long, text string, lang string, source string, n_chars long, spans int, copies int, copy string, _copies int, shard int, key1 int, cls int"
    rows = [(i % 7, t, None, "s", len(t or ""), i, i, "c", 2, 3, 4, 5) for i, t in enumerate([long_text, None, "", long_text + " more", "a b c", long_text, "x"] * 2)]
    table = spark.createDataFrame(rows, names)
    first = {i: min((r[1] for r in rows if r[0] == i), key=lambda t: (t is not None, t or "")) for i in range(7)}
    for out in (one_of_each(table), without_repeats(table, 50), mixed(table, labels), good_documents(table, labels)):
        assert out.columns == table.columns and {r.doc_id for r in out.collect()} <= set(range(7))
    assert by_id(repeated_windows(table, 20)) == brute.repeats(sorted(first.items()), 20)
    assert importance(table, labels).count() == 14 and quality_rules(table, labels).count() == 14 and class_scores(table).count() == 14
    assert mixture(table, labels).count() == 14 and packed(table, PATH, 2).select("doc_id").distinct().count() == 7


def test_nearest(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 8))
    v = (centres[rng.integers(12, size=900)] + 0.2 * rng.normal(size=(900, 8))).astype(np.float32)
    v[300:600] = v[300]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] + [1.0] * 7), (2060, [1.0, None] + [1.0] * 6), (2080, []), (20, v[20].tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in nearest(table, leaf=32, chunk=40).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 900, 20))
    w = v.astype(float)
    hit = total = 0
    for q, found in got.items():
        scores = (w * w[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(900), -scores)) if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(s == pytest.approx(scores[i], abs=1e-12) for _, i, s in found)
        assert [(s, -i) for _, i, s in found] == sorted([(s, -i) for _, i, s in found], reverse=True)
        hit, total = hit + len(set(order) & {i for _, i, _ in found}), total + 20
    assert hit >= 0.9 * total
    assert nearest(table.limit(0)).isEmpty()
    few = nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (20, [3.0])], "vec_id long, embedding array<float>")).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in few) == [(0, 1, 20, 3.0), (0, 2, 1, 2.0), (20, 1, 1, 6.0), (20, 2, 0, 3.0)]


def test_nearest_of_a_hot_leaf_and_any_partition_count(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(1500, 6))
    v[500:1100] = v[500]
    table = spark.createDataFrame([(i, x.tolist(), "q", 0.0) for i, x in enumerate(v)], "vec_id long, embedding array<double>, query_id string, floor double")
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("1", "4", "31"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(sorted(tuple(r) for r in nearest(table, leaf=48, chunk=64, recall=1.0).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] == found[2] and len(found[0]) == 75 * 20
    got: dict = {}
    for q, _, i, _ in found[0]:
        got.setdefault(q, set()).add(i)
    order = {q: [i for i in np.lexsort((np.arange(1500), -((v * v[q]).sum(axis=1)))) if i != q][:20] for q in got}
    assert sum(len(got[q] & set(order[q])) for q in got) >= 0.97 * 1500


def test_urls(spark):
    rows = [
        (1, "http://A.Example.NET/en/1?x=1", "net", "example.net/en/"), (2, "https://example.net/fr/", "", "net/"), (3, "http://b.org/fr/x#y", "", "org/fr/"),
        (4, "http://example.com/de/", "", "example.com/de/"), (5, "http://net", "", None), (6, None, "", None), (7, "no scheme", "", None),
        (8, "http://notexample.com/de/", "", None), (9, "x://h?q=://a.net/", "", None), (10, "", "", None), (11, "http://org/fr/", "", "org/fr/"), (12, "a://b.net/\n/é", "", "net/"),
    ]
    many = [(100 + i, f"http://{'spam' if i % 2 else 'fine'}{i}.example.{'net' if i % 2 else 'org'}/{'de' if i % 2 else 'fr'}/{i}", "", None) for i in range(200)]
    table = spark.createDataFrame([(a, b, c) for a, b, c, _ in rows + many], "page_id long, url string, rule string")
    got = {r.page_id: r for r in url_verdicts(table, Q.RULES).collect()}
    assert len(got) == len(rows) + 200
    for i, _, _, rule in rows:
        assert got[i].rule == rule
        assert got[i].verdict in ("allow", "block")
        if rule:
            assert got[i].verdict == ("allow" if rule in ("example.net/en/", "org/fr/") else "block")
    assert (got[1].host, got[1].path) == ("a.example.net", "/en/1") and (got[9].host, got[9].path) == ("h", "")
    assert (got[6].host, got[6].path, got[7].host) == ("", "", "") and got[12].path == "/\n/é"
    assert url_verdicts(table.limit(0), Q.RULES).isEmpty()
    assert {r.verdict for r in url_verdicts(table.where("rule <> '' or page_id = 7"), Q.RULES).collect()} == {"allow"}


def test_url_features_against_brute_force(spark):
    urls = ["http://a.b.com/x/y?q=1&r=2#f", "https://A.org", None, "", "none", "http://b.com/" + "d" * 30_000, "x://é.net/é-1_2"]
    pages = spark.createDataFrame([(i if i else None, u) for i, u in enumerate(urls)] + [(1, urls[1])], "page_id long, url string")
    host, path = host_and_path(F.col("_url"))
    rows = lexical_features(pages.select("page_id", F.col("url").alias("_url")).withColumns({"_host": host, "_path": path})).collect()
    assert len(rows) == 8
    for r in rows:
        u = r._url or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        assert (r._host, r._path) == (host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)), path)
        share = [u.count(c) / len(u) for c in set(u)]
        want = {
            "url_length": len(u), "host_length": len(host), "path_length": len(path), "depth": path.count("/"), "labels": host.count("."), "digit_ratio": sum(c in string.digits for c in u) / max(1, len(u)),
            "dash_ratio": sum(c in "-_" for c in u) / max(1, len(u)), "entropy": -sum(x * math.log2(x) for x in share), "parameters": sum(c in "?&" for c in u), "values": u.count("="), "secure": float(u.lower().startswith("https")),
        }
        for name, x in want.items():
            assert r[name] == pytest.approx(x, abs=1e-9), (name, u[:40])


def test_suffix_statistics_leave_the_own_site_out(spark):
    rows = [("com", "a.com", 1.0), ("com", "a.com", 1.0), ("com", "b.com", 0.0), ("com", "c.com", None), ("net", "d.net", 1.0)]
    got = {(r.site, r.block): r for r in suffix_statistics(spark.createDataFrame(rows, "suffix string, site string, block double"), lean=1.0).collect()}
    mean = 2 / 3  # of the labelled sites a.com, b.com and d.net
    want = {("a.com", 1.0): (0 + mean) / 2, ("b.com", 0.0): (1 + mean) / 2, ("c.com", None): (1 + mean) / 3, ("d.net", 1.0): mean}
    assert {k: pytest.approx(r.suffix_rate) for k, r in got.items()} == want
    assert got["d.net", 1.0].suffix_sites == 0 and got["a.com", 1.0].suffix_sites == pytest.approx(math.log(3))


def test_suffix_statistics_of_a_hot_suffix_and_a_hot_site(spark):
    """A suffix with most sites and a site with a third of all pages are dealt to salts; every page keeps its one row."""
    rows = [("com", f"s{i}.com", float(i % 3 == 0) if i % 2 else None) for i in range(700)] + [("com", "big.com", 1.0)] * 900
    rows += [(f"t{i % 300}", f"x{i}.t{i % 300}", float(i % 2)) for i in range(600)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, suffix string, site string, block double")
    got = sorted(suffix_statistics(table).collect(), key=lambda r: r.page_id)
    own = {site: block for _, site, block in rows}
    under: dict[str, list] = {}
    for suffix, site in {r[:2] for r in rows}:
        under.setdefault(suffix, []).append(own[site])
    known = [b for b in own.values() if b is not None]
    mean = sum(known) / len(known)
    assert [r.page_id for r in got] == list(range(len(rows)))
    for r in got:
        others = [b for b in under[r.suffix] if b is not None]
        rest, n = sum(others) - (r.block or 0.0), len(others) - (r.block is not None)
        assert r.suffix_rate == pytest.approx((rest + 10 * mean) / (n + 10)) and r.suffix_sites == pytest.approx(math.log(len(under[r.suffix])))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_run(spark, name):
    df = Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert df.count() > 0


def test_kept_sha(spark):
    row = Q.op2_substring_dedup(spark, "/root/testdata/sf0.001").where("n_words = 0 or n_removed = 0").first()
    assert len(row.kept_sha256) == 64
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
