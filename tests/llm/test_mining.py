"""Token counts, phrase mining and importance resampling against brute force, with every awkward case."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchloom.llm import queries as Q
from matchloom.llm.counting import chunk_counts, counter, token_counts
from matchloom.llm.phrases import collocations
from matchloom.llm.resampling import bit_sliced_weights, bucket_gains, features, planes, resampled

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = [" ", "  ", "\n", "\t", " ", "　", "a", "B", "'s", "'re", "'", "é", "€", "1", "<|endoftext|>", "<|endof", ".", ",", "\x1c", "\x85", "👍", "한", "  x", "\r\n"]
DOCS = list(enumerate(brute.texts()))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 else "en", None, "x", 1) for i, t in reversed(DOCS)]
    rows.append((None, "no id", None, None, None, None))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long, key string, part int").repartition(3)


@pytest.fixture(scope="module")
def long_texts():
    rng = random.Random(5)
    found = ["".join(rng.choice(PIECES) for _ in range(rng.randint(30, 300))) for _ in range(60)]
    return found + ["a" * 700, "a b" * 50 + "x" * 333 + " y z" * 60, " " * 400, "<|endoftext|>" * 40, "é" * 200 + " 1" * 90, None, "", "x"]


def test_token_counts(spark, long_texts):
    """Chunks of 40 characters: some boundaries do not align and the overlap is widened, over long runs of letters again and again."""
    whole = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(long_texts)] + [(0, long_texts[0]), (None, "left out")]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("key", F.lit("k")).withColumn("n_tokens", F.lit("n"))
    got = sorted(tuple(r) for r in token_counts(table, PATH, limit=100, chunk=40, overlap=20).collect())
    want = []
    for i, t in rows[:-1]:
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 100))
    assert got == sorted(want)
    assert token_counts(table.limit(0), PATH).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(PIECES), max_size=40).map("".join), st.text(max_size=30)), max_size=5))
def test_counts_by_units_equal_whole_texts(texts):
    whole = Tokenizer.from_file(PATH)
    assert counter(PATH)(pa.array(texts, pa.string())).tolist() == [len(whole.encode(t or "", add_special_tokens=False).ids) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=30, max_size=90).map("".join), st.integers(5, 40))
def test_common_boundaries_are_stable(text, cut):
    """Wherever two chunks begin a pre-token at one place of their overlap, the whole text's tokens go on from there."""
    count = counter(PATH)
    whole = count.tokenizer.encode(text, add_special_tokens=False)
    _, _, tail = chunk_counts(count, text[: cut + 30], 0, cut, 30, False)
    n, head, _ = chunk_counts(count, text[cut:], cut, len(text) - cut, 30, True)
    before = {x["at"]: x["before"] for x in head}
    for x in tail:
        if x["at"] in before:
            assert x["before"] + n - before[x["at"]] == len(whole.ids)


def phrases(docs, least, top):
    counts, total, out = defaultdict(Counter), Counter(), []
    for lang, text in docs:
        lang = "und" if lang is None else lang
        total[lang] += 0
        for piece in re.split("[.,;:!?\x0a-\x0d]", brute.lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                counts[lang].update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        rows = []
        for phrase, a in f.items():
            w = phrase.split(" ")
            if a < least or len(w) < 2:
                continue
            cuts = [(2_000_000 * a // (f[" ".join(w[:k])] + f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            rows.append((phrase, a, f[" ".join(w[:k])], f[" ".join(w[k:])], total[lang], score))
        inner = Counter()
        for phrase, a, *_ in rows:
            w = phrase.split(" ")
            for size in range(2, len(w)):
                for i in range(len(w) - size + 1):
                    inner[" ".join(w[i : i + size])] = max(inner[" ".join(w[i : i + size])], a)
        kept = sorted((r for r in rows if not (inner[r[0]] and 100 * inner[r[0]] >= 80 * r[1])), key=lambda r: (-r[5], -r[1], r[0].encode()))
        out += [(lang, n + 1, *r) for n, r in enumerate(kept[:top])]
    return sorted(out)


@pytest.mark.parametrize("sample_least,share", [(None, 4), (1, 2), (10_000, 2), (3, 1)])
def test_collocations(spark, docs, sample_least, share):
    """Whatever the sample proposes, up to nothing at all, the counts and phrases are the same."""
    rows = [(None if i is None else i, t, lang) for i, t, lang in ((r.doc_id, r.text, r.lang) for r in docs.collect())]
    rows += [(7, "A, b c; a b\u000bc d! a b c d. é É a b", "fr"), (8, "a b c d " * 40, "fr"), (9, "x\ty  z. " * 30, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("part", F.lit("p")).withColumn("key", F.lit(None).cast("int")).repartition(5)
    got = sorted(tuple(r) for r in collocations(table, least=3, top=40, share=share, sample_least=sample_least).collect())
    want = phrases([(lang, t) for _, t, lang in rows], 3, 40)
    assert got == want and len(want) > 50


def test_collocations_of_nothing(docs):
    assert collocations(docs.limit(0)).collect() == []
    assert collocations(docs, least=10**6).collect() == []


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def resample(docs, target, percent, least):
    def buckets(text):
        w = WORD.findall(brute.lower(text or ""))
        return w, [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(buckets(text)[1])
    for text in target:
        t.update(buckets(text)[1])
    ns, nt = sum(s.values()), sum(t.values())
    out, able = {}, []
    for i, text in docs:
        w, found = buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (ns + 10_000) / ((s[b] + 1) * (nt + 10_000)))) for b in found)
        h = int(hashlib.sha256(f"42:{i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[i] = [len(found), weight, score, None]
        if len(w) >= least:
            able.append((-score, i))
    for n, (_, i) in enumerate(sorted(able)[: percent * len(able) // 100]):
        out[i][3] = n + 1
    return {i: tuple(x) for i, x in out.items()}


@pytest.mark.parametrize("percent", [5, 40, 100, 0])
def test_resampled(spark, docs, percent):
    target = [t for _, t in DOCS[3:9]] + [None, "abc É 12 x_y"]
    table = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampled(docs.withColumn("rank", F.lit("r")), table, percent=percent, least_words=20).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == resample(DOCS, target, percent, 20) and len(got) == len(DOCS)


def test_resampled_ties_repeats_and_nothing(spark, docs):
    rows = [(i, " ".join(f"w{j}" for j in range(30))) for i in (5, 5, 6, 7)] + [(8, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    got = resampled(table, target, percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and len(got) == 5
    assert resampled(docs.limit(0), target).collect() == []


def test_bit_slices_are_exact():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, (40, 10_000))
    counts[3] = 70_000
    gains = rng.integers(-9000, 9000, 10_000)
    up, down = planes(np.maximum(gains, 0)[None])[:, 0], planes(np.maximum(-gains, 0)[None])[:, 0]
    assert (bit_sliced_weights(counts, up, down) == counts @ gains).all()
    assert bucket_gains(np.zeros(10_000, int), np.zeros(10_000, int)).tolist() == [0] * 10_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("aZ9é.", max_size=200)), max_size=5))
def test_features(texts):
    words, bucket, doc = features(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        w = WORD.findall(brute.lower(t or ""))
        want = [zlib.crc32(" ".join(w[j : j + k]).encode()) % 10_000 for k in (1, 2, 3) for j in range(len(w) - k + 1)]
        assert sorted(bucket[doc == i].tolist()) == sorted(want) and words.counts()[i] == len(w)


def test_token_count_query(spark):
    got = Q.op11_token_counts(spark, "/root/testdata/sf0.001").toPandas()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    whole = Tokenizer.from_file(PATH)
    assert dict(zip(got.doc_id, got.n_tokens, strict=True)) == {i: len(whole.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_resampling_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    got = Q.op13_importance_resampling(spark, "/root/testdata/sf0.001").collect()
    assert {r[0]: tuple(r)[1:] for r in got} == resample(docs, target, 5, 20)
