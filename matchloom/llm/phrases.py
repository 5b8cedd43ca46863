"""Phrase mining by Toivonen's sampling.

A share of the documents, by a hash of their ids, proposes phrases: those that stand there `sample_least` times or more, a lower bound than the
share of `least` asks for.  Their negative border are the phrases that are not proposed though both their parts of one word less are (of single words: all
others).  One pass over all texts counts proposed phrases and border alike, exactly.  A border phrase that turns out frequent is a failure: longer phrases over it
were not counted.  So failures join the proposed ones, and a further pass counts what newly comes into reach, until no pass finds failures that could grow.

What is proposed, and each pass's failures, are known to the tasks by a Bloom filter each.  It may take a phrase for proposed that is not; then what grows from it is
counted too, and as every pass asks the same filters, no phrase is missed and none is counted twice.  Only phrases found frequent are
spelled out, from the sample, and those that it lacks from the other texts.  Phrases are keyed by 62 bits of hash and two of length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spans import Spans, byte_set, runs_outside
from .tables import schema, written
from .text import grams, mix, slices

LONGEST, HELD, SALTS = 4, 3_000_000, 64
#: bits of the filter: so many for each phrase, within these bounds
BITS_EACH, LEAST_BITS, MOST_BITS = 16, 20, 30
_PIECE = byte_set(b".,;:!?\x0a\x0b\x0c\x0d")
_WORDS = runs_outside(_PIECE | byte_set(b"\x20\x09"))


class Phrases:
    """The words of a slice, A-Z lowered, and the keys of its runs of 1 to LONGEST words within a piece."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = words = Spans(batch.column("text"), _WORDS, lower=True)
        self.names, self.doc = words.names(), words.doc_of()
        # words of one piece have as many piece ends, and texts, before them
        piece = np.cumsum(_PIECE[words.data])[words.starts] + self.doc if len(words.starts) else self.doc
        lang = batch.column("lang").dictionary_encode()
        each = Spans(lang.dictionary, lambda data, offsets: (offsets[:-1], offsets[1:])).names() if len(lang.dictionary) else np.zeros(0, np.uint64)
        self.lang = each[lang.indices.to_numpy()][self.doc] if len(each) else np.zeros(0, np.uint64)
        self.keys, self.whole = [], []
        for k in range(1, LONGEST + 1):
            m = max(0, len(self.names) - k + 1)
            key = mix(grams(self.names, k) ^ self.lang[:m])
            self.keys.append(key & ~np.uint64(3) | np.uint64(k - 1))
            self.whole.append(piece[:m] == piece[k - 1 : k - 1 + m])

    def reached(self, filters: list[np.ndarray] | None) -> list[np.ndarray]:
        """For each length the places of the runs in reach: single words, and runs whose both parts of one word less are in one of the filters.

        Of several filters the last is new, and only runs that are in reach by it are given.  Without filters, all runs.
        """
        if filters is None:
            return [np.flatnonzero(w) for w in self.whole]
        *old, new = filters
        out = [np.flatnonzero(self.whole[0][: 0 if old else None])]
        for keys, whole in zip(self.keys, self.whole[1:], strict=False):
            fresh = passes(keys, new)
            if not old:
                out.append(np.flatnonzero(whole & fresh[:-1] & fresh[1:]) if len(whole) else np.zeros(0, np.int64))
                continue
            at = np.flatnonzero(whole & (fresh[:-1] | fresh[1:])) if len(whole) else np.zeros(0, np.int64)
            a, b = accepted(keys[at], old), accepted(keys[at + 1], old)
            out.append(at[(a | fresh[at]) & (b | fresh[at + 1]) & ~(a & b)])
        return out


def passes(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), bool)
    mask = np.uint64(64 * len(bits) - 1)
    for place in (keys & mask, (mix(keys) >> np.uint64(20)) & mask):
        out &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
    return out


def accepted(keys: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    for bits in filters:
        out |= passes(keys, bits)
    return out


def _bits(batches: Iterator[pa.RecordBatch], size: int, block: int) -> Iterator[pa.RecordBatch]:
    """The filter's words of 64 bits that a task's keys touch, a block of keys at a time."""
    mask = np.uint64((1 << size) - 1)
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            keys = batch.column("key")[at : at + block].to_numpy().view(np.uint64)
            place = np.unique(np.concatenate([keys & mask, (mix(keys) >> np.uint64(20)) & mask]))
            cell, first = np.unique(place >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first)
            yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(value.view(np.int64))], names=["cell", "bits"])


def key_filter(keys: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """A Bloom filter over the keys, of 2^LEAST_BITS to 2^most bits, whatever the input."""
    size = min(most, max(LEAST_BITS, (BITS_EACH * keys.count()).bit_length()))
    cells = keys.select("key").mapInArrow(partial(_bits, size=size, block=1 << 16), schema("cell long, bits long")).groupBy("cell").agg(F.bit_or("bits").alias("bits"))
    got = cells.toArrow()
    bits = np.zeros((1 << size) // 64, np.uint64)
    bits[got.column("cell").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bits


def _counted(batches: Iterator[pa.RecordBatch], filters) -> Iterator[pa.RecordBatch]:
    """key, n of the runs in reach of the filters; without any, of all runs."""
    filters = filters and [f.value for f in filters]
    held, size = [], 0

    def rows() -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n, pa.int64())], names=["key", "n"])

    for batch in slices(batches, "text"):
        found = Phrases(batch)
        for key, at in zip(found.keys, found.reached(filters), strict=True):
            held.append(key[at])
            size += len(held[-1])
        if size > HELD:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def _new(batches: Iterator[pa.RecordBatch], filters) -> Iterator[pa.RecordBatch]:
    filters = [f.value for f in filters]
    for batch in batches:
        yield batch.filter(pa.array(~accepted(batch.column("key").to_numpy().view(np.uint64), filters)))


def _spelled(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """key, lang, phrase where a key of the filter is met first in this task, and for each language its number of words, without a key."""
    bits, met = shared.value, np.zeros(0, np.uint64)
    kinds = pa.schema([("key", pa.int64()), ("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])
    totals: dict[str, int] = {}
    for batch in slices(batches, "text"):
        found = Phrases(batch)
        words, langs = found.words, batch.column("lang")
        for lang, n in zip(langs.to_pylist(), words.counts().tolist(), strict=True):
            totals[lang] = totals.get(lang, 0) + n
        data = words.data.tobytes()
        if len(met) > HELD:
            met = np.zeros(0, np.uint64)
        for k, (key, whole) in enumerate(zip(found.keys, found.whole, strict=True)):
            key, first = np.unique(np.where(whole, key, np.uint64(0)), return_index=True)
            good = whole[first]
            key, first = key[good], first[good]
            good = passes(key, bits)
            key, first = key[good], first[good]
            at = np.searchsorted(met, key)
            old = at < len(met)
            old[old] = met[at[old]] == key[old]
            key, first = key[~old], first[~old]
            met = np.insert(met, at[~old], key)
            if not len(key):
                continue
            text = [b" ".join(data[int(words.starts[i + j]) : int(words.ends[i + j])] for j in range(k + 1)) for i in first.tolist()]
            lang = langs.take(pa.array(found.doc[first]))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), lang, pa.array(text, pa.binary()).cast(pa.string()), pa.nulls(len(key), pa.int64())], schema=kinds)
    yield pa.RecordBatch.from_arrays([pa.nulls(len(totals), pa.int64()), pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], schema=kinds)


def frequent_phrases(docs: DataFrame, least: int, sample_least: int, most_bits: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """lang, text, part (0: sampled) -> (lang, phrase, k, f: all phrases of 1 to LONGEST words that stand `least` times or more; lang, n: all words)."""
    spark, kind = docs.sparkSession, schema("key long, n long")
    count = lambda rows, filters: rows.mapInArrow(partial(_counted, filters=filters), kind).groupBy("key").agg(F.sum("n").alias("n"))
    grows = F.col("key").bitwiseAND(3) < LONGEST - 1
    sample = docs.where("part = 0")
    proposed = written(count(sample, None).where((F.col("n") >= sample_least) & grows).select("key"), "proposed-phrases")
    filters, found = [spark.sparkContext.broadcast(key_filter(proposed, most_bits))], []
    while True:
        found.append(written(count(docs, list(filters)).where(F.col("n") >= least), "phrase-counts"))
        failures = written(found[-1].where(grows).mapInArrow(partial(_new, filters=list(filters)), kind), "border-failures")
        if failures.isEmpty():
            break
        filters.append(spark.sparkContext.broadcast(key_filter(failures, most_bits)))
    frequent = found[0]
    for x in found[1:]:
        frequent = frequent.unionByName(x)

    def spelled(rows: DataFrame, keys: DataFrame) -> DataFrame:
        shared = spark.sparkContext.broadcast(key_filter(keys, most_bits))
        return written(rows.mapInArrow(partial(_spelled, shared=shared), schema("key long, lang string, phrase string, n long")), "spelled-phrases")

    # most phrases stand in the sample; only what it lacks is looked for in the other texts
    first = spelled(sample, frequent)
    rest = spelled(docs.where("part <> 0"), written(frequent.join(first.select("key").distinct(), "key", "left_anti"), "unspelled-phrases"))
    both = first.unionByName(rest)
    one = both.where("key is not null").groupBy("key").agg(F.min(F.struct("lang", "phrase")).alias("s"))
    phrases = frequent.join(one, "key").select("s.lang", "s.phrase", (F.col("key").bitwiseAND(3) + 1).cast("int").alias("k"), F.col("n").alias("f"))
    return written(phrases, "frequent-phrases"), both.where("key is null").groupBy("lang").agg(F.sum("n").alias("n"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 8, sample_least: int | None = None, most_bits: int = MOST_BITS) -> DataFrame:
    """Documents -> lang, rank, phrase, a, l, r, n, score: each language's `top` phrases of 2 to 4 words.

    Texts are lowered (A-Z), cut at [.,;:!?] and the line ends 0x0A-0x0D into pieces, and these into words at space and tab.  A phrase counts wherever
    it stands within a piece: a = f(phrase) >= least.  Cut after k words into parts of l and r occurrences it scores floor(2000000 a / (l + r)); its lowest-scoring
    cut counts, ties to the smallest k.  Phrases inside a longer one of at least 80 % of their own count are dropped.  Order: score, a, both falling, then
    phrase by its bytes.

    share: one document in so many is sampled; sample_least: how often a phrase must stand there to be proposed (by itself: 0.4 of what `least` leaves to expect, at
    least 2).  They move work between the passes; the result does not depend on them.

    A null language counts as `und`; null and empty texts have no words; texts are taken whole, a long one in a slice of its own; every row counts, those with
    a repeated or null doc_id too; other columns are not read; an empty table gives no rows.
    """
    part = F.pmod(F.xxhash64("doc_id"), F.lit(share)).alias("part")
    source = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), part)
    phrases, words = frequent_phrases(source, least, sample_least or max(2, int(0.4 * least / share)), most_bits)
    several = phrases.where("k > 1")
    cut = several.select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"), "k").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.withColumn("left", F.array_join(F.expr("slice(w, 1, j)"), " ")).withColumn("right", F.array_join(F.expr("slice(w, j + 1, k - j)"), " "))
    for side, name in (("left", "l"), ("right", "r")):
        cut = cut.join(phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    # a product may pass 64 bits
    scored = cut.withColumn("score", F.expr("cast(cast(2000000 as decimal(7)) * cast(a as decimal(20)) div cast(l + r as decimal(20)) as bigint)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "j", "l", "r")).alias("c"))
    longer = phrases.where("k > 2").select("lang", "f", "k", F.split("phrase", " ").alias("w"))
    longer = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inner = longer.select("lang", F.array_join(F.expr("slice(w, at, size)"), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").where("most is null or 100 * most < 80 * a")
    order = [F.desc("c.score"), F.desc("a"), F.asc("phrase")]
    # each salt's first rows, then the first of these
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "c.l", "c.r", "n", "c.score")
