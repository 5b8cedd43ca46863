"""A training corpus from raw documents, in stages that each read what the one before wrote.

Every stage takes the columns of documents and, but for the last, returns them; other columns are left out by the first.  A row without a doc_id
goes at the first stage that needs it, rows repeated under one doc_id become one at near_dedup, and null and empty texts stay documents
(they are no near copies, hold no repeats, and pack as their end token).  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from matchloom.llm.importance import good_documents
from matchloom.llm.mixing import mixed
from matchloom.llm.neardup import one_of_each
from matchloom.llm.packing import packed
from matchloom.llm.repeats import without_repeats
from matchloom.llm.tables import DOCUMENT_COLUMNS, documents, drop, new_folder, recorded

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_last: list[str] = []


def _stage(f: Stage) -> Stage:
    """Drop the tables that the stage before needed while its result was being written, and note this one's."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _last:
            drop(spark, _last.pop())
        with recorded(_last):
            return f(spark, docs, sf_dir)

    return run_stage


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The k documents with the largest Gumbel keys, k calibrated on the labels so that few clean ones go; a null or empty text has the usual weight of one without words."""
    return good_documents(docs.select(*DOCUMENT_COLUMNS), _labels(spark, sf_dir))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8): the least doc_id.  Null and empty texts stay."""
    return one_of_each(docs, width=5, percent=80)


@_stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay where they first stand; a text of which nothing stays goes, null and empty ones stay as they are."""
    return without_repeats(docs, window=50)


@_stage
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its fitted rate says, so that expected domain totals meet the target weights; copies keep their doc_id."""
    return mixed(docs, _labels(spark, sf_dir))


@_stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in windows of 4096 tokens; rows under one doc_id are packed each."""
    return packed(docs, TOKENIZER, end=2, size=4096)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("packing", packing),
]

#: SQL cannot express the hashed models, the fit of the rates or the packing; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        path = new_folder(spark, f"pipeline-{name}")
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            drop(spark, before)
        before = path
    while _last:
        drop(spark, _last.pop())
    return docs
