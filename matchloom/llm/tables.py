"""Shared folders, written tables and driver-side helpers of bounded size."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where a session has none (tests), an own one is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_record: list[str] | None = None


@contextmanager
def recorded(paths: list[str]) -> Iterator[None]:
    """Within this, the paths of written tables are added to the list, for its owner to drop."""
    global _record
    before, _record = _record, paths
    try:
        yield
    finally:
        _record = before


def drop(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here, and a lost executor loses none of it.

    by: columns with few values, each of which gets a folder that a filter on it reads alone.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.partitionBy(*(by or [])).parquet(path)
    if _record is not None:
        _record.append(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever else the table holds; rows without an id are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def one_row_per_id(docs: DataFrame) -> DataFrame:
    """Of rows repeated under one doc_id the one with the least text, then the least other columns; a null doc_id goes.

    A table without such rows is not moved.
    """
    docs = docs.where("doc_id is not null")
    if docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        return docs
    order = ["text", *(c for c in docs.columns if c not in ("text", "doc_id"))]
    least = docs.groupBy("doc_id").agg(F.min(F.struct(*order)).alias("_row")).select("doc_id", *(F.col("_row")[c].alias(c) for c in order))
    return least.select(*docs.columns)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column of the table is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def literal_array(values, kind: str) -> Column:
    return F.lit(list(values)).cast(f"array<{kind}>")
