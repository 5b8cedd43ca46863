"""Tables that end a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir.  Where a local session has none (tests), an own one is set; on a cluster it must be named, as no local folder is seen by all."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tasks_for(rows: DataFrame, share: int = 250_000) -> int:
    """As many tasks as give each `share` of the rows, which should be a table: what a task sorts or joins does not grow with it."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // share))


def shuffled(rows: DataFrame) -> DataFrame:
    """A side of a join whose sides both grow with the input: joined by a shuffle.

    Spark takes a table to be as large as its compressed files, though its rows may fill fifty times that, and sends one that seems small whole through the driver.
    """
    return rows.hint("merge")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what loops grow is planned once, and a lost executor loses none of it."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
