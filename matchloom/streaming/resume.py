"""Resumable jobs as streams over a folder that grows: each run takes up what is new and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def materialize_new(spark: SparkSession, source: str, schema: T.StructType, out: str, progress: str, work: Callable[[DataFrame], DataFrame], files_per_batch: int = 1000) -> int:
    """Apply work to the rows of Parquet files that no earlier run has taken, and append the results to out.

    progress is the folder of the stream's checkpoint: a run that is stopped half-way goes on from there, and
    the file sink commits each batch once.  Returns the number of rows read by this run.
    """
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    run = work(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(p["numInputRows"] for p in run.recentProgress)


def content_entries(rows: DataFrame) -> DataFrame:
    """Rows with a content column -> sha, size, status; a null content stays, as excluded."""
    return rows.select(F.sha2("content", 256).alias("sha"), F.length("content").alias("size"), F.when(F.col("content").isNull(), "excluded").otherwise("entry").alias("status"))
