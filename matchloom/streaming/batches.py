"""Batched runs that go on where they stopped, are bound to their input, and keep what fails apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.ordering import positions
from matchloom.operators.records import item_binding
from matchloom.sources.tables import written

Work = Callable[[DataFrame], DataFrame]
_ERRORS = "batch bigint, item bigint, error string, message string"
_STATE = "items bigint, input_sha256 string, size bigint"


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def isolated(batch: DataFrame, work: Work, write: Callable[[DataFrame], None], low: int, high: int) -> list[tuple[int, str, str]]:
    """Apply work to the items of a batch (item from low to high - 1) and write what it gives; items that make it fail stand alone in the list (item, error, message).

    A part that fails is halved until its bad item is alone, so b bad items of n cost about b log2 n tries, and no good one is lost.  Work that cannot be
    planned at all is a fault of the program, not of an item, and is raised.
    """
    part = batch.where(F.col("item").between(low, high - 1))
    try:
        write(work(part))
        return []
    except AnalysisException:
        raise
    except PySparkException as error:
        if high - low <= 1:
            return [(low, type(error).__name__, str(error).split("\n")[0][:500])]
    middle = (low + high) // 2
    return isolated(batch, work, write, low, middle) + isolated(batch, work, write, middle, high)


def run_batches(items: DataFrame, order: list[str], work: Work, folder: str, size: int, resume: bool = False) -> DataFrame:
    """Work off the items (order columns, text and others) in batches of `size`, and give the progress: batch, items, done, failed.

    Items are numbered in their order and lie in folder/queue, one file group for each batch, which a stream takes one after the other; its checkpoint says how far a run came.  Results are in
    folder/results/batch=..., items that made the work fail in folder/errors with the error, and folder/state says what the run is bound to: the items' hash and number, and the size.
    A folder with a state goes on only with resume, and only for the same items and size; anything else is refused.  A batch that was cut off is written anew as a whole.
    """
    spark = items.sparkSession
    bound = item_binding(items, order).select("items", "input_sha256", F.lit(size).cast("long").alias("size")).first()
    state = f"{folder}/state"
    if _exists(spark, f"{state}/_SUCCESS"):
        if not resume:
            raise ValueError("this folder holds a run; resume it")
        if tuple(spark.read.schema(_STATE).json(state).first()) != tuple(bound):
            raise ValueError("the run in this folder is bound to other items or another batch size")
    else:
        placed = positions(items, [], order, "item").withColumn("batch", F.floor(F.col("item") / size))
        placed.repartition("batch").write.mode("overwrite").partitionBy("batch").parquet(f"{folder}/queue")
        spark.createDataFrame([tuple(bound)], _STATE).coalesce(1).write.mode("overwrite").json(state)
    kind = spark.read.parquet(f"{folder}/queue").schema
    rows = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{folder}/queue")

    def step(found: DataFrame, _: int) -> None:
        # a file holds the rows of one batch
        for (batch,) in found.select("batch").distinct().collect():
            own = written(found.where(F.col("batch") == batch).drop("batch"), "batch")
            first = True

            def write(out: DataFrame, batch: int = batch) -> None:
                nonlocal first
                out.write.mode("overwrite" if first else "append").parquet(f"{folder}/results/batch={batch}")
                first = False

            bad = isolated(own, work, write, batch * size, (batch + 1) * size)
            errors = spark.createDataFrame([(batch, *x) for x in bad], _ERRORS)
            errors.drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{folder}/errors/batch={batch}")

    run = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start()
    run.awaitTermination()
    return progress(spark, folder)


def progress(spark: SparkSession, folder: str) -> DataFrame:
    """batch, items, failed, complete of a run's folder; a batch that was not reached has no failed and is not complete."""
    items = spark.read.parquet(f"{folder}/queue").groupBy("batch").agg(F.count("*").alias("items"))
    errors = spark.read.schema(_ERRORS).parquet(f"{folder}/errors").groupBy("batch").agg(F.count("*").alias("failed"))
    reached = spark.read.schema("item bigint, batch bigint").parquet(f"{folder}/results").select("batch").distinct().withColumn("reached", F.lit(True))
    rows = items.join(errors, "batch", "left").join(reached, "batch", "left")
    there = F.col("reached").isNotNull() | F.col("failed").isNotNull()
    return rows.select("batch", "items", F.when(there, F.coalesce("failed", F.lit(0))).alias("failed"), (there & F.col("failed").isNull()).alias("complete"))
