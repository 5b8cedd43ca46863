"""Rankings, padding and checks of candidate lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zscores(candidates: DataFrame, value: str) -> DataFrame:
    """log1p of a measure, standardised in its query and role; the deviation is 1e-6 at least."""
    of_set = Window.partitionBy("query", "role")
    x = F.log1p(value)
    return candidates.withColumn("z", (x - F.avg(x).over(of_set)) / F.greatest(F.stddev_pop(x).over(of_set), F.lit(1e-6)))


def padded(candidates: DataFrame) -> DataFrame:
    """query, role, slot, candidate, mask: every role of a query filled up to the query's longest list."""
    placed = candidates.select("query", "role", "candidate").withColumn("slot", F.row_number().over(Window.partitionBy("query", "role").orderBy("candidate")) - 1)
    longest = placed.groupBy("query").agg(F.max("slot").alias("last"))
    slots = placed.select("query", "role").distinct().join(longest, "query").select("query", "role", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("slot"))
    return slots.join(placed, ["query", "role", "slot"], "left").withColumn("mask", F.col("candidate").isNotNull())


def role_rankings(candidates: DataFrame, ranking: DataFrame) -> DataFrame:
    """query, role, candidate, place: candidates in the order in which a beam first picks them, then the others by id."""
    picked = ranking.select("query", "rank", F.posexplode("picks").alias("pos", "candidate")).groupBy("query", "pos", "candidate").agg(F.min("rank").alias("seen"))
    every = candidates.join(picked, ["query", "pos", "candidate"], "left")
    order = Window.partitionBy("query", "role").orderBy(F.col("seen").isNull(), "seen", "candidate")
    return every.select("query", "pos", "role", "candidate", (F.row_number().over(order) - 1).alias("place"))


def permutation_status(candidates: DataFrame, rankings: DataFrame) -> DataFrame:
    """query, missing, extra, repeated, valid: whether a ranking names each candidate of each role exactly once."""
    keys = ["query", "role", "candidate"]
    named = rankings.groupBy(*keys).agg(F.count("*").alias("n"))
    both = candidates.select(*keys, F.lit(1).alias("known")).join(named, keys, "full_outer")
    out = both.groupBy("query").agg(
        F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("known").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("repeated")
    )
    return out.withColumn("valid", (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("repeated") == 0))


def place_costs(ready: DataFrame, rankings: DataFrame) -> DataFrame:
    """Candidates that may stand at their role (query, pos, n_roles, candidate), with their place in a ranking as the cost."""
    return ready.drop("cost").join(rankings.select("query", "pos", "candidate", F.col("place").cast("double").alias("cost")), ["query", "pos", "candidate"])


def first_queries(candidates: DataFrame, n: int) -> DataFrame:
    """The candidates of the first n queries by id; n is a stated limit of the caller."""
    chosen = candidates.select("query").distinct().orderBy("query").limit(n)
    return candidates.join(F.broadcast(chosen), "query", "left_semi")
