"""Connected components by alternating large-star and small-star joins.

Every step takes minima by groupBy (combined before the shuffle) and joins them
back, so that no vertex's neighbours are ever gathered in one row or task: the minima are copied to SALTS
blocks of each vertex, and its neighbours dealt over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

SALTS = 16


def _joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with the minimum of their u."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "salt"]).drop("salt")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _joined(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = _joined(edges, least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(moved)


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of long ids -> (id, component): the least id reachable, for every id that has a link.

    Self links and nulls are ignored; no links give no rows.
    """
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        edges = written(_small_star(_large_star(edges)).distinct(), "star")
    ids = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return ids.unionByName(roots)
