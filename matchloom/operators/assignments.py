"""Feasible assignments of candidates to roles, and their ranking.

An edge asks something of each of its ends alone, so whether a candidate may stand at a role, and what it costs there, is known from the role's own edges,
whatever roles these lead to.  An assignment takes one such candidate for every role.  Requests may have any number of roles and any edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.tables import tasks_for, written


def endpoint_costs(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """query, pos, n_roles, candidate, cost of candidates with a match (counts: query, edge, side, role, candidate, n) at every edge of their role:
    the sum of the logs of the match counts.  A role without edges takes all of its candidates at no cost."""
    tasks, keys = tasks_for(candidates), ["query", "role", "candidate"]
    ends = counts.repartition(tasks, *keys).groupBy(*keys).agg(F.min("n").alias("least"), F.sum(F.log(F.greatest("n", F.lit(1)))).alias("cost"))
    found = candidates.select("query", "role", "pos", "n_roles", "candidate").repartition(tasks, *keys).join(ends, keys, "left")
    return found.where("least is null or least > 0").select("query", "pos", "n_roles", "candidate", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def _most_roles(ready: DataFrame) -> int:
    return ready.agg(F.max("n_roles")).first()[0] or 0


def _by_query(ready: DataFrame) -> DataFrame:
    """The rows as a table, dealt by query to as many tasks as their number asks for: roles meet, and choices are ranked, where they lie."""
    ready = written(ready, "ready")
    return ready.repartition(tasks_for(ready), "query")


def _named(picked: DataFrame) -> DataFrame:
    text = F.concat(F.lit('["'), F.array_join(F.transform("picks", lambda x: x.cast("string")), '","'), F.lit('"]'))
    return picked.select("query", "picks", (-F.col("cost")).alias("score"), F.sha2(text, 256).alias("identity"))


def _grown(picked: DataFrame, ready: DataFrame, pos: int) -> DataFrame:
    """Each choice so far with each candidate of the role at a place; a query with fewer roles stays as it is."""
    more = ready.where(F.col("pos") == pos).select("query", "candidate", F.col("cost").alias("more"))
    return picked.join(more, "query", "left").where((F.col("n_roles") <= pos) | F.col("candidate").isNotNull()).select(
        "query", "n_roles", F.when(F.col("candidate").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array("candidate"))).alias("picks"),
        (F.col("cost") + F.coalesce("more", F.lit(0.0))).alias("cost"),
    )


def feasible_assignments(ready: DataFrame) -> DataFrame:
    """query, picks (candidates in the order of roles), score, identity of all assignments of endpoint_costs' rows.

    score is minus the sum of the costs; identity a hash of the picks.  This is the full product; best_assignments finds the first without it.
    """
    ready = _by_query(ready)
    picked = ready.where("pos = 0").select("query", "n_roles", F.array("candidate").alias("picks"), "cost")
    for pos in range(1, _most_roles(ready)):
        picked = _grown(picked, ready, pos)
    return _named(picked)


def best_assignments(ready: DataFrame, beam: int = 25, tie: float = 1e-8) -> DataFrame:
    """As feasible_assignments, but only those that may be among a query's `beam` of the highest scores, all that tie with the last of them too.

    Costs add up role by role, so a choice of the first roles that `beam` others undercut by more than `tie` cannot lead to one of them.
    """
    ready = _by_query(ready)
    place = F.row_number().over(Window.partitionBy("query").orderBy("cost"))
    picked = ready.where("pos = 0").select("query", "n_roles", F.array("candidate").alias("picks"), "cost")
    for pos in range(1, _most_roles(ready) + 1):
        last = F.max(F.when(F.col("place") <= beam, F.col("cost"))).over(Window.partitionBy("query"))
        picked = picked.withColumn("place", place).withColumn("last", last).where(F.col("cost") <= F.col("last") + tie).drop("place", "last")
        picked = _grown(picked, ready, pos)
    return _named(picked)


def ranked(assignments: DataFrame, policy: str = "minimum_port_ambiguity", beam: int = 25) -> DataFrame:
    """The first `beam` assignments of each query with their rank from 0: by score, or by identity alone."""
    best = [F.desc(F.round("score", 9)), F.col("identity")] if policy == "minimum_port_ambiguity" else [F.col("identity")]
    order = Window.partitionBy("query").orderBy(*best)
    return assignments.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < beam)


def predictions(candidates: DataFrame, ranking: DataFrame) -> DataFrame:
    """query, status, rank, pos, role, candidate, score; a query without an assignment keeps one no_candidate row."""
    roles = candidates.select("query", "pos", "role").distinct()
    picked = ranking.select("query", "rank", "score", F.posexplode("picks").alias("pos", "candidate")).join(roles, ["query", "pos"])
    every = candidates.select("query").distinct()
    return every.join(picked, "query", "left").select(
        "query", F.when(F.col("rank").isNull(), "no_candidate").otherwise("predicted").alias("status"), "rank", "pos", "role", "candidate", F.round("score", 6).alias("score")
    )


def feasible_counts(candidates: DataFrame, ready: DataFrame) -> DataFrame:
    """query, raw, feasible: how many assignments there are without and with the edges' conditions, as products over roles."""
    fit = ready.groupBy("query", "pos").agg(F.count("*").alias("fit"))
    each = candidates.groupBy("query", "pos").agg(F.count("*").alias("n")).join(fit, ["query", "pos"], "left")
    return each.groupBy("query").agg(F.product("n").alias("raw"), F.product(F.coalesce("fit", F.lit(0))).alias("feasible"))


def ambiguity_audit(candidates: DataFrame, ready: DataFrame) -> DataFrame:
    """One row: how many queries have no, one, several assignments, and the spread of raw and feasible counts."""
    each = feasible_counts(candidates, ready)
    out = [F.count("*").alias("queries")]
    out += [F.count_if(c).alias(n) for n, c in (("zero", F.col("feasible") == 0), ("unique", F.col("feasible") == 1), ("ambiguous", F.col("feasible") > 1))]
    for c in ("raw", "feasible"):
        value = F.col(c).cast("double")
        out += [F.round(F.avg(value), 6).alias(f"{c}_mean"), F.median(value).alias(f"{c}_median"), F.expr(f"percentile_disc(0.9) within group (order by cast({c} as double))").alias(f"{c}_p90"), F.max(value).alias(f"{c}_max")]
    return each.agg(*out)
