"""Decoding score tables into assignments.  Scores are whole micro units, so sums are exact and ties are ties."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.tables import written


def beam_decode(unary: DataFrame, pairs: DataFrame, beam: int = 25) -> DataFrame:
    """query, n_roles, picks, score: role by role, keeping the best `beam` partial picks of each query.

    unary (query, pos, n_roles, candidate, score) and pairs (query, edge, pos_a, pos_b, a, b, score): any roles may be joined, and an edge counts
    when the later of its roles is picked; a pair that is missing cannot be taken.  Ties go to the lesser picks.
    """
    late = F.col("pos_a") > F.col("pos_b")
    closed = pairs.select(
        "query", "edge", F.least("pos_a", "pos_b").alias("early"), F.greatest("pos_a", "pos_b").alias("pos"),
        F.when(late, F.col("b")).otherwise(F.col("a")).alias("first"), F.when(late, F.col("a")).otherwise(F.col("b")).alias("next"), F.col("score").alias("p"),
    )
    # each role reads them again
    unary, closed = written(unary, "unary"), written(closed, "pairs")
    edges = closed.groupBy("query", "pos").agg(F.count_distinct("edge").alias("edges"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "picks")
    keep = lambda df: df.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= beam).drop("turn")
    state = keep(unary.where("pos = 0").select("query", "n_roles", F.array("candidate").alias("picks"), "score"))
    for pos in range(1, unary.agg(F.max("n_roles")).first()[0] or 0):
        at = F.col("pos") == pos
        grown = state.join(unary.where(at).select("query", F.col("candidate").alias("next"), F.col("score").alias("u")), "query", "left")
        grown = grown.where((F.col("n_roles") <= pos) | F.col("next").isNotNull()).join(edges.where(at).drop("pos"), "query", "left")
        joined = grown.join(closed.where(at).drop("pos"), ["query", "next"], "left")
        taken = F.col("first") == F.get("picks", F.col("early").cast("int"))
        summed = joined.groupBy("query", "n_roles", "picks", "score", "next", "u", "edges").agg(F.sum(F.when(taken, F.col("p"))).alias("p"), F.count(F.when(taken, F.lit(1))).alias("met"))
        summed = summed.where(F.col("next").isNull() | (F.col("met") == F.coalesce("edges", F.lit(0))))
        state = keep(summed.select(
            "query", "n_roles", F.when(F.col("next").isNull(), F.col("picks")).otherwise(F.concat("picks", F.array("next"))).alias("picks"),
            (F.col("score") + F.coalesce("u", F.lit(0)) + F.coalesce("p", F.lit(0))).alias("score"),
        ))
    return state


def best_pairs(pairs: DataFrame) -> DataFrame:
    """query, pos, a, b, score of the best pair of each edge, ties to the lesser ids."""
    order = Window.partitionBy("query", "pos").orderBy(F.desc("score"), "a", "b")
    return pairs.withColumn("turn", F.row_number().over(order)).where("turn = 1").drop("turn")


def edge_choice(pairs: DataFrame) -> DataFrame:
    """query, edges, consistent: whether the best pairs of all edges give each role one candidate."""
    best = best_pairs(pairs)
    roles = best.select("query", (F.col("pos") - 1).alias("role"), F.col("a").alias("candidate")).unionByName(best.select("query", F.col("pos").alias("role"), F.col("b").alias("candidate")))
    each = roles.groupBy("query", "role").agg(F.count_distinct("candidate").alias("n"))
    return best.groupBy("query").agg(F.count("*").alias("edges")).join(each.groupBy("query").agg((F.max("n") == 1).alias("consistent")), "query")


def top_alternatives(pairs: DataFrame, n: int) -> DataFrame:
    """The n best finite pairs of each edge with their rank from 0; an edge without one keeps (-1, -1)."""
    sound = pairs.where(~F.isnan("value") & (F.abs("value") < float("inf")))
    order = Window.partitionBy("query", "pos").orderBy(F.desc("value"), "a", "b")
    ranked = sound.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < n).select("query", "pos", "a", "b", "rank")
    edges = pairs.select("query", "pos").distinct()
    none = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    return edges.join(ranked, ["query", "pos"], "left").select("query", "pos", none("a", -1), none("b", -1), none("rank", 0))


def target_ranks(unary: DataFrame, targets: DataFrame) -> DataFrame:
    """query, pos, rank (from 1) of the target among its role's candidates; null where the target is no candidate."""
    order = Window.partitionBy("query", "pos").orderBy(F.desc("score"), "candidate")
    ranked = unary.withColumn("rank", F.row_number().over(order)).select("query", "pos", "candidate", "rank")
    return targets.join(ranked, ["query", "pos", "candidate"], "left").select("query", "pos", "rank")


def hard_negatives(unary: DataFrame, targets: DataFrame) -> DataFrame:
    """query, pos, candidate, gap: the best candidate that is not the target, and its score less the target's."""
    wanted = targets.select("query", "pos", F.col("candidate").alias("target"))
    scored = unary.join(wanted, ["query", "pos"])
    goal = scored.where("candidate = target").select("query", "pos", F.col("score").alias("goal"))
    order = Window.partitionBy("query", "pos").orderBy(F.desc("score"), "candidate")
    other = scored.where("candidate <> target").withColumn("turn", F.row_number().over(order)).where("turn = 1")
    return other.join(goal, ["query", "pos"]).select("query", "pos", "candidate", (F.col("score") - F.col("goal")).alias("gap"))


def linker_metrics(beams: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    """One row over all queries with targets: role_accuracy, edge_accuracy, program_accuracy, recall.

    beams (query, rank, picks), targets (query, pos, candidate), edges (query, edge, pos_a, pos_b).  The first beam is judged: the mean over queries of the share of right roles, the share of
    edges with both ends right, the share of queries with every role right; recall: that any beam has every role right.  A query without a beam is wrong in all.
    """
    want = targets.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("pos", "candidate"))).alias("w")).select("query", F.transform("w", lambda x: x["candidate"]).alias("goal"))
    first = beams.where("rank = 0").select("query", "picks")
    hit = beams.join(want, "query").where(F.col("picks") == F.col("goal")).select("query").distinct().withColumn("hit", F.lit(1.0))
    right = F.size(F.filter(F.zip_with("picks", "goal", lambda x, y: x == y), lambda x: x)) / F.size("goal")
    rows = want.join(first, "query", "left").join(hit, "query", "left")
    each = rows.select("query", F.coalesce(right, F.lit(0.0)).alias("r"), F.coalesce((F.col("picks") == F.col("goal")).cast("double"), F.lit(0.0)).alias("p"), F.coalesce("hit", F.lit(0.0)).alias("h"))
    fits = lambda c: F.get("picks", F.col(c).cast("int")) == F.get("goal", F.col(c).cast("int"))
    ends = edges.join(rows.select("query", "picks", "goal"), "query").agg(F.avg(F.coalesce((fits("pos_a") & fits("pos_b")).cast("double"), F.lit(0.0))).alias("edge_accuracy"))
    out = each.agg(F.count("*").alias("queries"), F.avg("r").alias("role_accuracy"), F.avg("p").alias("program_accuracy"), F.avg("h").alias("recall"))
    return out.crossJoin(ends)  # one row beside one row
