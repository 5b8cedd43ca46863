"""Losses of a linker from its score tables, as values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.tables import shuffled, written

PARTS = ["unary", "pair", "mobility", "support", "interface", "proposal"]
#: What each part's mean counts for; margins are structured.
WEIGHTS = {"unary": 1.0, "pair": 1.0, "mobility": 1.0, "support": 1.0, "interface": 0.5, "proposal": 0.5, "structured": 0.25}


def cross_entropy(scores: DataFrame, targets: DataFrame) -> DataFrame:
    """query, unit, loss, reason: log of the sum of exponentials over the unit's available scores, less the target's.

    scores (query, unit, choice, score, and available, if some are masked), targets (query, unit, choice).  The largest score comes off first, so no exponential
    overflows.  A target whose choice is masked or has no score, or a unit with a score that is not finite, has no loss but a reason.
    """
    open_ = scores.where(F.coalesce(F.col("available"), F.lit(False))) if "available" in scores.columns else scores
    of = Window.partitionBy("query", "unit")
    bad = F.max((F.isnan("score") | (F.abs("score") == float("inf")) | F.col("score").isNull()).cast("int")).over(of)
    shifted = open_.withColumn("top", F.max("score").over(of)).withColumn("bad", bad)
    norm = shifted.groupBy("query", "unit").agg((F.log(F.sum(F.exp(F.col("score") - F.col("top")))) + F.max("top")).alias("norm"), F.max("bad").alias("bad"))
    goal = shuffled(targets.select("query", "unit", "choice")).join(open_.select("query", "unit", "choice", "score"), ["query", "unit", "choice"], "left")
    goal = shuffled(goal).join(norm, ["query", "unit"], "left")
    reason = F.when(F.col("bad") == 1, "not_finite").when(F.col("score").isNull(), "target_unavailable").otherwise("scored")
    return goal.select("query", "unit", F.when(reason == "scored", F.col("norm") - F.col("score")).alias("loss"), reason.alias("reason"))


def linker_loss(parts: dict[str, tuple[DataFrame, DataFrame]], margins: DataFrame | None = None, given_mobility: DataFrame | None = None, weights: dict[str, float] | None = None) -> DataFrame:
    """query, the mean loss of each part, structured, loss (their weighted sum), status.

    parts: scores and targets by part, as cross_entropy takes them; units are roles or edges, so the tables need not have the same ones.  Every query of the unary targets has a row.  A part that a query
    has no target in counts 0, as do interface and proposal targets outside the proposed choices; an unavailable unary or pair target makes the query fail.  given_mobility (query): requests that state
    their mobility, whose mobility part counts 0.  margins (query, unit, positive, negative): a right assignment's score and that of one with a wrong choice, softplus(1 + negative - positive).
    """
    weigh = WEIGHTS | (weights or {})
    unknown = set(parts) - set(PARTS)
    if unknown or "unary" not in parts:
        raise ValueError(f"parts must be among {PARTS}, with unary: {sorted(unknown)}")
    rows = None
    for name, (scores, targets) in parts.items():
        each = cross_entropy(scores, targets)
        if name in ("interface", "proposal"):
            each = each.where("reason <> 'target_unavailable'")
        each = each.select("query", F.lit(name).alias("part"), "loss", "reason")
        rows = each if rows is None else rows.unionByName(each)
    if margins is not None:
        gap = 1 + F.col("negative") - F.col("positive")
        # softplus without overflow
        soft = F.greatest(gap, F.lit(0.0)) + F.log1p(F.exp(-F.abs(gap)))
        rows = rows.unionByName(margins.select("query", F.lit("structured").alias("part"), soft.alias("loss"), F.lit("scored").alias("reason")))
    names = [*PARTS, "structured"]
    found = rows.groupBy("query").agg(
        *[F.coalesce(F.avg(F.when(F.col("part") == n, F.col("loss"))), F.lit(0.0)).alias(n) for n in names], F.max(F.when(F.col("reason") != "scored", F.col("reason"))).alias("reason"), F.count_if(F.col("part") == "unary").alias("roles")
    )
    found = written(found.where("roles > 0"), "loss-parts")
    if given_mobility is not None:
        stated = given_mobility.select("query").distinct().withColumn("stated", F.lit(True))
        found = shuffled(found).join(stated, "query", "left").withColumn("mobility", F.when(F.col("stated"), 0.0).otherwise(F.col("mobility")))
    fine = F.col("reason").isNull()
    value = sum((F.col(n) * weigh[n] for n in names[1:]), F.col(names[0]) * weigh[names[0]])
    return found.select("query", *[F.when(fine, F.col(n)).alias(n) for n in names], F.when(fine, value).alias("loss"), F.coalesce("reason", F.lit("scored")).alias("status"))
