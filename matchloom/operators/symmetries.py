"""Rotations that leave a part as it is, as data, and pose errors that do not count them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.sources.tables import written

_SAME = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]


def turned(a: Column, b: Column) -> Column:
    """The product of two rotations (nine numbers, row by row)."""
    return F.array(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def closed_symmetries(generators: DataFrame, most: int = 120) -> DataFrame:
    """part, rotation, closed: all products of the parts' generators (part, rotation: nine numbers), the identity with them, each once (to six digits).

    The largest finite group of turns that is neither cyclic nor dihedral has 60.  A part with more than `most` products, such as one that turns by an odd angle, has no
    finite group that is of use: it keeps the identity and its generators, with closed false.
    """
    key = F.transform("rotation", lambda x: F.round(x, 6) + 0.0)
    given = generators.select("part", "rotation").where("rotation is not null and size(rotation) = 9")
    start = given.select("part").distinct().withColumn("rotation", F.array(*map(F.lit, _SAME))).unionByName(given)
    found = written(start.withColumn("key", key).dropDuplicates(["part", "key"]), "symmetries")
    steps = found.select("part", F.col("rotation").alias("g"))
    front = found
    while not front.isEmpty():
        made = front.join(steps, "part").select("part", turned(F.col("rotation"), F.col("g")).alias("rotation")).withColumn("key", key).dropDuplicates(["part", "key"])
        front = made.join(found.select("part", "key"), ["part", "key"], "left_anti")
        small = found.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("part")
        front = written(front.join(small, "part", "left_semi").select("part", "rotation", "key"), "symmetries")
        found = written(found.unionByName(front), "symmetries")
    size = found.groupBy("part").agg(F.count("*").alias("n"))
    whole = found.join(size.where(F.col("n") <= most), "part").select("part", "rotation", F.lit(True).alias("closed"))
    rest = start.withColumn("key", key).dropDuplicates(["part", "key"]).join(size.where(F.col("n") > most), "part").select("part", "rotation", F.lit(False).alias("closed"))
    return written(whole.unionByName(rest), "symmetries")


def pose_errors(predicted: DataFrame, reference: DataFrame, symmetries: DataFrame) -> DataFrame:
    """query, role, distance, degrees of the roles whose part is the reference's: how far off the predicted pose lies, and by how much it is turned, at least, over the part's symmetries.

    predicted, reference (query, role, part, pose: 16 numbers), symmetries (part, rotation), which hold the identity or not.
    """
    want = reference.select("query", "role", "part", F.col("pose").alias("r"))
    both = predicted.select("query", "role", "part", F.col("pose").alias("p")).join(want, ["query", "role", "part"])
    groups = symmetries.groupBy("part").agg(F.collect_list("rotation").alias("group"))
    rows = both.join(groups, "part", "left").withColumn("group", F.concat(F.array(F.array(*map(F.lit, _SAME))), F.coalesce("group", F.array().cast("array<array<double>>"))))
    p, r = F.col("p"), F.col("r")
    # the turn from the reference to the prediction
    delta = F.array(*[sum((r[4 * k + i] * p[4 * k + j] for k in (1, 2)), r[i] * p[j]) for i in range(3) for j in range(3)])
    trace = lambda s: sum((F.col("delta")[3 * i + k] * s[3 * k + i] for i in range(3) for k in range(3)), F.lit(0.0))
    least = F.array_min(F.transform("group", lambda s: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace(s) - 1.0) * 0.5)))))
    distance = F.sqrt(sum(((p[i] - r[i]) * (p[i] - r[i]) for i in (3, 7, 11)), F.lit(0.0)))
    return rows.withColumn("delta", delta).select("query", "role", distance.alias("distance"), F.degrees(least).alias("degrees"))


def pose_error_means(errors: DataFrame, reference: DataFrame, diagonals: DataFrame) -> DataFrame:
    """query, parts, matching, translation_pct (of the reference's diagonal), rotation_deg: means over the matching parts, null without one; diagonals (query, diagonal)."""
    parts = reference.groupBy("query").agg(F.count("*").alias("parts")).join(diagonals.select("query", "diagonal"), "query")
    each = errors.groupBy("query").agg(F.count("*").alias("matching"), F.avg("distance").alias("d"), F.avg("degrees").alias("rotation_deg"))
    out = parts.join(each, "query", "left")
    return out.select("query", "parts", F.coalesce("matching", F.lit(0)).alias("matching"), F.try_divide(100 * F.col("d"), F.col("diagonal")).alias("translation_pct"), "rotation_deg")
