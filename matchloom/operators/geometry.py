"""Boxes, points and pose chains."""

from __future__ import annotations

import math
from functools import reduce
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.tables import written

AXES = range(3)


def box_overlaps(boxes: DataFrame, cell: float, least: float = 1e-7, block: int = 2_000, share: int = 50_000_000) -> DataFrame:
    """assembly, a, b, volume, small (the volume of the smaller one) of all pairs of boxes (assembly, id, lo, hi) that overlap by more than `least`, 0 or more; touching is not overlap.

    Boxes are posted under the grid cells that they reach, each with the axes along which it begins there.  A pair is looked at once, in the cell where along each axis one of
    the two begins.  The boxes of a cell that begin alike are dealt into blocks of `block` or so, and each two blocks that have such pairs meet by themselves: a task
    holds two blocks at a time, and a full cell is spread over as many tasks as give each `share` pairs.
    """
    posted = boxes.select("assembly", "id", *[F.col(c)[i].alias(f"{c}{i}") for c in ("lo", "hi") for i in AXES])
    for i in AXES:
        reached = F.sequence(F.floor(F.col(f"lo{i}") / cell), F.floor(F.col(f"hi{i}") / cell))
        posted = posted.select("*", F.posexplode(reached).alias(f"at{i}", f"c{i}"))
    begins = sum(F.when(F.col(f"at{i}") == 0, 1 << i).otherwise(0) for i in AXES)
    posted = posted.withColumn("begins", begins).drop(*[f"at{i}" for i in AXES])
    where = ["assembly", *[f"c{i}" for i in AXES]]
    alike = posted.groupBy(*where, "begins").agg(F.count("*").alias("n"))
    cells = alike.groupBy(*where).agg(F.sum("n").alias("n"), F.collect_list(F.struct("begins", F.ceil(F.col("n") / block).cast("int").alias("blocks"))).alias("of"))
    cells = written(cells, "cells")
    pairs = cells.agg(F.sum(F.col("n").cast("double") * F.col("n") / 2)).first()[0]
    tasks = max(boxes.sparkSession.sparkContext.defaultParallelism, math.ceil((pairs or 0) / share))
    # a block is named by its number and how its boxes begin
    name = lambda k, begins: k * 8 + begins
    mine = F.get(F.filter("of", lambda x: x["begins"] == F.col("begins")), 0)["blocks"]
    met = F.filter("of", lambda x: x["begins"].bitwiseOR(F.col("begins")) == 7)
    met = F.flatten(F.transform(met, lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda k: name(k, x["begins"]))))
    dealt = posted.join(cells.drop("n"), where).withColumns({"block": name(F.pmod(F.xxhash64("id"), mine).cast("int"), F.col("begins")), "met": met})
    dealt = written(dealt.drop("begins", "of"), "dealt")
    sides = ["id", *[f"{c}{i}" for c in ("lo", "hi") for i in AXES]]
    key = [*where, "block_l", "block_r"]
    left = dealt.select(*where, F.col("block").alias("block_l"), F.explode(F.filter("met", lambda x: x >= F.col("block"))).alias("block_r"), *[F.col(c).alias(f"{c}_l") for c in sides])
    right = dealt.select(*where, F.explode(F.filter("met", lambda x: x <= F.col("block"))).alias("block_l"), F.col("block").alias("block_r"), *[F.col(c).alias(f"{c}_r") for c in sides])
    side = [F.least(f"hi{i}_l", f"hi{i}_r") - F.greatest(f"lo{i}_l", f"lo{i}_r") for i in AXES]
    volume = side[0] * side[1] * side[2]
    size = lambda c: reduce(mul, [F.col(f"hi{i}_{c}") - F.col(f"lo{i}_{c}") for i in AXES])
    once = (F.col("id_l") < F.col("id_r")) | ((F.col("block_l") < F.col("block_r")) & (F.col("id_l") > F.col("id_r")))
    found = left.repartition(tasks, *key).join(right.repartition(tasks, *key), key)
    found = found.where((side[0] > 0) & (side[1] > 0) & (side[2] > 0) & once & (volume > least))
    return found.select("assembly", F.least("id_l", "id_r").alias("a"), F.greatest("id_l", "id_r").alias("b"), volume.alias("volume"), F.least(size("l"), size("r")).alias("small"))


def box_iou(a_lo, a_hi, b_lo, b_hi):
    """Shared volume over joint volume of two boxes, as a column."""
    shared, va, vb = F.lit(1.0), F.lit(1.0), F.lit(1.0)
    for i in AXES:
        shared = shared * F.greatest(F.lit(0.0), F.least(a_hi[i], b_hi[i]) - F.greatest(a_lo[i], b_lo[i]))
        va, vb = va * (a_hi[i] - a_lo[i]), vb * (b_hi[i] - b_lo[i])
    return F.coalesce(F.try_divide(shared, va + vb - shared), F.lit(0.0))


def _cells(points: DataFrame, boxes: DataFrame, depth: int) -> DataFrame:
    """points (key, p) with c, their cell (three numbers) in the grid of 2^depth cells along the longest side of their key's box."""
    place = lambda i: F.greatest(F.lit(0), F.least(F.floor((F.col("p")[i] - F.col("lo")[i]) / F.col("side") * float(1 << depth)), F.lit((1 << depth) - 1))).cast("long")
    return points.join(boxes, "key").withColumn("c", F.array(*[place(i) for i in AXES])).drop("lo", "side")


def _gap(outer: bool) -> Column:
    """The square of the least distance of p to the box lo, hi, or of its greatest."""
    p, lo, hi = F.col("p"), F.col("lo"), F.col("hi")
    each = [F.greatest(F.abs(p[i] - lo[i]), F.abs(p[i] - hi[i])) if outer else F.greatest(lo[i] - p[i], p[i] - hi[i], F.lit(0.0)) for i in AXES]
    return each[0] * each[0] + each[1] * each[1] + each[2] * each[2]


def nearest_distances(source: DataFrame, target: DataFrame, leaf: int = 32, levels: int = 2) -> DataFrame:
    """key, id, distance from each source point (key, id, p: three numbers) to its nearest target point of the same key; keys without targets go.

    Target points fill a grid that is halved until no cell holds more than `leaf` of them, and each level knows the boxes of its cells' points.  Source points go down it `levels`
    halvings at a time, and keep of the cells that they reach only those whose box begins no farther than the nearest one ends; the rest cannot hold the nearest
    point.  So a point meets a few cells of each level and the points of a few leaves, wherever it lies.  Exact.
    """
    points = target.select("key", "p").where("p is not null").distinct()
    low, high = [F.array(*[f(F.col("p")[i]) for i in AXES]) for f in (F.min, F.max)]
    boxes = points.groupBy("key").agg(low.alias("lo"), high.alias("hi"))
    side = F.greatest(*[F.col("hi")[i] - F.col("lo")[i] for i in AXES])
    boxes = written(boxes.select("key", "lo", F.when(side > 0, side).otherwise(1.0).alias("side")), "boxes")
    depth = levels
    while depth < 40:
        fullest = _cells(points, boxes, depth).groupBy("key", "c").count().agg(F.max("count")).first()[0]
        if (fullest or 0) <= leaf:
            break
        depth += levels
    leaves = written(_cells(points, boxes, depth), "leaves")
    up = lambda c, n: F.transform(c, lambda x: F.shiftright(x, n))
    tree, table = [], leaves.groupBy("key", "c").agg(low.alias("lo"), high.alias("hi"))
    for n in range(depth // levels):
        tree.append(written(table, "cells"))
        table = tree[-1].groupBy("key", up("c", levels).alias("c")).agg(*[F.array(*[f(F.col(c)[i]) for i in AXES]).alias(c) for f, c in ((F.min, "lo"), (F.max, "hi"))])
    state = source.select("key", "id", "p").join(boxes.select("key"), "key").withColumn("c", F.array(*[F.lit(0).cast("long")] * 3))
    for cells in reversed(tree):
        below = cells.select("key", up("c", levels).alias("c"), F.col("c").alias("child"), "lo", "hi")
        met = state.join(below, ["key", "c"]).select("key", "id", "p", F.col("child").alias("c"), _gap(False).alias("least"), _gap(True).alias("most"))
        bound = F.min("most").over(Window.partitionBy("key", "id"))
        state = written(met.withColumn("bound", bound).where(F.col("least") <= F.col("bound")).select("key", "id", "p", "c"), "reached")
    pairs = state.join(leaves.select("key", "c", F.col("p").alias("q")), ["key", "c"])
    square = F.aggregate(F.zip_with("p", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return pairs.groupBy("key", "id").agg(F.sqrt(F.min(square)).alias("distance"))


def chamfer(source: DataFrame, target: DataFrame, radius: float) -> DataFrame:
    """key, chamfer, precision, recall, f_score of two point sets."""
    there = nearest_distances(source, target).groupBy("key").agg(F.avg("distance").alias("d1"), F.avg((F.col("distance") <= radius).cast("double")).alias("precision"))
    back = nearest_distances(target, source).groupBy("key").agg(F.avg("distance").alias("d2"), F.avg((F.col("distance") <= radius).cast("double")).alias("recall"))
    both = F.col("precision") + F.col("recall")
    return there.join(back, "key").select("key", ((F.col("d1") + F.col("d2")) / 2).alias("chamfer"), "precision", "recall", F.when(both == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / both).alias("f_score"))


def scheduled(pairs: DataFrame, poses: int, budget: int) -> DataFrame:
    """edge, pair, pose, turn: poses of all pairs of an edge in rounds, until its budget is spent."""
    every = pairs.select("edge", "pair", F.explode(F.sequence(F.lit(0), F.lit(poses - 1))).alias("pose"))
    turn = F.row_number().over(Window.partitionBy("edge").orderBy("pose", "pair")) - 1
    return every.withColumn("turn", turn).where(F.col("turn") < budget)


def bounded_attempts(attempts: DataFrame, cap: int) -> DataFrame:
    """Attempts (query, edge, place, accepted) that are made: an edge stops at its first acceptance, a query at `cap` attempts."""
    before = Window.partitionBy("query", "edge").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    alive = attempts.where("place is not null").withColumn("stopped", F.coalesce(F.max(F.col("accepted").cast("int")).over(before), F.lit(0))).where("stopped = 0").drop("stopped")
    turn = F.row_number().over(Window.partitionBy("query").orderBy("edge", "place"))
    return alive.withColumn("turn", turn).where(F.col("turn") <= cap)


def distinct_poses(poses: DataFrame, digits: int = 12) -> DataFrame:
    """Poses (assembly, place, pose) without later repeats, ranked anew from 0."""
    key = F.transform("pose", lambda x: F.round(x, digits) + 0.0)
    first = F.row_number().over(Window.partitionBy("assembly", "key").orderBy("place"))
    kept = poses.withColumn("key", key).withColumn("turn", first).where("turn = 1")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("assembly").orderBy("place")) - 1).drop("key", "turn")


def uniform(*parts) -> Column:
    """A number from 0 to 1 by the hash of its parts: 32 bits."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)


def surface_samples(triangles: DataFrame, count: int, seed: str) -> DataFrame:
    """part, sample, idx, point: points drawn evenly over a part's surface; triangles (part, idx, v0, v1, v2).

    A sample's hash picks the triangle whose stretch of the running area it falls on, and a place in it.  A part without area has no samples.
    """
    side = lambda c: F.zip_with(c, "v0", lambda x, y: x - y)
    cross = lambda u, v: F.array(*[u[(i + 1) % 3] * v[(i + 2) % 3] - u[(i + 2) % 3] * v[(i + 1) % 3] for i in AXES])
    sized = triangles.withColumn("n", cross(side("v1"), side("v2"))).withColumn("area", 0.5 * F.sqrt(F.aggregate("n", F.lit(0.0), lambda s, x: s + x * x)))
    of_part = Window.partitionBy("part")
    ends = sized.withColumn("stop", F.sum("area").over(of_part.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("area").over(of_part))
    ends = ends.where("area > 0").withColumn("start", F.lag("stop", 1, 0.0).over(of_part.orderBy("idx")))
    wanted = ends.groupBy("part").agg(F.max("stop").alias("all")).select("part", "all", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("sample"))
    wanted = wanted.withColumn("at", uniform(F.lit(seed), "part", "sample", F.lit("t")) * F.col("all"))
    picked = wanted.join(ends, "part").where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("stop")))
    u, v = F.sqrt(uniform(F.lit(seed), "part", "sample", F.lit("u"))), uniform(F.lit(seed), "part", "sample", F.lit("v"))
    point = F.array(*[(1 - u) * F.col("v0")[i] + u * (1 - v) * F.col("v1")[i] + u * v * F.col("v2")[i] for i in AXES])
    return picked.select("part", "sample", "idx", point.alias("point"))


def axial_offsets(pairs: DataFrame, keys: list[str], gap: float = 1e-6, same: float = 1e-9) -> DataFrame:
    """keys, turn, offset: where a part may come to rest along an axis: as it lies, just before the other one, just behind it.

    pairs: keys, lo_a, hi_a, lo_b, hi_b (boxes in one frame), axis (any length but 0).  Boxes are projected by their corners; an offset within `same` of one before it is left out.
    """
    unit = F.transform("axis", lambda x: F.try_divide(x, F.sqrt(F.aggregate("axis", F.lit(0.0), lambda s, y: s + y * y))))
    corners = lambda lo, hi: F.array(*[sum((F.col((lo, hi)[(k >> i) & 1])[i] * F.col("_unit")[i] for i in (1, 2)), F.col((lo, hi)[k & 1])[0] * F.col("_unit")[0]) for k in range(8)])
    rows = pairs.withColumn("_unit", unit).withColumns({"_a": corners("lo_a", "hi_a"), "_b": corners("lo_b", "hi_b")})
    offsets = F.array(F.lit(0.0), F.array_min("_a") - F.array_max("_b") - gap, F.array_max("_a") - F.array_min("_b") + gap)
    distinct = F.aggregate(offsets, F.array().cast("array<double>"), lambda kept, x: F.when(F.exists(kept, lambda y: F.abs(x - y) <= same), kept).otherwise(F.concat(kept, F.array(x))))
    return rows.select(*keys, F.posexplode(distinct).alias("turn", "offset"))
