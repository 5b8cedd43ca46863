"""Queries on vectors, poses, boxes and points."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import vectors as V
from matchloom.operators import geometry as G

from . import bindings as B
from .registry import query


def _vectors(spark, sf):
    return B.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


_E = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)"


@query(f"WITH {_E} SELECT vec_id, CASE WHEN e[1] >= greatest(e[2], e[3], e[4], e[5]) THEN 'circle' WHEN e[2] >= greatest(e[3], e[4], e[5]) THEN 'cylinder' WHEN e[3] >= greatest(e[4], e[5]) THEN 'cone' WHEN e[4] >= e[5] THEN 'plane' ELSE 'line' END AS type FROM v")
def p01_primitive_type(spark, sf):
    names = F.array(*map(F.lit, ["circle", "cylinder", "cone", "plane", "line"]))
    hot = F.slice("e", 1, 5)
    return _vectors(spark, sf).select("vec_id", F.element_at(names, F.array_position(hot, F.array_max(hot)).cast("int")).alias("type"))


@query(f"""WITH {_E}, x AS (SELECT vec_id, e[1] AS a, greatest(e[2], 0) AS b, e[3] AS c, CASE WHEN vec_id % 7 = 0 THEN 'inf' ELSE 'no' END AS w, e[5] AS f FROM v)
  SELECT vec_id, round(a, 6) + 0.0 AS n0, round(ln(1 + b), 6) + 0.0 AS n1, round(sign(c) * ln(1 + abs(c)), 6) + 0.0 AS n2, CASE WHEN w = 'inf' THEN 30.0 ELSE 0.0 END AS n5 FROM x""")
def p18_clean_numeric(spark, sf):
    wild = F.when(F.col("vec_id") % 7 == 0, float("inf")).otherwise(float("nan"))
    n = V.node_features(F.array(*[F.col("e")[i] for i in range(5)], wild))
    at = lambda i: F.round(F.col("n")[i], 6) + 0.0
    return _vectors(spark, sf).select("vec_id", n.alias("n")).select("vec_id", at(0).alias("n0"), at(1).alias("n1"), at(2).alias("n2"), at(5).alias("n5"))


_PAIR = f"WITH {_E}, p AS (SELECT a.vec_id, a.label, a.e AS a, b.e AS b FROM (SELECT *, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM v) a JOIN v b ON b.vec_id = a.nxt)"


def _pairs(spark, sf):
    order = Window.partitionBy("label").orderBy("vec_id")
    return _vectors(spark, sf).withColumn("b", F.lead("e").over(order)).where("b is not null").withColumnRenamed("e", "a")


@query(f"""{_PAIR} SELECT vec_id, round(list_sum(a), 5) + 0.0 AS a, round(list_sum(b), 5) + 0.0 AS b, round(list_inner_product(a, b), 5) + 0.0 AS product,
  round(list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - b[i]))), 5) + 0.0 AS difference FROM p""")
def p19_interaction_features(spark, sf):
    blocks = {"a": F.col("a"), "b": F.col("b"), "product": F.zip_with("a", "b", lambda x, y: x * y), "difference": F.zip_with("a", "b", lambda x, y: F.abs(x - y))}
    return _pairs(spark, sf).select("vec_id", *[(F.round(V.total(c), 5) + 0.0).alias(n) for n, c in blocks.items()])


@query(f"{_PAIR} SELECT vec_id, round(100 * list_cosine_similarity(a, b), 5) + 0.0 AS score FROM p")
def p20_cosine_score(spark, sf):
    return _pairs(spark, sf).select("vec_id", (F.round(100 * V.cosine(F.col("a"), F.col("b")), 5) + 0.0).alias("score"))


@query("""SELECT event_id, CASE event_id % 12 WHEN 1 THEN 'shape' WHEN 2 THEN 'not_finite' WHEN 3 THEN 'last_row' WHEN 4 THEN 'not_orthonormal' WHEN 5 THEN 'mirrored' ELSE 'valid' END AS status FROM events""")
def p21_pose_valid(spark, sf):
    kind = F.col("event_id") % 12
    events = B.table(spark, sf, "events").withColumn("pose", V.pose(F.col("value"), F.col("value"), (F.col("event_id") % 17).cast("double"), F.lit(0.0)))
    swap = lambda i, x: F.transform("pose", lambda v, k: F.when(k == i, x(v)).otherwise(v))
    broken = (
        F.when(kind == 1, F.slice("pose", 1, 15)).when(kind == 2, swap(3, lambda v: F.lit(float("nan")))).when(kind == 3, swap(15, lambda v: F.lit(2.0)))
        .when(kind == 4, swap(10, lambda v: F.lit(1.5))).when(kind == 5, swap(10, lambda v: F.lit(-1.0))).otherwise(F.col("pose"))
    )
    return events.withColumn("pose", broken).select("event_id", V.pose_status(F.col("pose")).alias("status"))


_NEXT = "n AS (SELECT event_id, value AS v, event_id % 17 AS y, lead(value) OVER w AS v2, lead(event_id) OVER w % 17 AS y2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


@query(f"""WITH {_NEXT} SELECT event_id, round(cos(radians(v + v2)), 5) + 0.0 AS cosine, round(cos(radians(v)) * v2 - sin(radians(v)) * y2 + v, 5) + 0.0 AS x, round(sin(radians(v)) * v2 + cos(radians(v)) * y2 + y, 5) + 0.0 AS y,
  round(-(cos(radians(v)) * v + sin(radians(v)) * y), 5) + 0.0 AS back_x FROM n WHERE v2 IS NOT NULL""")
def p22_pose_algebra(spark, sf):
    pose = V.pose(F.col("value"), F.col("value"), (F.col("event_id") % 17).cast("double"), F.lit(0.0))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    both = B.table(spark, sf, "events").withColumn("p", pose).withColumn("q", F.lead("p").over(order)).where("q is not null")
    found = both.select("event_id", V.multiplied(F.col("p"), F.col("q")).alias("m"), V.inverse(F.col("p")).alias("i"))
    at = lambda c, i, n: (F.round(F.col(c)[i], 5) + 0.0).alias(n)
    return found.select("event_id", at("m", 0, "cosine"), at("m", 3, "x"), at("m", 7, "y"), at("i", 3, "back_x"))


@query(f"""WITH {_E}, d AS (SELECT vec_id, e[4] AS x, e[5] AS y, e[6] AS z, sqrt(e[4] * e[4] + e[5] * e[5] + e[6] * e[6]) AS s FROM v),
  f AS (SELECT vec_id, x / s AS x, y / s AS y, z / s AS z, CASE WHEN abs(x) >= greatest(abs(y), abs(z)) THEN x WHEN abs(y) >= abs(z) THEN y ELSE z END < 0 AS flip FROM d)
  SELECT vec_id, CAST(round_even(CASE WHEN flip THEN -x ELSE x END / 0.25, 0) AS BIGINT) AS kx, CAST(round_even(CASE WHEN flip THEN -y ELSE y END / 0.25, 0) AS BIGINT) AS ky, CAST(round_even(CASE WHEN flip THEN -z ELSE z END / 0.25, 0) AS BIGINT) AS kz FROM f""")
def p23_quantize_key(spark, sf):
    axis = _vectors(spark, sf).select("vec_id", V.canonical_direction(F.slice("e", 4, 3)).alias("d"))
    return axis.select("vec_id", *[V.quantised(F.col("d")[i], 0.25).alias(n) for i, n in enumerate(["kx", "ky", "kz"])])


@query("SELECT vec_id, vec_id % 9 > 1 AS finite FROM embeddings")
def p24_finite_tree(spark, sf):
    kind = F.col("vec_id") % 9
    values = F.when(kind == 0, F.array().cast("array<double>")).when(kind == 1, F.concat("e", F.array(F.lit(float("-inf"))))).otherwise(F.col("e"))
    return _vectors(spark, sf).select("vec_id", V.finite(values).alias("finite"))


_BOX = f"{_E}, box AS (SELECT label, vec_id AS id, [e[1] - abs(e[7]), e[2] - abs(e[8]), e[3] - abs(e[9])] AS lo, [e[1] + abs(e[7]), e[2] + abs(e[8]), e[3] + abs(e[9])] AS hi FROM v)"


def _boxes(spark, sf):
    side = lambda s: F.array(*[F.col("e")[i] + s * F.abs(F.col("e")[6 + i]) for i in range(3)])
    return _vectors(spark, sf).select(F.col("label").alias("assembly"), F.col("vec_id").alias("id"), side(-1).alias("lo"), side(1).alias("hi"))


_SIDES = " * ".join(f"greatest(0, least(a.hi[{i}], b.hi[{i}]) - greatest(a.lo[{i}], b.lo[{i}]))" for i in (1, 2, 3))


@query(f"WITH {_BOX} SELECT a.label AS assembly, a.id AS a, b.id AS b, round({_SIDES}, 8) + 0.0 AS volume FROM box a JOIN box b ON a.label = b.label AND a.id < b.id WHERE {_SIDES} > 1e-7")
def j18_aabb_collisions(spark, sf):
    return G.box_overlaps(_boxes(spark, sf), cell=0.25).select("assembly", "a", "b", V.rounded(F.col("volume"), 8).alias("volume"))


@query(f"""WITH {_BOX}, n AS (SELECT *, lead(id) OVER (PARTITION BY label ORDER BY id) AS nxt FROM box), p AS (SELECT a.id, {_SIDES} AS s, (a.hi[1] - a.lo[1]) * (a.hi[2] - a.lo[2]) * (a.hi[3] - a.lo[3]) AS va, (b.hi[1] - b.lo[1]) * (b.hi[2] - b.lo[2]) * (b.hi[3] - b.lo[3]) AS vb FROM n a JOIN box b ON b.id = a.nxt)
  SELECT id, round(s / (va + vb - s), 6) + 0.0 AS iou FROM p""")
def j27_box_volume_iou(spark, sf):
    order = Window.partitionBy("assembly").orderBy("id")
    both = _boxes(spark, sf).withColumn("lo_b", F.lead("lo").over(order)).withColumn("hi_b", F.lead("hi").over(order)).where("lo_b is not null")
    return both.select("id", (F.round(G.box_iou(F.col("lo"), F.col("hi"), F.col("lo_b"), F.col("hi_b")), 6) + 0.0).alias("iou"))


_DIST = f"""{_E}, s AS (SELECT label, vec_id, e FROM v WHERE vec_id % 2 = 0), t AS (SELECT label, vec_id, e FROM v WHERE vec_id % 2 = 1),
  d AS (SELECT s.label, s.vec_id AS si, t.vec_id AS ti, sqrt((s.e[1] - t.e[1]) ** 2 + (s.e[2] - t.e[2]) ** 2 + (s.e[3] - t.e[3]) ** 2) AS d FROM s JOIN t ON s.label = t.label)"""


def _points(spark, sf, odd):
    return _vectors(spark, sf).where(F.col("vec_id") % 2 == odd).select(F.col("label").alias("key"), F.col("vec_id").alias("id"), F.slice("e", 1, 3).alias("p"))


@query(f"WITH {_DIST} SELECT label AS key, si AS id, round(min(d), 6) AS distance FROM d GROUP BY label, si")
def j23_nearest_distance(spark, sf):
    return G.nearest_distances(_points(spark, sf, 0), _points(spark, sf, 1)).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {_DIST}, x AS (SELECT label, avg(m) AS d, avg(CASE WHEN m <= 0.1 THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT label, si, min(d) AS m FROM d GROUP BY ALL) q GROUP BY label),
  y AS (SELECT label, avg(m) AS d, avg(CASE WHEN m <= 0.1 THEN 1.0 ELSE 0.0 END) AS p FROM (SELECT label, ti, min(d) AS m FROM d GROUP BY ALL) q GROUP BY label)
  SELECT x.label AS key, round((x.d + y.d) / 2, 6) AS chamfer, round(x.p, 6) AS precision, round(y.p, 6) AS recall, CASE WHEN x.p + y.p = 0 THEN 0.0 ELSE round(2 * x.p * y.p / (x.p + y.p), 6) END AS f_score FROM x JOIN y ON x.label = y.label""")
def j24_chamfer_fscore(spark, sf):
    out = G.chamfer(_points(spark, sf, 0), _points(spark, sf, 1), 0.1)
    return out.select("key", *[F.round(c, 6).alias(c) for c in ("chamfer", "precision", "recall", "f_score")])


def _placed(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return B.table(spark, sf, "events").withColumn("pos", F.row_number().over(order) - 1)


def _sixes(spark, sf):
    """Six events of a user in a row are the frames of an edge: three of its left part, three of its right."""
    return _placed(spark, sf).withColumn("edge", F.col("user_id") * 1_000_000 + F.floor(F.col("pos") / 6)).withColumn("place", F.col("pos") % 6)


_PLACED = "pl AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"


@query(f"""WITH {_PLACED}, six AS (SELECT *, user_id * 1000000 + pos // 6 AS edge, pos % 6 AS place FROM pl), f AS (SELECT a.edge, a.place * 3 + b.place - 3 AS pair FROM six a JOIN six b ON a.edge = b.edge AND a.place < 3 AND b.place > 2),
  e AS (SELECT edge, pair, unnest(range(0, 8)) AS pose FROM f), t AS (SELECT *, row_number() OVER (PARTITION BY edge ORDER BY pose, pair) - 1 AS turn FROM e)
  SELECT edge, CAST(pair AS INTEGER) AS pair, CAST(pose AS INTEGER) AS pose, CAST(turn AS INTEGER) AS turn FROM t WHERE turn < 32""")
def w11_pose_schedule(spark, sf):
    p = _sixes(spark, sf)
    left, right = p.where("place < 3").select("edge", F.col("place").alias("l")), p.where("place > 2").select("edge", F.col("place").alias("r"))
    pairs = left.join(right, "edge").select("edge", (F.col("l") * 3 + F.col("r") - 3).alias("pair"))
    return G.scheduled(pairs, poses=8, budget=32)


@query(f"""WITH {_PLACED}, s AS (SELECT user_id AS query, event_id % 4 AS edge, pos AS place, event_type = 'purchase' AS accepted, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_id % 4 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM pl),
  t AS (SELECT query, edge, place, accepted, row_number() OVER (PARTITION BY query ORDER BY edge, place) AS turn FROM s WHERE stopped = 0)
  SELECT query, edge, CAST(place AS INTEGER) AS place, accepted, CAST(turn AS INTEGER) AS turn FROM t WHERE turn <= 10""")
def w12_bounded_attempts(spark, sf):
    attempts = _placed(spark, sf).select(F.col("user_id").alias("query"), (F.col("event_id") % 4).alias("edge"), F.col("pos").alias("place"), (F.col("event_type") == "purchase").alias("accepted"))
    return G.bounded_attempts(attempts, cap=10)


@query(f"""WITH {_PLACED}, k AS (SELECT user_id AS assembly, pos AS place, row_number() OVER (PARTITION BY user_id, floor(value), event_id % 3 ORDER BY pos) AS t FROM pl)
  SELECT assembly, CAST(place AS INTEGER) AS place, CAST(row_number() OVER (PARTITION BY assembly ORDER BY place) - 1 AS INTEGER) AS rank FROM k WHERE t = 1""")
def w13_distinct_poses(spark, sf):
    pose = V.pose(F.lit(0.0), F.floor("value").cast("double"), (F.col("event_id") % 3).cast("double"), F.lit(0.0))
    return G.distinct_poses(_placed(spark, sf).select(F.col("user_id").alias("assembly"), F.col("pos").alias("place"), pose.alias("pose"))).drop("pose")
