"""Queries on sockets.  A part is the faces of one label among 500 vectors in a row, about fifty at any scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import vectors as V
from matchloom.operators import sockets as K
from matchloom.sources.tables import written

from .geometry import _E, _vectors
from .registry import query

_KINDS = ["plane", "hole", "pin"]


def _faces(spark, sf):
    e = F.col("e")
    three = lambda at, f: F.array(*[f(e[at + i]) for i in range(3)])
    size = F.sqrt(e[3] * e[3] + e[4] * e[4] + e[5] * e[5])
    return _vectors(spark, sf).select(
        (F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / 500)).alias("part"), F.col("vec_id").alias("face"), F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("vec_id") % 3 + 1).cast("int")).alias("kind"),
        three(0, lambda x: x).alias("center"), three(3, lambda x: x / size).alias("direction"), three(6, F.abs).alias("extents"), F.abs(e[9]).alias("area"), F.abs(e[10]).alias("radius"),
    )


_FACE = f"""{_E}, face AS (SELECT label * 1000000 + vec_id // 500 AS part, vec_id AS face, ['plane', 'hole', 'pin'][vec_id % 3 + 1] AS kind, e[1:3] AS c, sqrt(e[4] ** 2 + e[5] ** 2 + e[6] ** 2) AS s, [abs(e[7]), abs(e[8]), abs(e[9])] AS x, abs(e[10]) AS area, abs(e[11]) AS radius, e FROM v),
  face2 AS (SELECT *, [e[4] / s, e[5] / s, e[6] / s] AS d FROM face), part AS (SELECT part, count(*) AS n, [min(c[1]), min(c[2]), min(c[3])] AS lo, [max(c[1]), max(c[2]), max(c[3])] AS hi FROM face GROUP BY part),
  diag AS (SELECT part, sqrt((hi[1] - lo[1]) ** 2 + (hi[2] - lo[2]) ** 2 + (hi[3] - lo[3]) ** 2) AS diagonal FROM part)"""


def _parts(faces):
    at = lambda f: F.array(*[f(F.col("center")[i]) for i in range(3)])
    parts = faces.groupBy("part").agg(F.count("*").alias("faces"), F.count_if(F.col("kind") == "pin").alias("splines"), at(F.min).alias("lo"), at(F.max).alias("hi"))
    off = F.zip_with("hi", "lo", lambda x, y: x - y)
    return parts.withColumn("diagonal", F.sqrt(V.dot(off, off)))


_SLOTS = K.SlotRules(parallel=0.8, gap=0.01, least_aspect=1.2)


@query(f"""WITH {_FACE}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY area DESC, face) AS place, max(area) OVER (PARTITION BY part) AS largest FROM face2 WHERE kind = 'plane') z WHERE area >= largest * 0.03 AND place <= 16),
  p AS (SELECT a.part, a.face AS a, b.face AS b, a.area + b.area AS area, abs((a.c[1] - b.c[1]) * a.d[1] + (a.c[2] - b.c[2]) * a.d[2] + (a.c[3] - b.c[3]) * a.d[3]) AS gap, greatest(0.01, g.diagonal * 0.0015) AS least, [(a.x[i] + b.x[i]) / 2 for i in [1, 2, 3]] AS m
    FROM top a JOIN top b ON a.part = b.part AND a.place < b.place JOIN diag g ON g.part = a.part WHERE abs(a.d[1] * b.d[1] + a.d[2] * b.d[2] + a.d[3] * b.d[3]) >= 0.8),
  q AS (SELECT *, list_reverse_sort([y for y in m if y > least * 0.5]) AS sides FROM p WHERE gap > least), r AS (SELECT *, sides[1] / sides[2] AS aspect FROM q WHERE len(sides) >= 2)
  SELECT part, a, b, round(gap, 6) AS gap, round(aspect, 6) AS aspect, round(ln(1 + area) + 0.7 * aspect - 0.25 * gap / greatest(sides[2], 1e-8), 6) AS score FROM r WHERE aspect BETWEEN 1.2 AND 40 AND gap <= sides[2] * 1.5""")
def k06_guide_slots(spark, sf):
    faces = _faces(spark, sf)
    planes = faces.where("kind = 'plane'").withColumnRenamed("direction", "normal")
    return K.guide_slots(planes, _parts(faces), _SLOTS).select("part", "a", "b", *[F.round(c, 6).alias(c) for c in ("gap", "aspect", "score")])


@query(f"""WITH {_FACE}, k AS (SELECT p.*, [hi[1] - lo[1], hi[2] - lo[2], hi[3] - lo[3]] AS sides, (SELECT count(*) FILTER (WHERE f.kind = 'hole' AND f.area > 0.1) FROM face f WHERE f.part = p.part) AS rl, (SELECT count(*) FILTER (WHERE f.kind = 'pin') FROM face f WHERE f.part = p.part) AS splines FROM part p),
  l AS (SELECT *, list_position(sides, list_max(sides)) AS ax, list_max(sides) / greatest(list_sort(sides)[2], 1e-6) AS aspect FROM k WHERE rl < 6 OR splines / n >= 0.4)
  SELECT part, 'axis_00' AS name, 'axis' AS kind, round((lo[ax] + hi[ax]) / 2, 6) + 0.0 AS along, round(2.25 + least(2.0, 0.3 * aspect), 6) AS quality FROM l WHERE aspect >= 1.2
  UNION ALL SELECT part, 'proxy_plane_00', 'plane', round(lo[ax], 6) + 0.0, 1.75 FROM l UNION ALL SELECT part, 'proxy_plane_01', 'plane', round(hi[ax], 6) + 0.0, 1.75 FROM l""")
def k07_proxy_sockets(spark, sf):
    faces = _faces(spark, sf)
    parts = _parts(faces)
    real = faces.where("kind = 'hole' and area > 0.1").select("part", F.concat(F.lit("hole_"), "face").alias("name"))
    out = K.proxy_sockets(parts, real, least_sockets=6, spline_share=0.4, least_aspect=1.2)
    longest = parts.select("part", F.array_position(F.zip_with("hi", "lo", lambda x, y: x - y), F.array_max(F.zip_with("hi", "lo", lambda x, y: x - y))).cast("int").alias("at"))
    return out.join(longest, "part").select("part", "name", "kind", (F.round(F.element_at("origin", F.col("at")), 6) + 0.0).alias("along"), F.round("quality", 6).alias("quality"))


def _sockets(faces):
    flat = F.col("kind") == "plane"
    return faces.select("part", "kind", F.col("face").alias("id"), F.col("center").alias("origin"), F.when(~flat, F.col("direction")).alias("axis"), F.when(flat, F.col("direction")).alias("normal"), F.when(~flat, F.col("radius")).alias("radius"), "area", "extents", F.round(F.log1p("area"), 9).alias("score"))


_NAMES = ", ".join(f"('{k}', '{n}', {float(s)})" for k, names in (("hole", K.END_FRAMES + K.HOLE_FRAMES), ("pin", K.END_FRAMES + K.PIN_FRAMES)) for n, s in names)


@query(f"""WITH {_FACE}, l AS (SELECT *, CASE WHEN radius > 1e-6 AND area / greatest(2 * pi() * radius, 1e-6) > 1e-4 THEN area / greatest(2 * pi() * radius, 1e-6) ELSE greatest(x[1], x[2], x[3]) END AS len FROM face2), n(kind, frame, sign) AS (VALUES {_NAMES})
  SELECT part, face AS id, 'primary' AS frame, round(c[1], 6) + 0.0 AS x, round(d[1], 6) + 0.0 AS dx FROM l UNION ALL SELECT part, face, 'support', round(c[1], 6) + 0.0, round(d[1], 6) + 0.0 FROM l WHERE kind = 'plane'
  UNION ALL SELECT part, face, frame, round(c[1] + d[1] * 0.5 * len * sign, 6) + 0.0, round(d[1] * sign, 6) + 0.0 FROM l JOIN n ON n.kind = l.kind WHERE len > 1e-4""")
def k08_frame_variants(spark, sf):
    at = lambda c: F.round(c[0], 6) + 0.0
    return K.frame_variants(_sockets(_faces(spark, sf))).select("part", "id", "frame", at(F.col("origin")).alias("x"), at(F.coalesce("axis", "normal")).alias("dx"))


def _unlike_sql(a: str, b: str) -> str:
    apart = " + ".join(f"({a}.c[{i}] - {b}.c[{i}]) ** 2" for i in (1, 2, 3))
    turn = " + ".join(f"{a}.d[{i}] * {b}.d[{i}]" for i in (1, 2, 3))
    return f"NOT (sqrt({apart}) <= greatest(1.0, {a}.diagonal * 0.01) AND abs({turn}) >= 0.3 AND ({a}.kind = 'plane' OR abs({a}.radius - {b}.radius) <= greatest(0.3, greatest({a}.radius, {b}.radius) * 0.06)))"


@query(f"""WITH {_FACE}, o AS (SELECT f.*, g.diagonal, round(ln(1 + area), 9) AS score, row_number() OVER (PARTITION BY f.part, kind ORDER BY round(ln(1 + area), 9) DESC, face) AS r FROM face2 f JOIN diag g ON g.part = f.part), k1 AS (SELECT * FROM o WHERE r = 1),
  k2 AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o.part, o.kind ORDER BY o.r) AS t FROM o JOIN k1 ON k1.part = o.part AND k1.kind = o.kind WHERE o.r > 1 AND {_unlike_sql('k1', 'o')}) z WHERE t = 1),
  k3 AS (SELECT * FROM (SELECT o.*, row_number() OVER (PARTITION BY o.part, o.kind ORDER BY o.r) AS t FROM o JOIN k1 ON k1.part = o.part AND k1.kind = o.kind JOIN k2 ON k2.part = o.part AND k2.kind = o.kind WHERE o.r > k2.r AND {_unlike_sql('k1', 'o')} AND {_unlike_sql('k2', 'o')}) z WHERE t = 1)
  SELECT part, kind, face AS id, 0 AS place FROM k1 UNION ALL SELECT part, kind, face, 1 FROM k2 UNION ALL SELECT part, kind, face, 2 FROM k3""")
def i12_greedy_suppression(spark, sf):
    faces = _faces(spark, sf)
    rules = K.Likeness(origin=1.0, coaxial=0.3, parallel=0.3, radius=0.3)
    return K.suppressed(_sockets(faces), _parts(faces), 3, rules)


@query(f"""WITH {_FACE} SELECT face AS id, round(cos(radians(face % 360)) * c[1] - sin(radians(face % 360)) * c[2] + face % 7, 6) + 0.0 AS x, round(sin(radians(face % 360)) * d[1] + cos(radians(face % 360)) * d[2], 6) + 0.0 AS dy, CASE WHEN kind = 'hole' THEN CAST(face % 5 AS DOUBLE) * 2 WHEN kind = 'pin' THEN round(radius, 6) END AS radius FROM face2""")
def k10_world_sockets(spark, sf):
    """Every part in an instance of its own for each face: turned, moved, and with one parameter bound to the radius of holes."""
    sockets = _sockets(_faces(spark, sf)).withColumn("radius_param", F.when(F.col("kind") == "hole", "r")).withColumn("radius_scale", F.lit(2.0)).withColumn("part", F.col("id"))
    turn = V.pose((F.col("id") % 360).cast("double"), (F.col("id") % 7).cast("double"), F.lit(0.0), F.lit(0.0))
    instances = sockets.select(F.col("id").alias("instance"), "part", turn.alias("pose"), F.create_map(F.lit("r"), (F.col("id") % 5).cast("double")).alias("params"))
    out = K.world_sockets(sockets, instances)
    return out.select("id", (F.round(F.col("origin")[0], 6) + 0.0).alias("x"), (F.round(F.coalesce("axis", "normal")[1], 6) + 0.0).alias("dy"), F.round("radius", 6).alias("radius"))


_RULES = K.ExtractionRules(
    area=1e-3, radius=0.01, radius_share=0.01, threaded_radius=0.1, flange_holes=2, planes=5, holes=4, pins=4, threaded_holes=3, flange_planes=3, guide_slots=3,
    direction_step=0.4, cluster_share=0.1, stand_in_sockets=9, slots=_SLOTS, likeness=K.Likeness(origin=0.2, origin_share=0.1, coaxial=0.5, parallel=0.5, radius=0.05),
)
_TYPES = ["plane", "cylinder", "plane", "cylinder", "bspline"]


def _whole_faces(spark, sf):
    face = F.col("face")
    at = lambda i: F.col("e")[i]
    rows = _faces(spark, sf).join(_vectors(spark, sf).select(F.col("vec_id").alias("face"), "e"), "face")
    return rows.select(
        "part", "face", F.element_at(F.array(*map(F.lit, _TYPES)), (face % 5 + 1).cast("int")).alias("surface_type"), "center", F.when(face % 29 != 0, F.col("direction")).alias("normal"), F.col("direction").alias("axis"),
        F.when(face % 31 != 0, F.col("extents")).alias("extents"), "area", F.when(face % 37 != 0, F.col("radius")).alias("radius"), F.when(at(11) < 0, -1).otherwise(1).alias("concavity"), (face % 23).alias("edge_count"),
        (face % 11 == 0).alias("helical"), (face % 19 == 0).alias("thread_hint"), (face % 17 == 0).alias("non_mating"),
    )


def _greedy_sql(name: str, source: str) -> str:
    """Recursion over a group's rows in order (part, kind, i, row, cap, reach): `name` has the rows kept and their place."""
    turned = lambda c: f"(k.{c} IS NULL OR o.row.{c} IS NULL OR abs(list_dot_product(k.{c}, o.row.{c})) >= 0.5)"
    like = f"list_distance(k.o, o.row.o) <= o.reach AND {turned('ax')} AND {turned('nm')} AND (k.r IS NULL OR o.row.r IS NULL OR abs(k.r - o.row.r) <= greatest(0.05, greatest(k.r, o.row.r) * 0.06))"
    return f"""{name}0 AS (SELECT part, kind, i, [row] AS kept FROM {source} WHERE i = 1 UNION ALL
    SELECT g.part, g.kind, o.i, CASE WHEN len(g.kept) < o.cap AND len(list_filter(g.kept, lambda k: {like})) = 0 THEN list_append(g.kept, o.row) ELSE g.kept END FROM {name}0 g JOIN {source} o ON o.part = g.part AND o.kind = g.kind AND o.i = g.i + 1),
  {name}1 AS (SELECT part, kind, unnest(kept) AS row, unnest(range(len(kept))) AS place FROM (SELECT *, row_number() OVER (PARTITION BY part, kind ORDER BY i DESC) AS t FROM {name}0) z WHERE t = 1),
  {name} AS (SELECT part, kind, place, row FROM {name}1)"""


def _canonical_sql(v: str) -> str:
    lead = f"list_position(list_transform({v}, lambda q: abs(q)), list_max(list_transform({v}, lambda q: abs(q))))"
    return f"(CASE WHEN {v}[{lead}] < 0 THEN list_transform({v}, lambda q: -q) ELSE {v} END)"


def _clustered_sql(name: str, source: str) -> str:
    """The best of each cluster, with the cluster's first turn."""
    off = "[o[1] - mid[1], o[2] - mid[2], o[3] - mid[3]]"
    cells = lambda u: f"list_transform({u}, lambda q: CAST(round_even(q / 0.4, 0) AS BIGINT))"
    return f"""{name}0 AS (SELECT *, {_canonical_sql('ax')} AS ua, {_canonical_sql('nm')} AS un, {off} AS d, greatest(0.2, reach0 * 0.1) AS step FROM {source}),
  {name}1 AS (SELECT *, list_dot_product(d, ua) AS al FROM {name}0), {name}2 AS (SELECT *, coalesce({cells('ua')}, [0, 0, 0]) AS k1, coalesce({cells('un')}, [0, 0, 0]) AS k2, coalesce(CAST(round_even(al / step, 0) AS BIGINT), 0) AS k3,
    coalesce(CAST(round_even(sqrt((d[1] - al * ua[1]) ** 2 + (d[2] - al * ua[2]) ** 2 + (d[3] - al * ua[3]) ** 2) / step, 0) AS BIGINT), 0) AS k4, coalesce(CAST(round_even(list_dot_product(d, un) / step, 0) AS BIGINT), 0) AS k5,
    coalesce(CAST(round_even(r / greatest(0.05, r * 0.06), 0) AS BIGINT), -1) AS k6 FROM {name}1),
  {name} AS (SELECT * EXCLUDE (t, turn, first), first AS turn FROM (SELECT *, min(turn) OVER (PARTITION BY part, kind, k1, k2, k3, k4, k5, k6) AS first, row_number() OVER (PARTITION BY part, kind, k1, k2, k3, k4, k5, k6 ORDER BY score DESC, turn) AS t FROM {name}2) z WHERE t = 1)"""


_CAP = "CASE kind WHEN 'plane' THEN 5 WHEN 'hole' THEN 4 WHEN 'pin' THEN 4 WHEN 'threaded_hole' THEN 3 WHEN 'flange_plane' THEN 3 ELSE 3 END"
_ROW = "{'o': o, 'ax': ax, 'nm': nm, 'r': r, 'face': face, 'other': other, 'score': score}"


def _sockets_sql(intrinsic: bool) -> str:
    ordered = lambda source: f"(SELECT part, kind, {_ROW} AS row, {_CAP} AS cap, greatest(0.2, reach0 * 0.1) AS reach, row_number() OVER (PARTITION BY part, kind ORDER BY score DESC, turn) AS i FROM {source})"
    frame = (
        "model AS (SELECT part, [sum(area * c[1]) / sum(area), sum(area * c[2]) / sum(area), sum(area * c[3]) / sum(area)] AS mid, greatest(sqrt(sum(area)), 1e-6) AS reach0 FROM face3 GROUP BY part)" if intrinsic else
        "model AS (SELECT part, [(lo[i] + hi[i]) / 2 for i in [1, 2, 3]] AS mid, greatest(list_distance(lo, hi), 1e-6) AS reach0 FROM box)"
    )
    picked = "cand" if intrinsic else "best"
    slots = "" if intrinsic else f""",
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY area DESC, face) AS place, max(area) OVER (PARTITION BY part) AS largest FROM plane WHERE x IS NOT NULL) z WHERE area >= largest * 0.03 AND place <= 16),
  size AS (SELECT part, face, row_number() OVER (PARTITION BY part ORDER BY area DESC, face) AS n FROM plane),
  sp AS (SELECT a.part, a.face, b.face AS other, a.d AS nm, [(a.c[i] + b.c[i]) / 2 for i in [1, 2, 3]] AS o, a.area + b.area AS area, abs(list_dot_product([a.c[i] - b.c[i] for i in [1, 2, 3]], a.d)) AS gap, greatest(0.01, a.reach0 * 0.0015) AS least, [(a.x[i] + b.x[i]) / 2 for i in [1, 2, 3]] AS m, a.mid, a.reach0
    FROM top a JOIN top b ON a.part = b.part AND a.place < b.place WHERE abs(list_dot_product(a.d, b.d)) >= 0.8),
  sq AS (SELECT *, list_reverse_sort([y for y in m if y > least * 0.5]) AS sides FROM sp WHERE gap > least), sr AS (SELECT *, sides[1] / sides[2] AS aspect, list_position(m, list_max(m)) AS w FROM sq WHERE len(sides) >= 2),
  ss AS (SELECT *, CASE WHEN abs(nm[w]) <= 0.9 THEN w WHEN abs(nm[1]) <= 0.9 THEN 1 ELSE 2 END AS v FROM sr WHERE aspect BETWEEN 1.2 AND 40 AND gap <= sides[2] * 1.5),
  slot AS (SELECT ss.part, 'guide_slot' AS kind, ss.face, ss.other, o, [CASE WHEN v = i THEN 1.0 ELSE 0.0 END for i in [1, 2, 3]] AS ax, nm, CAST(NULL AS DOUBLE) AS r, ln(1 + area) + 0.7 * aspect - 0.25 * gap / greatest(sides[2], 1e-8) AS score, {{'a': x.n, 'b': y.n}} AS turn, mid, reach0
    FROM ss JOIN size x ON x.part = ss.part AND x.face = ss.face JOIN size y ON y.part = ss.part AND y.face = ss.other),
  {_clustered_sql('bslot', 'slot')}, oslot AS {ordered('bslot')}, {_greedy_sql('gslot', 'oslot')}"""
    flat = "t = 'plane' AND n IS NOT NULL AND area >= 1e-3 AND NOT helical AND NOT off AND edges < 18"
    return f"""WITH RECURSIVE {_FACE}, face3 AS (SELECT part, face, {_TYPES}[face % 5 + 1] AS t, c, CASE WHEN face % 29 <> 0 THEN d END AS n, d, CASE WHEN face % 31 <> 0 THEN x END AS x, area, CASE WHEN face % 37 <> 0 THEN radius END AS radius, CASE WHEN e[12] < 0 THEN -1 ELSE 1 END AS concavity, face % 23 AS edges, face % 11 = 0 AS helical, face % 19 = 0 AS hint, face % 17 = 0 AS off FROM face2),
  box AS (SELECT part, [min(c[1] - coalesce(x[1], 0) / 2), min(c[2] - coalesce(x[2], 0) / 2), min(c[3] - coalesce(x[3], 0) / 2)] AS lo, [max(c[1] + coalesce(x[1], 0) / 2), max(c[2] + coalesce(x[2], 0) / 2), max(c[3] + coalesce(x[3], 0) / 2)] AS hi, count(*) AS n, count(*) FILTER (WHERE t = 'bspline') AS splines FROM face3 GROUP BY part),
  {frame}, f4 AS (SELECT f.*, m.mid, m.reach0, max(CASE WHEN {flat} THEN area END) OVER (PARTITION BY f.part) AS topp, max(CASE WHEN t = 'cylinder' AND area >= 1e-3 THEN area END) OVER (PARTITION BY f.part) AS topc FROM face3 f JOIN model m ON m.part = f.part),
  plane AS (SELECT * FROM f4 WHERE {flat} AND area >= topp * 0.012), cyl AS (SELECT *, CASE WHEN concavity < 0 AND (hint OR helical OR (radius <= 0.1 AND edges >= 8)) THEN 'threaded_hole' WHEN concavity < 0 THEN 'hole' ELSE 'pin' END AS kind,
    list_dot_product([c[1] - mid[1], c[2] - mid[2], c[3] - mid[3]], d) AS al FROM f4 WHERE t = 'cylinder' AND area >= 1e-3 AND area >= topc * 0.001 AND (radius IS NULL OR radius >= greatest(0.01, reach0 * 0.01))),
  cand AS (SELECT part, 'plane' AS kind, face, CAST(NULL AS BIGINT) AS other, c AS o, CAST(NULL AS DOUBLE[]) AS ax, n AS nm, CAST(NULL AS DOUBLE) AS r, ln(1 + area) + 0.75 * greatest(0, 1 - list_distance(c, mid) / (0.5 * reach0)) AS score, {{'a': face, 'b': 0}} AS turn, mid, reach0 FROM plane
    UNION ALL SELECT part, kind, face, NULL, c, d, NULL, radius, ln(1 + area) + 2.1 * greatest(0, 1 - sqrt((c[1] - mid[1] - al * d[1]) ** 2 + (c[2] - mid[2] - al * d[2]) ** 2 + (c[3] - mid[3] - al * d[3]) ** 2) / (0.5 * reach0)) + CASE WHEN kind <> 'pin' THEN 0.65 ELSE 0 END + CASE WHEN kind = 'threaded_hole' THEN 0.6 ELSE 0 END
      + CASE WHEN helical THEN 0.35 ELSE 0 END + CASE WHEN edges IN (2, 3, 4, 6, 8) THEN 0.2 ELSE 0 END + coalesce(0.2 * least(radius / reach0, 1), 0), {{'a': face, 'b': 0}}, mid, reach0 FROM cyl),
  {'' if intrinsic else _clustered_sql('best', 'cand') + ','} ocand AS {ordered(picked)}, {_greedy_sql('gcand', 'ocand')},
  fl AS (SELECT p.part, 'flange_plane' AS kind, p.row, p.row.score + 0.35 * count(*) AS score, p.place FROM gcand p JOIN gcand h ON h.part = p.part AND p.kind = 'plane' AND h.kind IN ('hole', 'threaded_hole') AND abs(list_dot_product(p.row.nm, h.row.ax)) >= 0.5 GROUP BY p.part, p.row, p.place HAVING count(*) >= 2),
  gfl AS (SELECT part, kind, place, row, score FROM (SELECT part, kind, row_number() OVER (PARTITION BY part ORDER BY score DESC, place) - 1 AS place, row, score FROM fl) z WHERE place < 3){slots},
  every AS (SELECT part, kind, place, row, row.score AS score FROM gcand UNION ALL SELECT part, kind, place, row, score FROM gfl {'' if intrinsic else 'UNION ALL SELECT part, kind, place, row, row.score FROM gslot'}),
  named AS (SELECT part, CASE WHEN kind = 'plane' AND place = 0 THEN 'base_plane' ELSE kind || '_' || lpad(CAST(CASE WHEN kind = 'plane' THEN place - 1 ELSE place END AS VARCHAR), 2, '0') END AS name, kind, row.face AS face, row.other AS other, row.o[1] AS ox, score AS quality FROM every),
  live AS (SELECT b.*, [hi[1] - lo[1], hi[2] - lo[2], hi[3] - lo[3]] AS s, (SELECT count(*) FROM named k WHERE k.part = b.part AND k.kind <> 'threaded_hole') AS real_ FROM box b WHERE part IN (SELECT part FROM model)),
  spare AS (SELECT *, list_position(s, list_max(s)) AS w, list_max(s) / greatest(list_sort(s)[2], 1e-6) AS aspect FROM live WHERE real_ < 9 OR splines / n >= 0.32)
  SELECT '{'intrinsic' if intrinsic else 'box'}' AS protocol, part, name, kind, face, other, round(ox, 6) + 0.0 AS ox, round(quality, 6) + 0.0 AS quality FROM named
  UNION ALL SELECT '{'intrinsic' if intrinsic else 'box'}', part, 'axis_00', 'axis', NULL, NULL, round((lo[1] + hi[1]) / 2, 6) + 0.0, round(2.25 + least(2.0, 0.3 * aspect), 6) FROM spare WHERE aspect >= 1.55
  UNION ALL SELECT '{'intrinsic' if intrinsic else 'box'}', part, 'proxy_plane_00', 'plane', NULL, NULL, round(CASE WHEN w = 1 THEN lo[1] ELSE (lo[1] + hi[1]) / 2 END, 6) + 0.0, 1.75 FROM spare
  UNION ALL SELECT '{'intrinsic' if intrinsic else 'box'}', part, 'proxy_plane_01', 'plane', NULL, NULL, round(CASE WHEN w = 1 THEN hi[1] ELSE (lo[1] + hi[1]) / 2 END, 6) + 0.0, 1.75 FROM spare"""


@query(f"SELECT * FROM ({_sockets_sql(False)}) one UNION ALL SELECT * FROM ({_sockets_sql(True)}) two")
def k09_extract_sockets(spark, sf):
    """All sockets of every part by both frame protocols."""
    faces = written(_whole_faces(spark, sf), "faces")
    parts = []
    for protocol, intrinsic in (("box", False), ("intrinsic", True)):
        found, _ = K.extracted_sockets(faces, _RULES, intrinsic)
        parts.append(found.select(F.lit(protocol).alias("protocol"), "part", "name", "kind", "face", "other", (F.round(F.col("origin")[0], 6) + 0.0).alias("ox"), (F.round("quality", 6) + 0.0).alias("quality")))
    return parts[0].unionByName(parts[1])
