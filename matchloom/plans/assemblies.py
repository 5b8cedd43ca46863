"""Queries on assemblies: five events of a user in a row are one; role i hangs on role (i - 1) // 2, so the graph branches.

An edge's first pose turns by the event's value and moves by a share of it, its second moves the other way.  The edge of an `error`
event has no accepted pose.  Every third user's full assemblies have one more edge from the first role to the last, with a pose far
off and one that fits the first poses, for every other such user by a hair not.  Every eleventh user's second edge names another candidate.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import functions as F

from matchloom.functions import vectors as V
from matchloom.operators import assemblies as A
from matchloom.sources.tables import written

from .geometry import _PLACED, _placed
from .registry import query



def _rows(spark, sf):
    return _placed(spark, sf).select(
        (F.col("user_id") * 1_000_000 + F.floor(F.col("pos") / 5)).alias("query"), (F.col("pos") % 5).cast("int").alias("role"), "user_id", "event_id", "event_type",
        F.col("value").alias("v"), (F.col("value") / 16).alias("dx"), ((F.col("event_id") % 17) / 4).alias("dy"), (1.0 + F.col("event_id") % 3).alias("h"),
    )


def _boxes(rows):
    side = lambda s: F.array(F.col("h") * s, F.lit(1.0 * s), F.lit(1.0 * s))
    return rows.select("query", "role", side(-1).alias("lo"), side(1).alias("hi"))


def _poses(rows):
    """query, edge, role_a, role_b, user_id, candidate_a, candidate_b, accepted, pose_rank, pose"""
    flat = F.array_sort(F.collect_list(F.struct("role", "v", "dx", "dy", "event_id", "event_type")))
    whole = rows.groupBy("query", "user_id").agg(flat.alias("r"))  # five rows at most
    at = lambda r, s: V.pose(r["v"], r["dx"] * s, r["dy"] * s, F.lit(0.0))
    event = lambda i: F.element_at("r", (i + 1).cast("int"))["event_id"]
    parent = F.floor((F.col("c.role") - 1) / 2).cast("int")
    tree = whole.select("query", "user_id", "r", F.explode(F.slice("r", 2, 4)).alias("c")).select(
        "query", F.col("c.role").alias("edge"), parent.alias("role_a"), F.col("c.role").alias("role_b"), "user_id", event(parent).alias("candidate_a"),
        F.when((F.col("user_id") % 11 == 0) & (F.col("c.role") == 2), -1).otherwise(F.col("c.event_id")).alias("candidate_b"), (F.col("c.event_type") != "error").alias("accepted"),
        F.posexplode(F.array(at(F.col("c"), 1.0), at(F.col("c"), -1.0))).alias("pose_rank", "pose"),
    )
    p1, p4 = (at(F.element_at("r", i), 1.0) for i in (2, 5))
    off = F.when(F.col("user_id") % 2 == 0, 0.0).otherwise(1e-3)
    fits = A.let(F.struct(p1.alias("a"), p4.alias("b")), lambda s: V.multiplied(s["a"], s["b"]))
    fits = F.transform(fits, lambda x, i: F.when(i == 3, x + off).otherwise(x))
    ring = whole.where("user_id % 3 = 0 and size(r) = 5").select(
        "query", F.lit(9).alias("edge"), F.lit(0).alias("role_a"), F.lit(4).alias("role_b"), "user_id", event(F.lit(0)).alias("candidate_a"), event(F.lit(4)).alias("candidate_b"), F.lit(True).alias("accepted"),
        F.posexplode(F.array(V.pose(F.lit(0.0), F.lit(1000.0), F.lit(0.0), F.lit(0.0)), fits)).alias("pose_rank", "pose"),
    )
    return tree.unionByName(ring)


def _tables(spark, sf):
    """(rows, edges, execution, picks)"""
    rows = written(_rows(spark, sf), "assembly-rows")
    poses = written(_poses(rows).withColumn("hypothesis_rank", F.lit(0)), "assembly-poses")
    edges = poses.select("query", "edge", "role_a", "role_b").distinct()
    execution = poses.select("query", "edge", "hypothesis_rank", "candidate_a", "candidate_b", "accepted", "pose_rank", "pose")
    return rows, edges, execution, rows.select("query", "role", F.col("event_id").alias("candidate"))


def _searched(spark, sf):
    rows, edges, execution, picks = _tables(spark, sf)
    verdicts, options = A.accepted_options(edges, picks, execution)
    complete = verdicts.where("status = 'complete'").select("query")
    walk = written(A.graph_walk(rows.select("query", "role"), edges).join(complete, "query", "left_semi"), "walk")
    options = written(options, "options")
    return (*A.pose_search(walk, options, _boxes(rows)), rows, edges, picks, options)


_ROWS = f"""{_PLACED}, rw AS (SELECT user_id * 1000000 + pos // 5 AS query, CAST(pos % 5 AS INTEGER) AS role, user_id, event_id, event_type, value AS v, value / 16 AS dx, (event_id % 17) / 4 AS dy, 1.0 + event_id % 3 AS h FROM pl),
  qs AS (SELECT query, user_id, count(*) AS n, count(*) FILTER (WHERE role > 0 AND event_type = 'error') AS errors, count(*) FILTER (WHERE role = 2 AND event_type <> 'error' AND user_id % 11 = 0) AS other FROM rw GROUP BY ALL),
  verdict AS (SELECT *, user_id % 3 = 0 AND n = 5 AS ring, n - 1 + CAST(user_id % 3 = 0 AND n = 5 AS INTEGER) AS edges, CASE WHEN other > 0 THEN 'identity_differs' WHEN errors > 0 THEN 'unknown_incomplete_pair_execution' ELSE 'complete' END AS status FROM qs WHERE n > 1)"""


_TREE = [(1, 0), (2, 0), (3, 1), (4, 1)]
_BOTH, _ONE = "(0, 1.0), (1, -1.0)", "(0, 1.0)"
# an edge's two poses are one option if they are equal at 12 digits
_DISTINCT = "(o.o = 0 OR round(r.dx, 12) <> 0 OR round(r.dy, 12) <> 0)"


def _moved(p: int, s: str = "o.s", r: str = "r", of: str = "s") -> tuple[str, str]:
    """x and y of a row's pose behind role p."""
    cos, sin = f"cos(radians({of}.t{p}))", f"sin(radians({of}.t{p}))"
    return f"{of}.x{p} + {cos} * {s} * {r}.dx - {sin} * {s} * {r}.dy", f"{of}.y{p} + {sin} * {s} * {r}.dx + {cos} * {s} * {r}.dy"


@cache
def _placed_sql(name: str, which: str, order: tuple, options: str, prune: bool) -> str:
    """States {name}0, {name}1, ... after each step, with what was tried in {name}f1, ...; worlds x, y, t (degrees) and half sides bx, by of each role.

    order: (role, parent) by step; a parent of None stands for the edge from the first role that closes the ring.
    """
    out = [f"{name}0 AS (SELECT s.query, s.n, s.user_id, s.ring, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS y0, 0.0::DOUBLE AS t0, r.h::DOUBLE AS bx0, 1.0::DOUBLE AS by0 FROM {which} s JOIN rw r ON r.query = s.query AND r.role = 0)"]
    seen = [0]
    for i, (k, p) in enumerate(order, 1):
        x, y = _moved(p or 0)
        t, more, edge, distinct = f"s.t{p} + r.v", "", k, _DISTINCT
        if p is None:
            fit_x, fit_y = "a.dx + CASE WHEN s.user_id % 2 = 0 THEN 0 ELSE 1e-3 END + cos(radians(a.v)) * r.dx - sin(radians(a.v)) * r.dy", "a.dy + sin(radians(a.v)) * r.dx + cos(radians(a.v)) * r.dy"
            x, y, t, edge = f"CASE o.o WHEN 0 THEN 1000.0 ELSE {fit_x} END", f"CASE o.o WHEN 0 THEN 0.0 ELSE {fit_y} END", "CASE o.o WHEN 0 THEN 0.0 ELSE a.v + r.v END", 9
            more = "JOIN rw a ON a.query = s.query AND a.role = 1"
            distinct = f"(o.o = 0 OR round({fit_x}, 12) <> 1000 OR round({fit_y}, 12) <> 0 OR round(cos(radians(a.v + r.v)), 12) <> 1 OR round(sin(radians(a.v + r.v)), 12) <> 0)"
        shared = lambda j, k=k: " * ".join(f"greatest(0, least({a}{j} + b{a}{j}, {a}{k} + b{a}{k}) - greatest({a}{j} - b{a}{j}, {a}{k} - b{a}{k}))" for a in "xy")
        bad = " OR ".join(f"2 * {shared(j)} > 1e-7" for j in seen) if prune else "false"
        out.append(f"""{name}g{i} AS (SELECT s.*, o.o AS o{edge}, {t} AS t{k}, {x} AS x{k}, {y} AS y{k}, abs(cos(radians({t}))) * r.h + abs(sin(radians({t}))) AS bx{k}, abs(sin(radians({t}))) * r.h + abs(cos(radians({t}))) AS by{k}
    FROM {name}{i - 1} s JOIN rw r ON r.query = s.query AND r.role = {k} {more}, (VALUES {options}) o(o, s) WHERE {distinct}),
  {name}f{i} AS (SELECT *, {bad} AS bad FROM {name}g{i}), {name}{i} AS (SELECT * EXCLUDE bad FROM {name}f{i} WHERE NOT bad UNION ALL BY NAME SELECT * FROM {name}{i - 1} WHERE n <= {k})""")
        seen.append(k)
    return ", ".join(out)


_CLOSE_X, _CLOSE_Y = _moved(1, of="c")
_PICK = "[o1, o2, o3, o4, NULL, NULL, NULL, NULL, o9]"
# a ring's last role hangs on the first, and its edge to role 1 closes the ring
_DONE = f"""{_ROWS}, ready AS (SELECT * FROM verdict WHERE status = 'complete' AND NOT ring), rings AS (SELECT * FROM verdict WHERE status = 'complete' AND ring),
  {_placed_sql('c', 'ready', tuple(_TREE), _BOTH, True)}, {_placed_sql('d', 'rings', ((1, 0), (2, 0), (4, None), (3, 1)), _BOTH, True)},
  e AS (SELECT c.query, c.o1, c.o2, c.o3, c.o9, o.o AS o4, NOT (sqrt(({_CLOSE_X} - c.x4) ** 2 + ({_CLOSE_Y} - c.y4) ** 2) <= 1e-5 AND 1 - cos(radians(c.t1 + r.v - c.t4)) <= 5e-13) AS bad
    FROM d4 c JOIN rw r ON r.query = c.query AND r.role = 4, (VALUES {_BOTH}) o(o, s) WHERE {_DISTINCT}),
  fin AS (SELECT query, o1, o2, o3, o4, o9 FROM e WHERE NOT bad UNION ALL BY NAME SELECT query, o1, o2, o3, o4 FROM c4),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY o1, o2, o9, o3, o4) AS t FROM fin) x WHERE t = 1),
  tried AS (SELECT query, count(*) AS n, count(*) FILTER (WHERE bad) AS hit, 0 AS open FROM ({' UNION ALL '.join(f'SELECT query, bad FROM {c}f{i}' for c in 'cd' for i in range(1, 5))}) z GROUP BY query
    UNION ALL SELECT query, count(*), 0, count(*) FILTER (WHERE bad) FROM e GROUP BY query),
  sums AS (SELECT query, sum(n) AS n, sum(hit) AS hit, sum(open) AS open FROM tried GROUP BY query),
  found AS (SELECT r.query, r.n, r.ring, CASE WHEN b.query IS NOT NULL THEN 'accepted_global_assembly' WHEN r.ring AND r.query IN (SELECT query FROM d4) THEN 'rejected_no_cycle_consistent_global_pose' ELSE 'rejected_no_collision_free_global_pose' END AS status,
    1 + coalesce(s.n, 0) AS explored, coalesce(s.hit, 0) AS hit, coalesce(s.open, 0) AS open FROM (SELECT * FROM ready UNION ALL SELECT * FROM rings) r LEFT JOIN sums s ON s.query = r.query LEFT JOIN best b ON b.query = r.query),
  pick AS (SELECT query, k AS edge, {_PICK}[k] AS pose_rank FROM best, (SELECT unnest([1, 2, 3, 4, 9]) AS k) z WHERE {_PICK}[k] IS NOT NULL)"""


@query(f"WITH {_DONE} SELECT query, status, CAST(explored AS BIGINT) AS explored, CAST(hit AS BIGINT) AS collision_pruned, CAST(open AS BIGINT) AS closure_pruned, CAST(ring AS INTEGER) AS closure_edges FROM found")
def i07_pose_search(spark, sf):
    return _searched(spark, sf)[0].select("query", "status", "explored", "collision_pruned", "closure_pruned", "closure_edges")


_FIRST = _placed_sql("c", "ready", tuple(_TREE), _ONE, False)
_PAIRS = " UNION ALL ".join(
    f"SELECT query, {'true' if (b, a) in _TREE else 'false'} AS joined, 2 * " + " * ".join(f"greatest(0, least({x}{a} + b{x}{a}, {x}{b} + b{x}{b}) - greatest({x}{a} - b{x}{a}, {x}{b} - b{x}{b}))" for x in "xy") + f" > 1e-7 AS hit FROM c4 WHERE n > {b}"
    for b in range(1, 5) for a in range(b)
)


@query(f"""WITH {_ROWS}, ready AS (SELECT * FROM verdict WHERE status = 'complete' AND NOT ring), {_FIRST}, pairs AS ({_PAIRS}),
  h AS (SELECT query, count(*) AS pairs, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE hit AND NOT joined) AS other FROM pairs GROUP BY query)
  SELECT v.query, CASE v.status WHEN 'identity_differs' THEN 'unknown_pre_execution_error' WHEN 'complete' THEN CASE WHEN v.ring THEN 'unknown_pose_graph_closure_failure' WHEN h.hits > 0 THEN 'rejected_global_collision' ELSE 'accepted_global_assembly' END ELSE v.status END AS status,
    h.pairs, h.hits AS collisions, h.other AS other_collisions FROM verdict v LEFT JOIN h ON h.query = v.query""")
def i08_assembly_audit(spark, sf):
    rows, edges, execution, picks = _tables(spark, sf)
    verdicts, options = A.accepted_options(edges, picks, execution)
    walk = written(A.graph_walk(rows.select("query", "role"), edges), "walk")
    return A.assembly_audit(walk, written(verdicts, "verdicts"), written(options, "options"), edges, _boxes(rows))


@query(f"WITH {_ROWS} SELECT query, CAST(edges AS BIGINT) AS edges, CAST(n - 1 - errors + CAST(ring AS INTEGER) AS BIGINT) AS accepted, status FROM verdict")
def j20_accepted_edges(spark, sf):
    _, edges, execution, picks = _tables(spark, sf)
    return A.accepted_options(edges, picks, execution)[0]


_WORLDS = " UNION ALL ".join(f"SELECT query, {k} AS role, round(cos(radians(t{k})), 7) + 0.0 AS cosine, round(x{k}, 7) + 0.0 AS x, round(y{k}, 7) + 0.0 AS y FROM c4 WHERE n > {k}" for k in range(5))


@query(f"WITH {_ROWS}, {_placed_sql('c', 'verdict', tuple(_TREE), _ONE, False)} {_WORLDS}")
def i05_compose_poses(spark, sf):
    rows = written(_rows(spark, sf), "assembly-rows")
    poses = _poses(rows).where("pose_rank = 0 and edge < 9")
    walk = A.graph_walk(rows.select("query", "role"), poses.select("query", "edge", "role_a", "role_b")).where("size(roles) > 1")
    at = lambda i, n: (F.round(F.col("world")[i], 7) + 0.0).alias(n)
    return A.composed(walk, poses).select("query", "role", at(0, "cosine"), at(3, "x"), at(7, "y"))


@query(f"WITH {_ROWS} SELECT query, CAST(edges AS BIGINT) AS edges, NOT (ring AND user_id % 2 = 1) AS closed FROM verdict")
def i06_closure_check(spark, sf):
    """The closing edge's pose either fits the first poses or is off by a hair."""
    rows = written(_rows(spark, sf), "assembly-rows")
    poses = written(_poses(rows).where("pose_rank = if(edge = 9, 1, 0)"), "assembly-poses")
    walk = A.graph_walk(rows.select("query", "role"), poses.select("query", "edge", "role_a", "role_b"))
    return A.closures(A.composed(walk, poses), poses).groupBy("query").agg(F.count("*").alias("edges"), F.bool_and("within").alias("closed"))


def _evidence(spark, sf):
    verdicts, found, rows, edges, picks, options = _searched(spark, sf)
    chosen = found.select("query", F.explode("chosen").alias("c")).select("query", "c.edge", "c.pose_rank")
    programs = edges.join(found.select("query"), "query", "left_semi").where("(query + edge) % 13 <> 0").select(
        "query", "edge", F.when(F.col("edge") == 9, "fixed").otherwise("revolute").alias("mobility"), F.lit("axial_support").alias("support"), F.lit(0).alias("primitive_a"), F.col("edge").alias("primitive_b")
    )
    return verdicts, found, picks, A.connection_evidence(edges.join(found.select("query"), "query", "left_semi"), programs, options, chosen)


@query(f"""WITH {_DONE} SELECT query, edge, CASE WHEN (query + edge) % 13 = 0 THEN NULL WHEN edge = 9 THEN 'fixed' ELSE 'revolute' END AS mobility, CAST(pose_rank AS INTEGER) AS pose_rank, CASE WHEN (query + edge) % 13 = 0 THEN 'program' ELSE 'complete' END AS status FROM pick""")
def j21_connection_evidence(spark, sf):
    return _evidence(spark, sf)[3].select("query", "edge", "mobility", "pose_rank", "status")


@query(f"""WITH {_DONE}, w AS (SELECT query, bool_and((query + edge) % 13 <> 0) AS whole, count(*) AS c FROM pick GROUP BY query)
  SELECT f.query, CASE WHEN f.status <> 'accepted_global_assembly' THEN 'skipped' WHEN w.whole THEN 'exported' ELSE 'incomplete_evidence' END AS status, CASE WHEN w.whole THEN f.n END AS components, CASE WHEN w.whole THEN w.c END AS connections FROM found f LEFT JOIN w ON w.query = f.query""")
def j22_assembly_manifest(spark, sf):
    return A.assembly_manifests(*_evidence(spark, sf)).select("query", "status", "components", "connections")
