"""Queries on exported assemblies, decoders and the language planner: everything is judged over what was asked for."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.ports import MOBILITIES
from matchloom.operators import assemblies as A
from matchloom.operators import decoding as D
from matchloom.operators import evaluation as E
from matchloom.operators import planner as P
from matchloom.sources.tables import shuffled, tasks_for, written

from . import bindings as B
from . import sql as S
from .assemblies import _DONE, _evidence
from .matching import _JOINT, _MOBILITY, _joints
from .registry import query
from .scoring import _SCORES, _beam_sql, _joined_pairs, _scored_pairs, _targets, _unary

# one side of a request's edges: ports of its ends, and a mobility by its number
_NAMES = "[" + ", ".join(f"'{m}'" for m in MOBILITIES) + "]"
_EDGE = f"""ep AS (SELECT e.query, e.edge, e.role_a, e.role_b, e.status, a.contract AS port_a, b.contract AS port_b, {_NAMES}[CAST((e.query + e.edge) % 7 + 1 AS BIGINT)] AS mobility, 'Join ' || e.role_a || ' and ' || e.role_b || '.' AS instruction
  FROM edge e JOIN endpoint a ON a.query = e.query AND a.edge = e.edge AND a.side = 'a' JOIN endpoint b ON b.query = e.query AND b.edge = e.edge AND b.side = 'b')"""
_WORDS = ["Mate", "Join", "Attach", "Fit", "Set", "Couple"]


def _edges(spark, sf):
    cands = written(B.candidates(spark, sf), "candidates")
    ports = written(B.ports(spark, sf), "ports")
    edges = B.edges(spark, sf, cands)
    ends = B.endpoints(spark, sf, ports, cands)
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("contract"))).alias(f"port_{s}")
    both = ends.groupBy("query", "edge").agg(side("a"), side("b"))
    name = F.element_at(F.array(*map(F.lit, MOBILITIES)), ((F.col("query") + F.col("edge")) % 7 + 1).cast("int"))
    rows = shuffled(edges).join(both, ["query", "edge"]).select("query", "edge", "role_a", "role_b", "status", "port_a", "port_b", name.alias("mobility"))
    return written(rows.withColumn("instruction", F.concat(F.lit("Join "), "role_a", F.lit(" and "), "role_b", F.lit("."))), "edge-ports")


@query(f"""WITH {S.REQ}, {_EDGE}, p AS (SELECT query, edge, port_a, port_b, CASE WHEN query % 13 = 0 THEN 'maybe' ELSE status END AS status, CASE WHEN query % 17 = 0 THEN 'welded' ELSE mobility END AS m FROM ep),
  r AS (SELECT *, CASE WHEN status NOT IN ('specified', 'unknown') THEN 'status' WHEN status = 'specified' AND (port_a IS NULL OR port_b IS NULL) THEN 'port' WHEN m = 'welded' THEN 'mobility' ELSE 'ok' END AS reason FROM p)
  SELECT query, edge, status, CASE WHEN reason = 'ok' THEN m END AS mobility, CASE WHEN reason = 'ok' AND status = 'specified' THEN port_a END AS port_a, CASE WHEN reason = 'ok' AND status = 'specified' THEN port_b END AS port_b, reason FROM r""")
def r02_target_connections(spark, sf):
    q = F.col("query")
    rows = _edges(spark, sf).withColumn("status", F.when(q % 13 == 0, "maybe").otherwise(F.col("status"))).withColumn("mobility", F.when(q % 17 == 0, "welded").otherwise(F.col("mobility")))
    return P.target_connections(rows, MOBILITIES)


_TEXTS = "[" + ", ".join(f"'{w} ' || port_a || ' of ' || role_a || ' with ' || port_b || ' of ' || role_b || ', ' || mobility || '.'" for w in _WORDS) + "]"
_HEX = "(SELECT sum(CASE WHEN i < 64 THEN 4 ELSE 1 END * (instr('0123456789abcdef', substr(sha256('train:' || query || ':' || edge), i, 1)) - 1)) FROM (SELECT unnest(range(1, 65)) AS i) d)"


def _texts():
    return F.array(*[F.concat(F.lit(f"{w} "), "port_a", F.lit(" of "), "role_a", F.lit(" with "), "port_b", F.lit(" of "), "role_b", F.lit(", "), "mobility", F.lit(".")) for w in _WORDS])


@query(f"""WITH {S.REQ}, {_EDGE}, v AS (SELECT *, CAST({_HEX} % 6 AS INTEGER) AS v FROM ep)
  SELECT query, edge, CASE WHEN status = 'specified' THEN {_TEXTS}[v + 1] ELSE instruction END AS instruction, status, CASE WHEN status = 'specified' THEN port_a END AS port_a, mobility, CASE WHEN status = 'specified' THEN v END AS variant FROM v""")
def r04_planner_benchmark(spark, sf):
    """The planner's inputs beside its targets, which it does not get."""
    inputs, targets = P.planner_benchmark(_edges(spark, sf), "train", _texts())
    return shuffled(inputs.select("query", "edge", "instruction")).join(targets, ["query", "edge"]).select("query", "edge", "instruction", "status", "port_a", "mobility", "variant")


@query(f"""WITH {S.REQ}, {_EDGE} SELECT query, edge, CASE WHEN query % 9 = 0 THEN 'missing' WHEN query % 19 = 0 THEN 'twice' WHEN query % 17 = 0 THEN 'role' WHEN query % 16 = 0 THEN 'status' WHEN query % 13 = 0 AND status = 'specified' OR (status = 'specified') <> (port_a IS NOT NULL AND port_b IS NOT NULL) THEN 'port'
  WHEN query % 11 = 0 THEN 'mobility' ELSE 'valid' END AS reason FROM ep UNION ALL SELECT query, edge + 100, 'extra' FROM ep WHERE query % 23 = 0 AND query % 9 <> 0""")
def r08_validate_planner_response(spark, sf):
    """Responses that lack edges, answer some twice or too many, swap roles, and name what they may not."""
    rows, q = _edges(spark, sf), F.col("query")
    given = rows.where("query % 9 <> 0").select(
        "query", "edge", F.when(q % 17 == 0, F.col("role_b")).otherwise(F.col("role_a")).alias("role_a"), F.when(q % 17 == 0, F.col("role_a")).otherwise(F.col("role_b")).alias("role_b"),
        F.when(q % 16 == 0, "maybe").otherwise(F.col("status")).alias("status"), F.when(q % 13 != 0, F.col("port_a")).alias("port_a"), "port_b", F.when(q % 11 == 0, "welded").otherwise(F.col("mobility")).alias("mobility"),
    )
    again = given.where("query % 19 = 0").unionByName(given.where("query % 23 = 0").withColumn("edge", F.col("edge") + 100))
    return P.planner_response_reasons(rows, given.unionByName(again), MOBILITIES)


_PREDICTED = """pr AS (SELECT query, edge, CASE WHEN query % 4 = 0 THEN 'unknown' ELSE status END AS status, CASE WHEN (query + edge) % 5 = 0 THEN NULL ELSE mobility END AS mobility, port_a, CASE WHEN query % 6 = 0 THEN port_a ELSE port_b END AS port_b FROM ep WHERE query % 9 <> 0)"""


def _predicted(rows):
    q = F.col("query")
    return rows.where("query % 9 <> 0").select(
        "query", "edge", F.when(q % 4 == 0, "unknown").otherwise(F.col("status")).alias("status"), F.when((q + F.col("edge")) % 5 != 0, F.col("mobility")).alias("mobility"), "port_a", F.when(q % 6 == 0, F.col("port_a")).otherwise(F.col("port_b")).alias("port_b")
    )


_FIELD = " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, round(avg(CASE WHEN string_split(w, '|')[{i + 1}] = string_split(g, '|')[{i + 1}] THEN 1.0 ELSE 0.0 END), 6) AS rate FROM sides" for i, n in enumerate(P.FIELDS))


@query(f"""WITH {S.REQ}, {_EDGE}, {_PREDICTED}, j AS (SELECT e.*, coalesce(p.status = e.status, false) AS s, coalesce(p.mobility = e.mobility, false) AS m, coalesce(p.port_a = e.port_a, false) AND coalesce(p.port_b = e.port_b, false) AS p, p.port_a AS ga, p.port_b AS gb FROM ep e LEFT JOIN pr p ON p.query = e.query AND p.edge = e.edge),
  f AS (SELECT *, s AND m AND (status <> 'specified' OR p) AS e FROM j), sides AS (SELECT port_a AS w, ga AS g FROM f WHERE status = 'specified' UNION ALL SELECT port_b, gb FROM f WHERE status = 'specified')
  SELECT 'status' AS name, count(*) AS n, round(avg(CAST(s AS DOUBLE)), 6) AS rate FROM f UNION ALL SELECT 'mobility', count(*), round(avg(CAST(m AS DOUBLE)), 6) FROM f UNION ALL SELECT 'ports', count(*), round(avg(CASE WHEN status = 'specified' THEN CAST(p AS DOUBLE) END), 6) FROM f
  UNION ALL SELECT 'edge', count(*), round(avg(CAST(e AS DOUBLE)), 6) FROM f UNION ALL SELECT 'query', count(*), round(avg(CAST(q AS DOUBLE)), 6) FROM (SELECT bool_and(e) AS q FROM f GROUP BY query) z UNION ALL {_FIELD}""")
def r10_evaluate_planner(spark, sf):
    rows = _edges(spark, sf)
    rates, fields = P.evaluated_planner(rows, _predicted(rows))
    wide = F.array(*[F.struct(F.lit(n).alias("name"), F.col("queries" if n == "query" else "edges").alias("n"), F.round(n, 6).alias("rate")) for n in ("status", "mobility", "ports", "edge", "query")])
    return rates.select(F.explode(wide).alias("x")).select("x.*").unionByName(fields.select(F.col("field").alias("name"), F.col("sides").alias("n"), F.round(F.col("equal") / F.col("sides"), 6).alias("rate")))


@query(f"""WITH {S.REQ}, {_EDGE}, {_PREDICTED}, c AS (SELECT e.query, e.edge, e.role_a, e.role_b, e.instruction AS natural_, p.query IS NULL AS gone, coalesce(p.status = 'specified', false) AS spec, p.port_a AS pa, p.port_b AS pb, p.mobility AS m FROM ep e LEFT JOIN pr p ON p.query = e.query AND p.edge = e.edge)
  SELECT query, edge, role_a, role_b, CASE WHEN spec THEN 'specified' ELSE 'unknown' END AS status, CASE WHEN spec THEN pa END AS port_a, CASE WHEN spec THEN pb END AS port_b, coalesce(m, 'unknown') AS mobility,
    CASE WHEN m IS NULL THEN natural_ WHEN spec THEN role_a || ' at ' || pa || ' and ' || role_b || ' at ' || pb || ' move as ' || m ELSE role_a || ' and ' || role_b || ' move as ' || m END AS instruction, CASE WHEN gone THEN 'missing' WHEN spec THEN 'specified' ELSE 'unknown' END AS source FROM c""")
def r13_planner_conditioned_protocol(spark, sf):
    rows = _edges(spark, sf)
    plain = F.concat("role_a", F.lit(" and "), "role_b", F.lit(" move as "), "mobility")
    full = F.concat("role_a", F.lit(" at "), "port_a", F.lit(" and "), "role_b", F.lit(" at "), "port_b", F.lit(" move as "), "mobility")
    return P.planner_conditioned(rows, rows, _predicted(rows), MOBILITIES, plain, full)


@query(f"""WITH r AS (SELECT event_id, {_JOINT} AS joint, CASE WHEN event_id % 7 = 0 THEN 'no_anchor' WHEN event_type = 'error' THEN 'unsupported_joint' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < 5 THEN 'offset' ELSE 'accepted' END AS reason FROM events)
  SELECT r.event_id, r.reason, CASE WHEN r.reason = 'accepted' THEN m.mobility END AS mobility, CASE WHEN r.reason = 'accepted' THEN m.rotational + m.translational END AS freedom FROM r LEFT JOIN {_MOBILITY} ON m.joint = r.joint""")
def r14_replay_joints(spark, sf):
    """Every source joint: those that are accepted with their mobility, the others with the first rule that keeps them out."""
    props = B.table(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    joints = _joints(spark, sf).join(props, "event_id")
    rules = [("no_anchor", F.col("event_id") % 7 == 0), ("unsupported_joint", F.col("event_type") == "error"), ("offset", F.col("k") < 5)]
    accepted, excluded = P.replayed_joints(joints, rules)
    none = F.lit(None)
    return accepted.select("event_id", F.lit("accepted").alias("reason"), "mobility", (F.col("rotational") + F.col("translational")).alias("freedom")).unionByName(
        excluded.select("event_id", "reason", none.cast("string").alias("mobility"), none.cast("int").alias("freedom"))
    )


_VERDICT = f"""{_DONE}, w AS (SELECT query, bool_and((query + edge) % 13 <> 0) AS whole, bool_and((query + edge) % 17 <> 0) AS right_ FROM pick GROUP BY query),
  ver AS (SELECT q.query, w.whole IS TRUE AND f.status = 'accepted_global_assembly' AS x, w.right_ AS right_ FROM (SELECT DISTINCT query FROM rw) q LEFT JOIN found f ON f.query = q.query LEFT JOIN w ON w.query = q.query),
  verd AS (SELECT query, x AND query % 4 <> 0 AS parts, x AND right_ IS TRUE AS program, x AND CASE WHEN query % 2 = 0 THEN query % 10 <> 0 ELSE query % 6 <> 3 END AS collision_free, x AND query % 6 <> 3 AS executable FROM ver),
  exact AS (SELECT *, parts AND program AND executable AS exact FROM verd)"""


def _verdicts(spark, sf):
    """The assemblies that the search has exported, read from their manifests, against targets of which some differ."""
    verdicts, found, picks, evidence = _evidence(spark, sf)
    manifests = written(A.assembly_manifests(verdicts, found, picks, evidence), "manifests").where("status = 'exported'")
    parts, joins = E.manifest_rows(manifests)
    q = F.col("query")
    checks = manifests.select("query", F.when(q % 2 == 0, q % 10 != 0).alias("collision_free"), (q % 6 != 3).alias("feasible"))
    goal = picks.withColumn("candidate", F.when((q % 4 == 0) & (F.col("role") == 0), -1).otherwise(F.col("candidate")))
    mobility = F.when((q + F.col("edge")) % 17 == 0, "ball").when(F.col("edge") == 9, "fixed").otherwise("revolute")
    edges = evidence.select("query", "edge", mobility.alias("mobility"), F.lit("axial_support").alias("support"), F.lit(0).alias("primitive_a"), F.col("edge").alias("primitive_b"))
    return written(E.program_verdicts(parts, joins, checks, goal, edges), "verdicts"), manifests.select("query")


@query(f"WITH {_VERDICT} SELECT query, parts, program, collision_free, executable, exact FROM exact")
def e06_program_verdict(spark, sf):
    return _verdicts(spark, sf)[0]


_METHOD = f"""{_VERDICT}, m AS (SELECT e.*, CASE WHEN query % 8 <> 0 THEN 'verified' WHEN query % 16 = 0 THEN 'reference_failed' ELSE 'reference_unavailable' END AS ref, e.query IN (SELECT query FROM ver WHERE x) AND query % 3 <> 0 AS measured FROM exact e),
  rows_ AS (SELECT query, CASE WHEN ref <> 'verified' THEN ref WHEN NOT measured THEN 'method_output_unavailable' ELSE 'scored' END AS status, ref = 'verified' AS scoreable, parts, program, collision_free, executable, exact, CASE WHEN ref = 'verified' AND measured THEN (query % 997) / 5.0 END AS chamfer, CASE WHEN ref = 'verified' AND measured THEN (query % 13) / 13.0 END AS f FROM m)"""


def _judged(spark, sf):
    """Rows of the method: references that were verified, failed or are not there, and measures of two thirds of what was exported."""
    found, exported = _verdicts(spark, sf)
    q = F.col("query")
    status = F.when(q % 8 != 0, "verified").when(q % 16 == 0, "reference_failed")
    references = found.select("query", status.alias("status")).where("status is not null")
    scores = exported.where("query % 3 <> 0").select("query", (q % 997 / 5.0).alias("chamfer"), F.lit(0.5).alias("part_accuracy"), (q % 13 / 13.0).alias("f_score"), F.lit(1.0).alias("translation"), F.lit(2.0).alias("rotation"))
    return E.method_rows(found, references, scores)


@query(f"WITH {_METHOD} SELECT query, status, scoreable, exact, round(chamfer, 6) AS chamfer, round(f, 6) AS f_score FROM rows_")
def e07_evaluate_method(spark, sf):
    """A row for every target, whether its reference could be measured, the method put something out, or neither."""
    return _judged(spark, sf).select("query", "status", "scoreable", "exact", F.round("chamfer", 6).alias("chamfer"), F.round("f_score", 6).alias("f_score"))


@query(f"""WITH {_METHOD} SELECT count(*) AS queries, count(*) FILTER (WHERE scoreable) AS evaluable, count(*) FILTER (WHERE status = 'scored') AS scored, round(avg(CAST(program AS DOUBLE)), 6) AS program_rate, round(avg(CAST(exact AS DOUBLE)), 6) AS exact_rate, round(avg(chamfer), 6) AS chamfer,
  round(avg(CASE WHEN scoreable THEN CASE WHEN status = 'scored' THEN least(chamfer, 100) ELSE 100 END END), 6) AS chamfer_with_failures, round(avg(f), 6) AS f_score FROM rows_""")
def e07_method_summary(spark, sf):
    out = E.method_summary(_judged(spark, sf))
    return out.select("queries", "evaluable", "scored", *[F.round(c, 6).alias(c) for c in ("program_rate", "exact_rate", "chamfer", "chamfer_with_failures", "f_score")])


_BEAM = _beam_sql()


@query(f"""WITH b AS ({_BEAM}), {_SCORES.strip()}, g AS (SELECT query, pos, max(candidate) AS c FROM cand GROUP BY query, pos), w AS (SELECT query, list(c ORDER BY pos) AS goal FROM g GROUP BY query),
  p AS (SELECT query, [CAST(x AS BIGINT) FOR x IN string_split(picks, ',')] AS picks, row_number() OVER (PARTITION BY query ORDER BY score DESC, [CAST(x AS BIGINT) FOR x IN string_split(picks, ',')]) - 1 AS rank FROM b),
  r AS (SELECT w.query, w.goal, p.picks FROM w LEFT JOIN p ON p.query = w.query AND p.rank = 0), h AS (SELECT DISTINCT w.query FROM w JOIN p ON p.query = w.query AND p.picks = w.goal),
  alone AS (SELECT query, pos, max_by(candidate, (score, -candidate)) AS own FROM unary GROUP BY query, pos), ro AS (SELECT g.query, coalesce(r.picks[g.pos + 1] = g.c, false) AS role, a.own = g.c AS own FROM g JOIN r ON r.query = g.query JOIN alone a ON a.query = g.query AND a.pos = g.pos),
  ie AS (SELECT query, pos - 1 AS edge, a, b FROM (SELECT *, row_number() OVER (PARTITION BY query, pos ORDER BY score DESC, a, b) AS t FROM pair) z WHERE t = 1),
  ed AS (SELECT e.query, coalesce(r.picks[e.pos_a + 1] = r.goal[e.pos_a + 1] AND r.picks[e.pos_b + 1] = r.goal[e.pos_b + 1], false) AS pr, (e.query + e.edge) % 6 <> 0 AS m, e.query % 7 <> 0 AND e.query % 9 <> 0 AS s, (e.query + e.edge) % 4 <> 0 AND e.query % 9 <> 0 AS i, coalesce(ie.a = r.goal[e.pos_a + 1] AND ie.b = r.goal[e.pos_b + 1], false) AS ie, e.query % 9 <> 0 AS said
    FROM edge e JOIN r ON r.query = e.query LEFT JOIN ie ON ie.query = e.query AND ie.edge = e.edge AND e.pos_b = e.pos_a + 1),
  ef AS (SELECT query, pr, m AND said AS m, s, i, ie, pr AND m AND said AND s AND i AS joint FROM ed), q AS (SELECT r.query, coalesce(r.picks = r.goal, false) AS p, (SELECT bool_and(joint) FROM ef WHERE ef.query = r.query) AS j, r.query IN (SELECT query FROM h) AS h, (SELECT bool_and(own) FROM ro WHERE ro.query = r.query) AS o FROM r)
  SELECT * FROM (SELECT count(*) AS queries, round(avg(CAST(p AS DOUBLE)), 6) AS strict_part, round(avg(CAST(p AND j AS DOUBLE)), 6) AS strict_program, round(avg(CAST(h AS DOUBLE)), 6) AS recall, round(avg(CAST(o AS DOUBLE)), 6) AS independent_part FROM q) a,
    (SELECT round(avg(CAST(role AS DOUBLE)), 6) AS role, round(avg(CAST(own AS DOUBLE)), 6) AS independent_role FROM ro) b,
    (SELECT round(avg(CAST(pr AS DOUBLE)), 6) AS edge_pair, round(avg(CAST(m AS DOUBLE)), 6) AS mobility, round(avg(CAST(s AS DOUBLE)), 6) AS support, round(avg(CAST(i AS DOUBLE)), 6) AS interface, round(avg(CAST(joint AS DOUBLE)), 6) AS joint, round(avg(CAST(ie AS DOUBLE)), 6) AS independent_edge FROM ef) c""")
def e01_strict_metrics(spark, sf):
    """The decoder's first beam at every grain, beside the best of each role and of each edge by themselves."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "picks")
    cands = written(B.candidates(spark, sf), "candidates")
    cands = cands.repartition(tasks_for(cands), "query")
    unary, scored = written(_unary(spark, sf, cands), "unary"), written(_scored_pairs(spark, sf, cands), "pairs")
    beams = written(D.beam_decode(unary, _joined_pairs(spark, sf, cands, scored)).withColumn("rank", F.row_number().over(order) - 1).select("query", "rank", "picks"), "beams")
    edges, targets = written(B.edges(spark, sf, cands), "edges"), written(_targets(spark, sf, cands), "targets")
    q, n = F.col("query"), F.col("query") + F.col("edge")
    programs = edges.select("query", "edge", (n % 4).alias("mobility"), (q % 5).alias("support"), F.lit(0).alias("a"), F.col("edge").alias("b"))
    said = programs.where("query % 9 <> 0").withColumns({"mobility": F.when(n % 6 == 0, -1).otherwise(F.col("mobility")), "support": F.when(q % 7 == 0, -1).otherwise(F.col("support")), "a": F.when(n % 4 == 0, 1).otherwise(0)})
    alone = unary.groupBy("query", "pos").agg(F.max_by("candidate", F.struct("score", -F.col("candidate"))).alias("candidate"))
    best = Window.partitionBy("query", "pos").orderBy(F.desc("score"), "a", "b")
    pairs = scored.withColumn("t", F.row_number().over(best)).where("t = 1").select("query", (F.col("pos") - 1).alias("edge"), "a", "b")
    # the closing edge of a ring has no pair of its own
    pairs = pairs.join(edges.where("pos_b = pos_a + 1").select("query", "edge"), ["query", "edge"])
    out = E.strict_metrics(beams, targets, edges, programs, said, alone, pairs)
    return out.select("queries", *[F.round(c, 6).alias(c) for c in out.columns if c != "queries"])
