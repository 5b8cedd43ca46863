"""Queries on ports, candidates and assignments."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import ports as P
from matchloom.operators import assignments as A
from matchloom.operators import ports as O
from matchloom.operators import ranking as R
from matchloom.operators.ordering import quantiles
from matchloom.sources.tables import written

from . import bindings as B
from . import sql as S
from .registry import query

# the sources' joint names that stand for event types
JOINT_OF_EVENT = {"click": "RevoluteJointType", "view": "RigidJointType", "purchase": "SliderJointType", "scroll": "PlanarJointType", "login": "BallJointType"}


@query(f"WITH {S.PRIM} SELECT step, ordinal, measure FROM prim")
def p02_port_measure(spark, sf):
    return B.primitives(spark, sf).select("step", "ordinal", "measure")


@query(f"WITH {S.PORT} SELECT step, ordinal, size_class, adjacent, symmetry, contract FROM port")
def w01_describe_ports(spark, sf):
    return B.ports(spark, sf).select("step", "ordinal", "size_class", "adjacent", "symmetry", "contract")


@query(f"""WITH {S.PORT} SELECT step, l.level, kind, CASE WHEN level >= 2 THEN geometry_type END AS geometry_type,
  CASE WHEN level >= 3 THEN size_class END AS size_class, CASE WHEN level >= 4 THEN adjacent END AS adjacent, CASE WHEN level >= 5 THEN symmetry END AS symmetry
  FROM port, (SELECT unnest([1, 2, 3, 4, 5]) AS level) l WHERE ordinal = 0""")
def p05_project_contract(spark, sf):
    levels = F.explode(F.array(*map(F.lit, range(1, 6)))).alias("level")
    at = lambda n, c: F.when(F.col("level") >= n, F.col(c)).alias(c)
    return B.ports(spark, sf).where("ordinal = 0").select("*", levels).select("step", "level", "kind", at(2, "geometry_type"), at(3, "size_class"), at(4, "adjacent"), at(5, "symmetry"))


@query(f"""WITH {S.PORT} SELECT q.step, count(*) FILTER (WHERE p.kind = q.kind) AS fields_1, count(*) FILTER (WHERE p.kind = q.kind AND p.geometry_type = q.geometry_type) AS fields_2,
  count(*) FILTER (WHERE p.kind = q.kind AND p.geometry_type = q.geometry_type AND p.size_class = q.size_class) AS fields_3,
  count(*) FILTER (WHERE p.kind = q.kind AND p.geometry_type = q.geometry_type AND p.size_class = q.size_class AND p.adjacent = q.adjacent) AS fields_4, count(*) FILTER (WHERE p.contract = q.contract) AS fields_5
  FROM port q JOIN port p ON p.step = q.step WHERE q.ordinal = 0 GROUP BY q.step""")
def p06_contract_matches(spark, sf):
    found = B.ports(spark, sf)
    fields = O.CONTRACT
    of_step = Window.partitionBy("step")
    asked = found.withColumns({f"want_{c}": F.max(F.when(F.col("ordinal") == 0, F.col(c))).over(of_step) for c in fields})
    # counted by the window too, as an aggregate would hold all steps of a task
    same = lambda n: F.count_if(reduce(and_, [F.col(c).eqNullSafe(F.col(f"want_{c}")) for c in fields[:n]])).over(of_step)
    return asked.withColumns({f"fields_{n}": same(n) for n in range(1, 6)}).where("ordinal = 0").select("step", *[f"fields_{n}" for n in range(1, 6)])


@query(f"""WITH {S.PORT} SELECT step, ordinal, CASE WHEN size_class <> 'only' THEN size_class || ' ' ELSE '' END || geometry_type || ' ' || kind
  || CASE WHEN symmetry = 'repeated' THEN ' in a repeated symmetric set' ELSE '' END AS phrase, geometry_type || ' ' || kind AS partial FROM port""")
def p07_port_phrase(spark, sf):
    none = F.array().cast("array<string>")
    whole = P.port_phrase(F.col("kind"), F.col("geometry_type"), F.col("size_class"), none, F.col("symmetry"))
    part = P.port_phrase(F.col("kind"), F.col("geometry_type"), F.lit(None).cast("string"), none, F.lit(None).cast("string"))
    return B.ports(spark, sf).select("step", "ordinal", whole.alias("phrase"), part.alias("partial"))


@query(f"""WITH {S.CAND} SELECT query, edge, role_a, role_b, 'Fasten ' || role_a || ' to ' || role_b || ' so that no relative motion remains.' AS text_0,
  'Join ' || role_a || ' and ' || role_b || ' as one rigid connection.' AS text_1 FROM edge""")
def p08_render_instruction(spark, sf):
    # fixed values: the two prompts of a fixed connection
    templates = ["Fasten {a} to {b} so that no relative motion remains.", "Join {a} and {b} as one rigid connection."]
    fill = lambda t: F.replace(F.replace(F.lit(t), F.lit("{a}"), F.col("role_a")), F.lit("{b}"), F.col("role_b"))
    return B.edges(spark, sf).select("query", "edge", "role_a", "role_b", *[fill(t).alias(f"text_{i}") for i, t in enumerate(templates)])


@query(f"""WITH {S.CAND}, h AS (SELECT query, edge, sha256('train:' || query || ':' || edge) AS d FROM edge),
  x AS (SELECT query, edge, unnest(range(1, 65)) AS i, d FROM h)
  SELECT query, edge, CAST((sum(CASE WHEN i < 64 THEN 4 ELSE 1 END * (instr('0123456789abcdef', substr(d, i, 1)) - 1))) % 6 AS BIGINT) AS variant FROM x GROUP BY query, edge""")
def p09_hash_variant(spark, sf):
    digest = F.sha2(F.concat_ws(":", F.lit("train"), "query", "edge"), 256)
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(digest, i, F.lit(1))) - 1)
    # 16 to any power above 0 is 4 modulo 6
    total = F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: a + 4 * x) - 3 * F.element_at(digits, 64)
    return B.edges(spark, sf).select("query", "edge", F.pmod(total, F.lit(6)).cast("long").alias("variant"))


_MOBILITY = "(VALUES " + ", ".join(f"('{a}', '{b}', {c}, {d})" for a, b, c, d in P.MOBILITY_BY_JOINT) + ") m(joint, mobility, rotational, translational)"
_JOINT = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in JOINT_OF_EVENT.items()) + " ELSE 'PinSlotJointType' END"


def _joints(spark, sf):
    joint = F.lit("PinSlotJointType")
    for k, v in JOINT_OF_EVENT.items():
        joint = F.when(F.col("event_type") == k, v).otherwise(joint)
    # seven fixed rows
    fixed = F.broadcast(spark.createDataFrame(P.MOBILITY_BY_JOINT, "joint string, mobility string, rotational int, translational int"))
    return B.table(spark, sf, "events").select("event_id", "event_type", joint.alias("joint")).join(fixed, "joint", "left")


@query(f"SELECT mobility, rotational, translational, count(*) AS n FROM (SELECT {_JOINT} AS joint FROM events) e LEFT JOIN {_MOBILITY} USING (joint) GROUP BY ALL")
def p11_mobility_dof(spark, sf):
    return _joints(spark, sf).groupBy("mobility", "rotational", "translational").agg(F.count("*").alias("n"))


@query(f"""SELECT e.mobility, m.mobility AS other, count(*) AS n FROM (SELECT {_JOINT} AS joint FROM events) j JOIN {_MOBILITY.replace(' m(', ' e(')} USING (joint)
  JOIN {_MOBILITY} ON m.mobility <> e.mobility AND (e.mobility NOT IN ('fixed', 'revolute', 'prismatic', 'cylindrical') OR m.mobility IN ('fixed', 'revolute', 'prismatic', 'cylindrical'))
  GROUP BY ALL""")
def p10_counterfactual_mobility(spark, sf):
    return _joints(spark, sf).select("mobility", F.explode(P.other_mobilities(F.col("mobility"))).alias("other")).groupBy("mobility", "other").agg(F.count("*").alias("n"))


@query(f"""WITH {S.PRIM} SELECT a.step, a.ordinal, CASE WHEN a.geometry_type IN ('circle', 'cylinder') AND b.geometry_type IN ('circle', 'cylinder') THEN 'axial_support'
    WHEN a.geometry_type = 'plane' AND b.geometry_type = 'plane' THEN 'planar_support' WHEN a.geometry_type = 'plane' OR b.geometry_type = 'plane' THEN 'axis_plane_support' ELSE 'other' END AS family
  FROM prim a JOIN prim b ON b.step = a.step AND b.ordinal = a.ordinal + 1""")
def p12_support_family(spark, sf):
    order = Window.partitionBy("step").orderBy("ordinal")
    pairs = B.primitives(spark, sf).withColumn("next", F.lead("geometry_type").over(order)).where("next is not null")
    return pairs.select("step", "ordinal", P.primitive_support(F.col("geometry_type"), F.col("next")).alias("family"))


@query(f"WITH {S.CAND} SELECT query, edge, least(role_a, role_b) AS low, greatest(role_a, role_b) AS high FROM edge")
def p13_edge_pair(spark, sf):
    return B.edges(spark, sf).select("query", "edge", F.least("role_a", "role_b").alias("low"), F.greatest("role_a", "role_b").alias("high"))


@query(f"""WITH {S.PORT}, m AS (SELECT *, CASE WHEN size_class = 'largest' THEN 0 ELSE 1 END AS r, CASE WHEN size_class = 'largest' THEN ordinal ELSE -ordinal END AS o FROM port WHERE kind = 'face' AND geometry_type = 'plane'),
  b AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY r, o, ordinal) AS t FROM m)
  SELECT s.step, b.ordinal, CASE WHEN b.r = 0 THEN 'exact' WHEN b.r = 1 THEN 'type' ELSE 'missing' END AS status FROM (SELECT DISTINCT step FROM port) s LEFT JOIN b ON b.step = s.step AND b.t = 1""")
def w02_select_port(spark, sf):
    return O.selected_port(B.ports(spark, sf), "face", "plane", "largest")


@query(f"WITH {S.REQ} SELECT query, edge, side, candidate, n > 0 AS mask FROM counts")
def j01_port_candidate_mask(spark, sf):
    return _counts(spark, sf).select("query", "edge", "side", "candidate", (F.col("n") > 0).alias("mask"))


def _candidates(spark, sf):
    return written(B.candidates(spark, sf), "candidates")


def _counts(spark, sf, cands=None):
    cands = _candidates(spark, sf) if cands is None else cands
    counted = written(O.contract_counts(B.ports(spark, sf)), "contracts")
    first = counted.select("step", F.lit(0).alias("ordinal"), F.col("stated").alias("contract"))
    return O.match_counts(cands, B.endpoints(spark, sf, first, cands), counted)


def _ready(spark, sf, cands=None):
    """The candidates that may stand at their roles, once worked out for all that a query does with them."""
    cands = _candidates(spark, sf) if cands is None else cands
    return written(A.endpoint_costs(cands, _counts(spark, sf, cands)), "ready")


def _assignments(spark, sf):
    return A.feasible_assignments(_ready(spark, sf))


def _best(spark, sf, cands=None):
    return A.best_assignments(_ready(spark, sf, cands))


@query(f"WITH {S.REQ}, a AS (SELECT DISTINCT step FROM prim) SELECT c.query, c.role, c.candidate, a.step IS NOT NULL AS available FROM cand c LEFT JOIN a ON a.step = c.candidate")
def j02_graph_mask(spark, sf):
    has = B.primitives(spark, sf).select(F.col("step").alias("candidate")).distinct().withColumn("has", F.lit(True))
    return B.candidates(spark, sf).join(has, "candidate", "left").select("query", "role", "candidate", F.col("has").isNotNull().alias("available"))


@query(f"WITH {S.REQ} SELECT query, edge, side, count(*) FILTER (WHERE n > 0) AS compatible, count(*) AS candidates, CAST(sum(n) AS BIGINT) AS matches FROM counts GROUP BY ALL")
def j04_symbolic_state(spark, sf):
    counts = _counts(spark, sf)
    total = counts.groupBy("query", "edge", "side").agg(F.sum("n").alias("matches"))
    return O.compatible_counts(counts).join(total, ["query", "edge", "side"])


@query(f"WITH {S.ASSIGN} SELECT query, identity, round(score, 6) + 0.0 AS score FROM assigned")
def j05_feasible_assignments(spark, sf):
    return _assignments(spark, sf).select("query", "identity", (F.round("score", 6) + 0.0).alias("score"))


_PICKED = """picked AS (SELECT query, rank, score, unnest([0, 1, 2, 3, 4]) AS pos, unnest([p0, p1, p2, p3, p4]) AS candidate FROM {0} WHERE rank < 25)"""


@query(f"""WITH {S.ASSIGN}, {_PICKED.format('ranking')}, q AS (SELECT DISTINCT query FROM cand),
  p AS (SELECT p.query, p.rank, p.score, p.pos, p.candidate, r.role FROM picked p JOIN role r ON r.query = p.query AND r.pos = p.pos)
  SELECT q.query, CASE WHEN p.rank IS NULL THEN 'no_candidate' ELSE 'predicted' END AS status, CAST(p.rank AS INTEGER) AS rank, p.pos, p.role, p.candidate, round(p.score, 6) + 0.0 AS score FROM q LEFT JOIN p ON p.query = q.query""")
def j06_symbolic_predictions(spark, sf):
    cands = _candidates(spark, sf)
    out = A.predictions(cands, A.ranked(_best(spark, sf, cands)))
    return out.withColumn("score", F.col("score") + 0.0)


@query(f"""WITH {S.ASSIGN} SELECT 'minimum_port_ambiguity' AS policy, query, CAST(rank AS INTEGER) AS rank, identity FROM ranking WHERE rank < 25
  UNION ALL SELECT 'deterministic_hash', query, CAST(rank AS INTEGER), identity FROM ranking_h WHERE rank < 25""")
def w09_rank_policies(spark, sf):
    ready = _ready(spark, sf)
    found = {"minimum_port_ambiguity": A.best_assignments(ready), "deterministic_hash": A.feasible_assignments(ready)}
    parts = [A.ranked(df, p).select(F.lit(p).alias("policy"), "query", "rank", "identity") for p, df in found.items()]
    return parts[0].unionByName(parts[1])


@query(f"""WITH {S.ASSIGN}, {_PICKED.format('ranking')}, seen AS (SELECT query, pos, candidate, min(rank) AS seen FROM picked WHERE candidate IS NOT NULL GROUP BY ALL)
  SELECT c.query, c.role, c.candidate, CAST(row_number() OVER (PARTITION BY c.query, c.role ORDER BY s.seen IS NULL, s.seen, c.candidate) - 1 AS INTEGER) AS place
  FROM cand c LEFT JOIN seen s ON s.query = c.query AND s.pos = c.pos AND s.candidate = c.candidate""")
def w10_role_rankings_from_beam(spark, sf):
    cands = _candidates(spark, sf)
    return R.role_rankings(cands, A.ranked(_best(spark, sf, cands))).drop("pos")


_PLACED = "place AS (SELECT query, pos, candidate, row_number() OVER (PARTITION BY query, role ORDER BY volume DESC, candidate) - 1 AS place FROM cand)"


def _by_volume(spark, sf):
    order = Window.partitionBy("query", "role").orderBy(F.desc("volume"), "candidate")
    return B.candidates(spark, sf).withColumn("place", F.row_number().over(order) - 1)


@query(f"""WITH {S.ASSIGN}, {_PLACED}, long_ AS (SELECT query, identity, unnest([0, 1, 2, 3, 4]) AS pos, unnest([p0, p1, p2, p3, p4]) AS candidate FROM assigned),
  scored AS (SELECT l.query, l.identity, CAST(-sum(p.place) AS DOUBLE) AS score FROM long_ l JOIN place p ON p.query = l.query AND p.pos = l.pos AND p.candidate = l.candidate GROUP BY ALL),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, identity) - 1 AS INTEGER) AS rank FROM scored)
  SELECT query, rank, identity, score + 0.0 AS score FROM r WHERE rank < 25""")
def j07_external_rank_predictions(spark, sf):
    scored = A.best_assignments(R.place_costs(_ready(spark, sf), _by_volume(spark, sf)))
    return A.ranked(scored).select("query", "rank", "identity", (F.col("score") + 0.0).alias("score"))


@query(f"""WITH {S.ASSIGN}, sizes AS (SELECT query, product(n) AS raw FROM (SELECT query, role, count(*) AS n FROM cand GROUP BY ALL) x GROUP BY query),
  f AS (SELECT query, count(*) AS feasible FROM assigned GROUP BY query), e AS (SELECT s.query, s.raw, CAST(coalesce(f.feasible, 0) AS DOUBLE) AS feasible FROM sizes s LEFT JOIN f ON f.query = s.query)
  SELECT count(*) AS queries, count(*) FILTER (WHERE feasible = 0) AS zero, count(*) FILTER (WHERE feasible = 1) AS "unique", count(*) FILTER (WHERE feasible > 1) AS ambiguous,
    round(avg(raw), 6) AS raw_mean, median(raw) AS raw_median, quantile_disc(raw, 0.9) AS raw_p90, max(raw) AS raw_max,
    round(avg(feasible), 6) AS feasible_mean, median(feasible) AS feasible_median, quantile_disc(feasible, 0.9) AS feasible_p90, max(feasible) AS feasible_max FROM e""")
def j09_ambiguity_audit(spark, sf):
    cands = _candidates(spark, sf)
    return A.ambiguity_audit(cands, _ready(spark, sf, cands))


@query(f"""WITH {S.CAND}, r AS (SELECT query, role, candidate FROM cand WHERE candidate % 7 <> 0 UNION ALL SELECT query, role, candidate FROM cand WHERE candidate % 11 = 0 UNION ALL SELECT query, role, -candidate FROM cand WHERE candidate % 13 = 0),
  n AS (SELECT query, role, candidate, count(*) AS n FROM r GROUP BY ALL),
  b AS (SELECT coalesce(c.query, n.query) AS query, c.candidate AS known, n.n FROM cand c FULL OUTER JOIN n ON n.query = c.query AND n.role = c.role AND n.candidate = c.candidate)
  SELECT query, count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE known IS NULL) AS extra, count(*) FILTER (WHERE n > 1) AS repeated,
    count(*) FILTER (WHERE n IS NULL OR known IS NULL OR n > 1) = 0 AS valid FROM b GROUP BY query""")
def j10_validate_rankings(spark, sf):
    c = B.candidates(spark, sf).select("query", "role", "candidate")
    planted = c.where("candidate % 7 <> 0").unionByName(c.where("candidate % 11 = 0")).unionByName(c.where("candidate % 13 = 0").withColumn("candidate", -F.col("candidate")))
    return R.permutation_status(c, planted)


@query(f"""WITH {S.CAND} SELECT query, role, candidate, round((ln(1 + volume) - avg(ln(1 + volume)) OVER w) / greatest(stddev_pop(ln(1 + volume)) OVER w, 1e-6), 6) + 0.0 AS z FROM cand WINDOW w AS (PARTITION BY query, role)""")
def w03_candidate_zscore(spark, sf):
    return R.zscores(B.candidates(spark, sf), "volume").select("query", "role", "candidate", (F.round("z", 6) + 0.0).alias("z"))


@query(f"""WITH {S.CAND}, p AS (SELECT query, role, candidate, CAST(row_number() OVER (PARTITION BY query, role ORDER BY candidate) - 1 AS INTEGER) AS slot FROM cand),
  m AS (SELECT query, max(slot) AS last FROM p GROUP BY query), s AS (SELECT r.query, r.role, CAST(unnest(range(0, m.last + 1)) AS INTEGER) AS slot FROM role r JOIN m ON m.query = r.query)
  SELECT s.query, s.role, s.slot, p.candidate, p.candidate IS NOT NULL AS mask FROM s LEFT JOIN p ON p.query = s.query AND p.role = s.role AND p.slot = s.slot""")
def w04_pad_candidates(spark, sf):
    return R.padded(B.candidates(spark, sf))


@query(f"WITH {S.CAND}, f AS (SELECT DISTINCT query FROM cand ORDER BY query LIMIT 100) SELECT query, role, candidate FROM cand WHERE query IN (SELECT query FROM f)")
def w15_query_limit(spark, sf):
    return R.first_queries(B.candidates(spark, sf), 100).select("query", "role", "candidate")


@query(f"WITH {S.PORT} SELECT step, geometry_type, kind, count(*) AS n, CAST(sum(members) AS BIGINT) AS members FROM port GROUP BY ALL")
def g10_candidate_summary(spark, sf):
    return B.ports(spark, sf).groupBy("step", "geometry_type", "kind").agg(F.count("*").alias("n"), F.sum("members").alias("members"))


@query(f"""WITH {S.ASSIGN}, q AS (SELECT DISTINCT query FROM cand) SELECT CASE WHEN a.query IS NULL THEN 'no_candidate' ELSE 'predicted' END AS status, count(*) AS n
  FROM q LEFT JOIN (SELECT DISTINCT query FROM assigned) a ON a.query = q.query GROUP BY 1""")
def g11_status_counts(spark, sf):
    cands = _candidates(spark, sf)
    found = A.feasible_counts(cands, _ready(spark, sf, cands))
    return found.groupBy(F.when(F.col("feasible") > 0, "predicted").otherwise("no_candidate").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, quantile_disc(CAST(o_totalprice AS DOUBLE), 0.5) AS p50, quantile_disc(CAST(o_totalprice AS DOUBLE), 0.9) AS p90, quantile_disc(CAST(o_totalprice AS DOUBLE), 0.99) AS p99 FROM orders GROUP BY 1")
def g12_nearest_rank_quantile(spark, sf):
    rows = B.table(spark, sf, "orders").select("o_orderstatus", F.col("o_totalprice").cast("double").alias("price"))
    return quantiles(rows, ["o_orderstatus"], "price", {"p50": 0.5, "p90": 0.9, "p99": 0.99})


@query("SELECT event_type, round(quantile_cont(CAST(value AS DOUBLE), 0.5), 6) AS p50, round(quantile_cont(CAST(value AS DOUBLE), 0.95), 6) AS p95, max(CAST(value AS DOUBLE)) AS max FROM events GROUP BY 1")
def g13_linear_percentile(spark, sf):
    rows = B.table(spark, sf, "events").select("event_type", F.col("value").cast("double").alias("value"))
    found = quantiles(rows, ["event_type"], "value", {"p50": 0.5, "p95": 0.95}, linear=True)
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95")).join(rows.groupBy("event_type").agg(F.max("value").alias("max")), "event_type")
