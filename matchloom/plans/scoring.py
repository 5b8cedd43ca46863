"""Queries on score tables and request graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions.ports import MOBILITIES
from matchloom.operators import decoding as D
from matchloom.operators import requests as R
from matchloom.sources.tables import shuffled

from . import bindings as B
from . import sql as S
from .registry import query

_HASH = "CAST(('0x' || substr(sha256({}), 1, 5)) AS BIGINT)"


def _micro(*parts):
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 5), 16, 10).cast("long")


def _unary(spark, sf, cands=None):
    """cands: the candidates, where they are at hand; so below."""
    return (B.candidates(spark, sf) if cands is None else cands).select("query", "pos", "n_roles", "candidate", _micro("query", "role", "candidate").alias("score"))


def _scored_pairs(spark, sf, cands=None):
    c = B.candidates(spark, sf) if cands is None else cands
    a = c.select("query", (F.col("pos") + 1).alias("pos"), F.col("candidate").alias("a"))
    b = c.select("query", "pos", F.col("candidate").alias("b"))
    return shuffled(a).join(b, ["query", "pos"]).select("query", "pos", "a", "b", _micro("query", "pos", "a", "b").alias("score"))


def _joined_pairs(spark, sf, cands=None, near=None):
    """Pairs of all edges (query, edge, pos_a, pos_b, a, b, score): the neighbours', and those of the first and last role."""
    near = _scored_pairs(spark, sf, cands) if near is None else near
    near = near.select("query", F.col("pos").alias("edge"), (F.col("pos") - 1).alias("pos_a"), F.col("pos").alias("pos_b"), "a", "b", "score")
    c = B.candidates(spark, sf) if cands is None else cands
    first = c.where("pos = 0").select("query", F.col("candidate").alias("a"))
    last = c.where("pos = n_roles - 1 and pos >= 2").select("query", "pos", F.col("candidate").alias("b"))
    ring = last.join(first, "query").select("query", F.lit(0).alias("edge"), F.col("pos").alias("pos_a"), F.lit(0).alias("pos_b"), F.col("b").alias("a"), F.col("a").alias("b"), _micro("query", F.lit(0), "a", "b").alias("score"))
    return near.unionByName(ring)


def _targets(spark, sf, cands=None):
    return (B.candidates(spark, sf) if cands is None else cands).groupBy("query", "pos").agg(F.max("candidate").alias("candidate"))


_SCORES = S.CAND + f""",
unary AS (SELECT query, pos, n_roles, candidate, {_HASH.format("query || ':' || role || ':' || candidate")} AS score FROM cand),
pair AS (SELECT b.query, b.pos, a.candidate AS a, b.candidate AS b, {_HASH.format("b.query || ':' || b.pos || ':' || a.candidate || ':' || b.candidate")} AS score FROM cand a JOIN cand b ON a.query = b.query AND b.pos = a.pos + 1),
ring AS (SELECT b.query, a.candidate AS a, b.candidate AS b, {_HASH.format("b.query || ':0:' || a.candidate || ':' || b.candidate")} AS score FROM cand a JOIN cand b ON a.query = b.query AND a.pos = 0 AND b.pos = b.n_roles - 1 AND b.pos >= 2),
target AS (SELECT query, pos, max(candidate) AS candidate FROM cand GROUP BY query, pos)"""


def _beam_sql() -> str:
    out = ["s0 AS (SELECT * FROM (SELECT query, n_roles, [candidate] AS picks, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, candidate) AS t FROM unary WHERE pos = 0) x WHERE t <= 25)"]
    for i in range(1, 5):
        both = "s.score + u.score + p.score + coalesce(r.score, 0)"
        out.append(f"""s{i} AS (SELECT * FROM (SELECT s.query, s.n_roles, list_append(s.picks, p.b) AS picks, {both} AS score, row_number() OVER (PARTITION BY s.query ORDER BY {both} DESC, list_append(s.picks, p.b)) AS t
  FROM s{i - 1} s JOIN pair p ON p.query = s.query AND p.pos = {i} AND p.a = s.picks[{i}] JOIN unary u ON u.query = s.query AND u.pos = {i} AND u.candidate = p.b
  LEFT JOIN ring r ON r.query = s.query AND s.n_roles = {i + 1} AND r.a = s.picks[1] AND r.b = p.b WHERE s.n_roles > {i}) x WHERE t <= 25)""")
    union = " UNION ALL ".join(f"SELECT query, array_to_string(picks, ',') AS picks, score FROM s{i} WHERE n_roles = {i + 1}" for i in range(1, 5))
    return f"WITH {_SCORES}, {', '.join(out)} {union}"


@query(_beam_sql())
def i09_beam_decode(spark, sf):
    return D.beam_decode(_unary(spark, sf), _joined_pairs(spark, sf)).select("query", F.array_join(F.transform("picks", lambda x: x.cast("string")), ",").alias("picks"), "score")


@query(f"WITH {_SCORES} SELECT query, pos, a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY query, pos ORDER BY score DESC, a, b) AS t FROM pair) x WHERE t = 1")
def w06_best_pair(spark, sf):
    return D.best_pairs(_scored_pairs(spark, sf))


@query(f"""WITH {_SCORES}, best AS (SELECT query, pos, a, b FROM (SELECT *, row_number() OVER (PARTITION BY query, pos ORDER BY score DESC, a, b) AS t FROM pair) x WHERE t = 1),
  r AS (SELECT query, pos - 1 AS role, a AS candidate FROM best UNION ALL SELECT query, pos, b FROM best), n AS (SELECT query, role, count(DISTINCT candidate) AS n FROM r GROUP BY ALL)
  SELECT n.query, (SELECT count(*) FROM best b WHERE b.query = n.query) AS edges, max(n.n) = 1 AS consistent FROM n GROUP BY n.query""")
def i11_independent_edge_choice(spark, sf):
    return D.edge_choice(_scored_pairs(spark, sf))


@query(f"""WITH {_SCORES}, f AS (SELECT *, row_number() OVER (PARTITION BY query, pos ORDER BY score DESC, a, b) - 1 AS rank FROM pair WHERE (a + b) % 3 > 0 AND query % 8 > 0), e AS (SELECT DISTINCT query, pos FROM pair)
  SELECT e.query, e.pos, coalesce(f.a, -1) AS a, coalesce(f.b, -1) AS b, CAST(coalesce(f.rank, 0) AS INTEGER) AS rank FROM e LEFT JOIN f ON f.query = e.query AND f.pos = e.pos AND f.rank < 8""")
def w07_interface_alternatives(spark, sf):
    low = F.when(((F.col("a") + F.col("b")) % 3 > 0) & (F.col("query") % 8 > 0), F.col("score").cast("double")).otherwise(float("-inf"))
    return D.top_alternatives(_scored_pairs(spark, sf).withColumn("value", low), 8)


@query(f"WITH {_SCORES} SELECT query, pos, count(*) AS pairs, count(*) FILTER (WHERE a % 5 > 0 AND b % 7 > 0) AS finite FROM pair GROUP BY ALL")
def j03_pair_mask(spark, sf):
    value = F.when((F.col("a") % 5 > 0) & (F.col("b") % 7 > 0), F.col("score").cast("double")).otherwise(float("-inf"))
    return _scored_pairs(spark, sf).groupBy("query", "pos").agg(F.count("*").alias("pairs"), F.count_if(value > float("-inf")).alias("finite"))


@query(f"WITH {_SCORES} SELECT t.query, CAST(sum(u.score) AS BIGINT) AS unary_score, CAST(coalesce(sum(p.score), 0) AS BIGINT) AS pair_score FROM target t JOIN unary u ON u.query = t.query AND u.pos = t.pos AND u.candidate = t.candidate LEFT JOIN target s ON s.query = t.query AND s.pos = t.pos - 1 LEFT JOIN pair p ON p.query = t.query AND p.pos = t.pos AND p.a = s.candidate AND p.b = t.candidate GROUP BY t.query")
def e05_assignment_score(spark, sf):
    t = _targets(spark, sf)
    one = t.join(_unary(spark, sf), ["query", "pos", "candidate"]).groupBy("query").agg(F.sum("score").alias("unary_score"))
    ends = t.select("query", (F.col("pos") + 1).alias("pos"), F.col("candidate").alias("a")).join(t.select("query", "pos", F.col("candidate").alias("b")), ["query", "pos"])
    two = ends.join(_scored_pairs(spark, sf), ["query", "pos", "a", "b"]).groupBy("query").agg(F.sum("score").alias("pair_score"))
    return one.join(two, "query", "left").select("query", "unary_score", F.coalesce("pair_score", F.lit(0)).alias("pair_score"))


@query(f"""WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY query, pos ORDER BY score DESC, candidate) AS rank FROM unary)
  SELECT t.pos, count(*) AS targets, count(*) FILTER (WHERE r.rank = 1) AS top_1, count(*) FILTER (WHERE r.rank <= 3) AS top_3 FROM target t JOIN r ON r.query = t.query AND r.pos = t.pos AND r.candidate = t.candidate GROUP BY t.pos""")
def e02_proposer_coverage(spark, sf):
    ranks = D.target_ranks(_unary(spark, sf), _targets(spark, sf))
    return ranks.groupBy("pos").agg(F.count("*").alias("targets"), F.count_if(F.col("rank") == 1).alias("top_1"), F.count_if(F.col("rank") <= 3).alias("top_3"))


@query(f"""WITH {_SCORES}, o AS (SELECT u.*, row_number() OVER (PARTITION BY u.query, u.pos ORDER BY u.score DESC, u.candidate) AS t FROM unary u JOIN target g ON g.query = u.query AND g.pos = u.pos WHERE u.candidate <> g.candidate)
  SELECT o.query, o.pos, o.candidate, o.score - u.score AS gap FROM o JOIN target g ON g.query = o.query AND g.pos = o.pos JOIN unary u ON u.query = g.query AND u.pos = g.pos AND u.candidate = g.candidate WHERE o.t = 1""")
def e04_hard_negatives(spark, sf):
    return D.hard_negatives(_unary(spark, sf), _targets(spark, sf))


_ROLES = "r AS (SELECT query, CASE WHEN query % 9 = 0 AND pos = 0 THEN '  ' WHEN query % 7 = 0 AND pos = 1 THEN ' ' || lag(role) OVER (PARTITION BY query ORDER BY pos) ELSE role END AS role FROM role)"


@query(f"""WITH {S.CAND}, {_ROLES} SELECT query, count(*) AS roles, CASE WHEN count(*) FILTER (WHERE trim(role) = '') > 0 THEN 'empty_role' WHEN count(DISTINCT trim(role)) < count(*) THEN 'duplicate_role' WHEN count(*) < 2 THEN 'too_few' ELSE 'ok' END AS status FROM r GROUP BY query""")
def r01_role_rows(spark, sf):
    from pyspark.sql import Window

    roles = B.candidates(spark, sf).select("query", "pos", "role").distinct()
    before = F.lag("role").over(Window.partitionBy("query").orderBy("pos"))
    planted = F.when((F.col("query") % 9 == 0) & (F.col("pos") == 0), "  ").when((F.col("query") % 7 == 0) & (F.col("pos") == 1), F.concat(F.lit(" "), before)).otherwise(F.col("role"))
    return R.role_status(roles.select("query", planted.alias("role")))


@query(f"""WITH {S.CAND} SELECT query, CASE WHEN query % 6 = 0 THEN false WHEN query % 6 = 1 THEN max(n_roles) > 2 ELSE true END AS connected FROM role GROUP BY query""")
def i01_graph_connected(spark, sf):
    """Some queries lack their first edge; some of these the one that closes the ring as well."""
    roles = B.candidates(spark, sf).select("query", "role").distinct()
    edges = B.edges(spark, sf).where("query % 6 > 1 or edge <> 0").where("query % 6 <> 0 or pos_b = pos_a + 1")
    return R.connected(roles, edges.select("query", "edge", "role_a", "role_b"))


@query(f"""WITH {S.CAND} SELECT query, string_agg('Join ' || role_a || ' and ' || role_b || ' as one rigid connection.', ' ' ORDER BY edge) AS text, count(*) AS edges, count(*) AS pairs, true AS "unique" FROM edge GROUP BY query""")
def r03_graph_benchmark(spark, sf):
    text = F.concat(F.lit("Join "), "role_a", F.lit(" and "), "role_b", F.lit(" as one rigid connection."))
    rows = B.edges(spark, sf).select("query", "edge", text.alias("instruction"), F.least("role_a", "role_b").alias("lo"), F.greatest("role_a", "role_b").alias("hi"))
    return R.whole_requests(rows)


_EDGE = "w AS (SELECT query, least(role_a, role_b) AS lo, greatest(role_a, role_b) AS hi, (query + edge) % 3 AS value FROM edge), g AS (SELECT query, lo, CASE WHEN query % 4 = 0 THEN hi || '!' ELSE hi END AS hi, CASE WHEN query % 5 = 0 THEN value + 1 ELSE value END AS value FROM w WHERE query % 9 <> 0)"


def _edge_values(spark, sf):
    want = B.edges(spark, sf).select("query", F.least("role_a", "role_b").alias("lo"), F.greatest("role_a", "role_b").alias("hi"), ((F.col("query") + F.col("edge")) % 3).alias("value"))
    got = want.where("query % 9 <> 0").select("query", "lo", F.when(F.col("query") % 4 == 0, F.concat("hi", F.lit("!"))).otherwise(F.col("hi")).alias("hi"), F.when(F.col("query") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("value"))
    return want, got


@query(f"""WITH {S.CAND}, {_EDGE}, j AS (SELECT coalesce(w.query, g.query) AS query, w.value AS w, g.value AS g FROM w FULL OUTER JOIN g ON w.query = g.query AND w.lo = g.lo AND w.hi = g.hi),
  q AS (SELECT query, count(*) FILTER (WHERE w IS NOT NULL AND g IS NOT NULL) AS s, count(w) AS wanted, count(g) AS given, count(*) FILTER (WHERE w = g) AS e FROM j GROUP BY query),
  t AS (SELECT count(*) AS queries, sum(s) / sum(given) AS p, sum(s) / sum(wanted) AS r, avg(CASE WHEN s = wanted AND given = wanted THEN 1.0 ELSE 0.0 END) AS exact, sum(e) / sum(s) AS v FROM q)
  SELECT queries, round(p, 6) AS precision, round(r, 6) AS recall, round(exact, 6) AS exact, round(v, 6) AS value_rate, round(2 * p * r / (p + r), 6) AS f1 FROM t""")
def r09_evaluate_graphs(spark, sf):
    out = R.evaluated_edges(*_edge_values(spark, sf))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "exact", "value_rate", "f1")])


@query(f"WITH {S.CAND} SELECT query, 'edge_' || lpad(CAST(edge AS VARCHAR), 2, '0') AS edge_id, CASE WHEN query % 9 = 0 THEN 'missing' ELSE 'predicted' END AS status, CASE WHEN query % 9 <> 0 THEN role_a || '-' || role_b END AS given FROM edge")
def r11_conditioned_protocol(spark, sf):
    edges = B.edges(spark, sf)
    return R.conditioned(edges, edges.where("query % 9 <> 0").select("query", "edge", F.concat_ws("-", "role_a", "role_b").alias("instruction")))


@query(f"WITH {S.CAND} SELECT query, edge, 0 AS a, 0 AS b FROM edge WHERE query % 7 <> 0")
def j11_edge_supervision(spark, sf):
    e = B.edges(spark, sf)
    sides = e.select("query", "edge", F.lit("a").alias("side"), F.lit(0).alias("target")).unionByName(
        e.select("query", "edge", F.lit("b").alias("side"), F.when(F.col("query") % 7 != 0, 0).alias("target"))
    )
    return R.edge_supervision(sides)


_NAMES = "[" + ", ".join(f"'{m}'" for m in MOBILITIES) + "]"


@query(f"""WITH {S.CAND}, m AS (SELECT query, edge, list_extract({_NAMES}, CAST((query + edge) % 7 + 1 AS BIGINT)) AS mobility FROM edge)
  SELECT DISTINCT query FROM m WHERE query NOT IN (SELECT query FROM m WHERE mobility IN ('ball', 'pin_slot'))""")
def j12_trainable_queries(spark, sf):
    m = _mobilities(spark, sf)
    return m.select("query").distinct().join(m.where(F.col("mobility").isin("ball", "pin_slot")), "query", "left_anti")


def _mobilities(spark, sf):
    names = F.array(*map(F.lit, MOBILITIES))
    return B.edges(spark, sf).select("query", "edge", F.element_at(names, ((F.col("query") + F.col("edge")) % 7 + 1).cast("int")).alias("mobility"))


@query(f"""WITH {S.CAND}, m AS (SELECT query, edge, list_extract({_NAMES}, CAST((query + edge) % 7 + 1 AS BIGINT)) AS mobility FROM edge)
  SELECT query, edge, CASE WHEN edge = 0 AND query % 2 = 0 THEN CASE WHEN mobility = 'fixed' THEN 'revolute' ELSE 'fixed' END ELSE mobility END AS mobility, edge = 0 AND query % 2 = 0 AS changed FROM m""")
def j13_counterfactual_pairs(spark, sf):
    m = _mobilities(spark, sf)
    other = m.where("edge = 0 and query % 2 = 0").withColumn("mobility", F.when(F.col("mobility") == "fixed", "revolute").otherwise("fixed"))
    return R.replaced(m, other)
