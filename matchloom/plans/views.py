"""Queries on graph views, samples, two-pass protocols, metrics and published files."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import text as X
from matchloom.operators import decoding as D
from matchloom.operators import geometry as Y
from matchloom.operators import graphs as G
from matchloom.operators import requests as R
from matchloom.sources import records
from matchloom.sources.tables import written

from . import bindings as B
from . import sql as S
from .geometry import _E, _vectors
from .registry import query
from .scoring import _beam_sql, _joined_pairs, _targets, _unary


def _shared_folder(spark, name: str) -> str:
    where = written(spark.range(1), name).inputFiles()[0]  # a table of one row shows where the shared folder is
    return f"{where.rsplit('/', 2)[0]}/{name}-{uuid.uuid4().hex}"


def _graph(spark, sf):
    """Primitives as faces, with what an intrinsic graph needs; every ninth has no curvature."""
    known = (F.col("step") + F.col("ordinal")) % 9 > 0
    faces = B.primitives(spark, sf).select(
        F.col("step").alias("part"), F.col("ordinal").alias("face"), F.col("size").alias("area"), F.col("radius").alias("perimeter"),
        F.when(known, F.try_divide(F.lit(1.0), "radius")).alias("mean_curvature"), F.when(known, F.lit(0.25)).alias("gaussian_curvature"), F.col("members").alias("wires"), (F.col("members") + 1).alias("edges"),
    )
    edges = B.adjacency(spark, sf).select(F.col("step").alias("part"), "a", "b", (F.col("a") + 1.0).alias("length"), (F.col("feature") * 2.0 - 0.5).alias("cosine"))
    return faces, edges


@query(f"""WITH {S.ADJ}, t AS (SELECT step, sum(size) AS total FROM prim GROUP BY step), k AS (SELECT p.*, t.total, (p.step + p.ordinal) % 9 > 0 AS known FROM prim p JOIN t USING (step)),
  n AS (SELECT step AS part, 'node' AS what, ordinal AS a, -1 AS b, round(size / total, 8) AS x, round(radius / sqrt(total), 6) AS y, round(CASE WHEN known THEN sqrt(total) / radius END, 6) AS z FROM k),
  e AS (SELECT j.step AS part, 'edge' AS what, least(a, b) AS a, greatest(a, b) AS b, round((a + 1.0) / sqrt(total), 8) AS x, CAST(least(1.0, feature * 2.0 - 0.5) AS DOUBLE) AS y, round(sqrt(greatest(0.0, 1 - least(1.0, feature * 2.0 - 0.5) ** 2)), 6) AS z FROM adj j JOIN t USING (step))
  SELECT * FROM n UNION ALL SELECT * FROM e""")
def g06_intrinsic_graph(spark, sf):
    nodes, edges = G.intrinsic_graph(*_graph(spark, sf))
    up = lambda c, n: F.round(c, n)
    a = nodes.select("part", F.lit("node").alias("what"), F.col("face").alias("a"), F.lit(-1).alias("b"), up("area_fraction", 8).alias("x"), up("perimeter", 6).alias("y"), up("mean_curvature", 6).alias("z"))
    return a.unionByName(edges.select("part", F.lit("edge").alias("what"), F.col("source").alias("a"), F.col("target").alias("b"), up("length", 8).alias("x"), F.col("cosine").alias("y"), up("sine", 6).alias("z")))


def _order_sql(rounds: int) -> str:
    key = "kind, geometry_type, members"
    out = [f"c0 AS MATERIALIZED (SELECT step, ordinal, {key}, CAST(dense_rank() OVER (PARTITION BY step ORDER BY {key}) - 1 AS INTEGER) AS c, count(*) OVER (PARTITION BY step) AS n FROM prim)"]
    for i in range(rounds):
        out.append(f"""n{i} AS MATERIALIZED (SELECT w.step, w.a AS ordinal, list_sort(list(lpad(CAST(w.feature AS VARCHAR), 3, '0') || ':' || lpad(CAST(c.c AS VARCHAR), 6, '0'))) AS seen FROM way w JOIN c{i} c ON c.step = w.step AND c.ordinal = w.b WHERE w.a <> w.b GROUP BY w.step, w.a),
  c{i + 1} AS MATERIALIZED (SELECT c.step, c.ordinal, {key}, CAST(CASE WHEN c.n > {i} THEN dense_rank() OVER (PARTITION BY c.step ORDER BY {key}, coalesce(n.seen, [])) - 1 ELSE c.c END AS INTEGER) AS c, c.n FROM c{i} c LEFT JOIN n{i} n ON n.step = c.step AND n.ordinal = c.ordinal)""")
    return f"WITH {S.ADJ}, {', '.join(out)} SELECT step, ordinal, c AS colour, CAST(row_number() OVER (PARTITION BY step ORDER BY c, ordinal) - 1 AS INTEGER) AS place FROM c{rounds}"


@query(_order_sql(24))
def i03_canonical_face_order(spark, sf):
    return G.face_order(B.primitives(spark, sf), B.adjacency(spark, sf), ["kind", "geometry_type", "members"])


@query(f"""WITH {S.ADJ}, n AS (SELECT step, count(*) AS n FROM prim GROUP BY step), h AS (SELECT p.step, p.ordinal, CASE WHEN n.n >= 3 THEN least(ordinal, n.n - ordinal) ELSE ordinal END AS hop FROM prim p JOIN n USING (step)),
  e AS (SELECT j.step, greatest(x.hop, y.hop) AS hop, count(*) AS e FROM adj j JOIN h x ON x.step = j.step AND x.ordinal = j.a JOIN h y ON y.step = j.step AND y.ordinal = j.b GROUP BY ALL),
  s AS (SELECT h.step, h.hop, count(*) AS f, coalesce(max(e.e), 0) AS e FROM h LEFT JOIN e ON e.step = h.step AND e.hop = h.hop GROUP BY h.step, h.hop), c AS (SELECT *, sum(f) OVER w AS cf, sum(e) OVER w AS ce FROM s WINDOW w AS (PARTITION BY step ORDER BY hop)),
  d AS (SELECT *, min(CASE WHEN hop > 2 OR cf > 4 OR ce > 4 THEN hop END) OVER (PARTITION BY step) AS stop FROM c)
  SELECT step, CAST(sum(f) AS BIGINT) AS faces, CAST(sum(e) AS BIGINT) AS edges, CAST(coalesce(sum(f) FILTER (WHERE stop IS NULL OR hop < stop), 0) AS BIGINT) AS taken_faces, CAST(coalesce(sum(e) FILTER (WHERE stop IS NULL OR hop < stop), 0) AS BIGINT) AS taken_edges,
    CAST(max(hop) FILTER (WHERE stop IS NULL OR hop < stop) AS INTEGER) AS radius, CASE WHEN max(stop) IS NULL THEN 'none' WHEN max(stop) > 2 THEN 'max_hop_radius' ELSE 'face_or_edge_budget' END AS reason FROM d GROUP BY step""")
def i04_endpoint_shells(spark, sf):
    first = B.primitives(spark, sf).where("ordinal = 0").select("step", "ordinal")
    return G.endpoint_shells(B.adjacency(spark, sf), first, most_hops=2, most_faces=4, most_edges=4).select("step", "faces", "edges", "taken_faces", "taken_edges", "radius", "reason")


@query(f"""WITH {S.ADJ}, n AS (SELECT step, count(*) AS nodes, string_agg(kind || ':' || geometry_type, ',' ORDER BY ordinal) AS t FROM prim GROUP BY step), e AS (SELECT step, count(*) AS edges, string_agg(least(a, b) || '-' || greatest(a, b) || '-' || feature, ',' ORDER BY least(a, b), greatest(a, b), feature) AS t FROM adj GROUP BY step)
  SELECT n.step, n.nodes, coalesce(e.edges, 0) AS edges, sha256(n.t || '|' || coalesce(e.t, '')) AS view, true AS rebuilt FROM n LEFT JOIN e USING (step)""")
def v11_model_view(spark, sf):
    """A view is the same when it is built again from edges with their ends swapped."""
    nodes, edges, signature = B.primitives(spark, sf), B.adjacency(spark, sf), F.concat_ws(":", "kind", "geometry_type")
    again = G.model_views(nodes, edges.select("step", F.col("b").alias("a"), F.col("a").alias("b"), "feature"), signature)
    return G.model_views(nodes, edges, signature).join(again.select("step", F.col("view").alias("other")), "step").select("step", "nodes", "edges", "view", (F.col("view") == F.col("other")).alias("rebuilt"))


_U = "CAST(('0x' || substr(sha256('s1:' || p.part || ':' || i.sample || ':{0}'), 1, 8)) AS BIGINT) / 4294967296.0"
_CROSS = "[(y[2] - x[2]) * (z[3] - x[3]) - (y[3] - x[3]) * (z[2] - x[2]), (y[3] - x[3]) * (z[1] - x[1]) - (y[1] - x[1]) * (z[3] - x[3]), (y[1] - x[1]) * (z[2] - x[2]) - (y[2] - x[2]) * (z[1] - x[1])]"


@query(f"""WITH {_E}, t AS (SELECT label * 1000000 + vec_id // 500 AS part, vec_id AS idx, e[1:3] AS x, e[4:6] AS y, e[7:9] AS z FROM v), a AS (SELECT *, {_CROSS} AS n FROM t), b AS (SELECT *, 0.5 * sqrt(n[1] ** 2 + n[2] ** 2 + n[3] ** 2) AS area FROM a),
  c AS (SELECT *, sum(area) OVER (PARTITION BY part ORDER BY idx) AS stop FROM b), d AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY part ORDER BY idx), 0) AS start FROM c), p AS (SELECT part, max(stop) AS total FROM d GROUP BY part),
  w AS (SELECT p.part, i.sample, {_U.format('t')} * p.total AS at, sqrt({_U.format('u')}) AS u, {_U.format('v')} AS r FROM p, (SELECT unnest(range(0, 40)) AS sample) i)
  SELECT w.part, CAST(w.sample AS INTEGER) AS sample, d.idx, round((1 - u) * x[1] + u * (1 - r) * y[1] + u * r * z[1], 5) + 0.0 AS px FROM w JOIN d ON d.part = w.part AND w.at >= d.start AND w.at < d.stop""")
def w16_surface_samples(spark, sf):
    triangles = _vectors(spark, sf).select((F.col("label") * 1_000_000 + F.floor(F.col("vec_id") / 500)).alias("part"), F.col("vec_id").alias("idx"), *[F.slice("e", 3 * i + 1, 3).alias(f"v{i}") for i in range(3)])
    return Y.surface_samples(triangles, 40, "s1").select("part", "sample", "idx", (F.round(F.col("point")[0], 5) + 0.0).alias("px"))


@query(f"""WITH {S.CAND}, o AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY edge DESC) - 1 AS place, (query + edge) % 4 AS k FROM edge WHERE query % 9 <> 0)
  SELECT query, 'edge_' || lpad(CAST(place AS VARCHAR), 2, '0') AS edge_id, role_a, role_b, CASE WHEN k = 0 THEN 'Join ' || role_a || ' and ' || role_b || ' as one rigid connection.' ELSE 'parsed ' || edge END AS instruction, CASE WHEN k = 0 THEN 'missing' ELSE 'parsed' END AS parse,
    CASE WHEN k > 0 THEN 'port of ' || role_a END AS port_a, CASE WHEN k > 0 THEN 'revolute' ELSE 'fixed' END AS mobility, 'compiled' AS status FROM o
  UNION ALL SELECT DISTINCT query, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'error' FROM edge WHERE query % 9 = 0""")
def r12_two_pass_protocol(spark, sf):
    """The request names its edges from the last to the first; every other parse has its roles the other way round, every fourth edge has none."""
    edges = B.edges(spark, sf)
    clause = F.concat(F.lit("Join "), "role_a", F.lit(" and "), "role_b", F.lit(" as one rigid connection."))
    ordered = F.reverse(F.array_sort(F.collect_list(F.struct("edge", clause.alias("c")))))
    requests = edges.groupBy("query").agg(F.array_join(F.transform(ordered, lambda x: x["c"]), " ").alias("text"))
    graph = edges.where("query % 9 <> 0").select("query", "role_a", "role_b", F.lit("fixed").alias("mobility"))
    swap = F.col("edge") % 2 == 1
    a, b = F.when(swap, F.col("role_b")).otherwise(F.col("role_a")), F.when(swap, F.col("role_a")).otherwise(F.col("role_b"))
    port = lambda r: F.concat(F.lit("port of "), r)
    parsed = edges.where("(query + edge) % 4 > 0").select("query", a.alias("role_a"), b.alias("role_b"), F.lit("specified").alias("contract_status"), port(a).alias("port_a"), port(b).alias("port_b"), F.lit("revolute").alias("mobility"), F.concat(F.lit("parsed "), "edge").alias("instruction"))
    return R.two_pass(requests, graph, parsed, X.sentences(F.col("text"))).select("query", "edge_id", "role_a", "role_b", "instruction", "parse", "port_a", "mobility", "status")


_BEAM = _beam_sql()


@query(f"""WITH b AS ({_BEAM}), {S.CAND.strip()}, g AS (SELECT query, pos, max(candidate) AS c, max(n_roles) AS n FROM cand GROUP BY query, pos), w AS (SELECT query, list(c ORDER BY pos) AS goal FROM g GROUP BY query),
  p AS (SELECT query, [CAST(x AS BIGINT) FOR x IN string_split(picks, ',')] AS picks, row_number() OVER (PARTITION BY query ORDER BY score DESC, [CAST(x AS BIGINT) FOR x IN string_split(picks, ',')]) - 1 AS rank FROM b),
  r AS (SELECT w.query, w.goal, p.picks FROM w LEFT JOIN p ON p.query = w.query AND p.rank = 0), h AS (SELECT DISTINCT w.query FROM w JOIN p ON p.query = w.query AND p.picks = w.goal),
  q AS (SELECT query, coalesce(len([i FOR i IN range(1, len(goal) + 1) IF picks[i] = goal[i]]) / len(goal), 0.0) AS r, coalesce(CAST(picks = goal AS DOUBLE), 0.0) AS p, CAST(query IN (SELECT query FROM h) AS DOUBLE) AS h FROM r)
  SELECT count(*) AS queries, round(avg(r), 6) AS role_accuracy, round(avg(p), 6) AS program_accuracy, round(avg(h), 6) AS recall,
    (SELECT round(avg(coalesce(CAST(r.picks[e.pos_a + 1] = r.goal[e.pos_a + 1] AND r.picks[e.pos_b + 1] = r.goal[e.pos_b + 1] AS DOUBLE), 0.0)), 6) FROM edge e JOIN r ON r.query = e.query) AS edge_accuracy FROM q""")
def e01_linker_metrics(spark, sf):
    order = Window.partitionBy("query").orderBy(F.desc("score"), "picks")
    beams = D.beam_decode(_unary(spark, sf), _joined_pairs(spark, sf)).withColumn("rank", F.row_number().over(order) - 1)
    out = D.linker_metrics(written(beams.select("query", "rank", "picks"), "beams"), _targets(spark, sf), B.edges(spark, sf))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in ("role_accuracy", "program_accuracy", "recall", "edge_accuracy")])


_LINE = """'{"doc_id":' || l.doc_id || ',"quality":' || l.quality || ',"sha":"' || sha256(coalesce(d.text, '')) || '","toxic":' || l.toxic || '}'"""


@query(f"""WITH j AS (SELECT {_LINE} AS line FROM labels l JOIN documents d ON d.doc_id = l.doc_id), h AS (SELECT sha256(line) AS h FROM j), b AS (SELECT substr(h, 1, 3) AS b, count(*) AS n, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
  SELECT CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(h, '' ORDER BY b)) AS sha256, 'doc_id,quality,sha,toxic' AS columns FROM b""")
def s09_jsonl_with_manifest(spark, sf):
    docs = B.table(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return records.write_json_lines(B.table(spark, sf, "labels").select("doc_id", "quality", "toxic").join(docs, "doc_id"), _shared_folder(spark, "json-lines"))
