"""Queries on attributed graphs, faces, protocols and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions.text import row_hash
from matchloom.operators import assignments as A
from matchloom.operators import graphs as G
from matchloom.operators import losses as L
from matchloom.operators import ranking as R
from matchloom.operators import records as K
from matchloom.operators import requests as Q
from matchloom.operators import schedules as D
from matchloom.operators import sockets as Z
from matchloom.sources.records import catalog, load_protocol
from matchloom.sources.tables import shared_folder, shuffled, written

from . import bindings as B
from . import sql as S
from .geometry import _E, _vectors
from .matching import _best, _ready
from .registry import query
from .scoring import _SCORES, _micro, _scored_pairs, _targets, _unary

_ADJ = S.ADJ


_edges = B.adjacency


@query(f"""WITH {_ADJ}, n AS (SELECT w.step, w.a AS ordinal, count(*) AS n, count(*) FILTER (WHERE geometry_type = 'plane') AS p, count(*) FILTER (WHERE geometry_type = 'cylinder') AS c, count(*) FILTER (WHERE geometry_type = 'circle') AS r FROM way w JOIN prim q ON q.step = w.step AND q.ordinal = w.b GROUP BY ALL),
  s AS (SELECT m.step, m.ordinal, coalesce(p, 0) / greatest(coalesce(n, 0), 1) AS p, coalesce(c, 0) / greatest(coalesce(n, 0), 1) AS c, coalesce(r, 0) / greatest(coalesce(n, 0), 1) AS r FROM prim m LEFT JOIN n ON n.step = m.step AND n.ordinal = m.ordinal)
  SELECT step, ordinal, round(p, 6) AS plane, round(c, 6) AS cylinder, round(r, 6) AS circle, array_to_string(list_filter([CASE WHEN p >= 0.24 THEN 'plane' END, CASE WHEN c >= 0.24 THEN 'cylinder' END, CASE WHEN r >= 0.24 THEN 'circle' END], lambda x: x IS NOT NULL)[1:2], ',') AS adjacent FROM s""")
def g01_surface_share(spark, sf):
    out = G.neighbour_shares(B.primitives(spark, sf), _edges(spark, sf), ["plane", "cylinder", "circle"])
    return out.select("step", "ordinal", *[F.round(t, 6).alias(t) for t in ("plane", "cylinder", "circle")], F.array_join("adjacent", ",").alias("adjacent"))


@query(f"""WITH {S.PRIM}, g AS (SELECT step, kind, geometry_type, members, min(ordinal) AS first, string_agg(CAST(ordinal AS VARCHAR), ',' ORDER BY ordinal) AS list FROM prim GROUP BY ALL)
  SELECT step, CAST(row_number() OVER (PARTITION BY step ORDER BY first) - 1 AS INTEGER) AS orbit, list AS members FROM g""")
def g02_edge_orbits(spark, sf):
    out = G.orbits(B.primitives(spark, sf).withColumnRenamed("members", "size_of"), ["kind", "geometry_type", "size_of"])
    return out.select("step", "orbit", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"))


@query("SELECT l_partkey * 1000 + l_suppkey % 1000 AS edge, min(l_orderkey) AS a, max(l_orderkey) AS b FROM (SELECT DISTINCT l_partkey, l_suppkey, l_orderkey FROM lineitem) x GROUP BY l_partkey * 1000 + l_suppkey % 1000 HAVING count(DISTINCT l_orderkey) = 2")
def g03_face_adjacency(spark, sf):
    return G.two_owner_edges(B.table(spark, sf, "lineitem").select((F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("edge"), F.col("l_orderkey").alias("face")))


@query(f"""WITH {S.PRIM} SELECT step, geometry_type, round(avg(measure), 4) AS measure, round(ln(1 + count(*)), 6) AS members, count(*) FILTER (WHERE kind = 'face') AS faces, CAST(sum(members) AS BIGINT) AS parts FROM prim GROUP BY step, geometry_type""")
def g04_primitive_features(spark, sf):
    return B.primitives(spark, sf).groupBy("step", "geometry_type").agg(
        F.round(F.avg("measure"), 4).alias("measure"), F.round(F.log1p(F.count("*")), 6).alias("members"), F.count_if(F.col("kind") == "face").alias("faces"), F.sum("members").alias("parts")
    )


@query(f"""WITH {S.PRIM}, t AS (SELECT step, sqrt(sum(size)) AS scale, avg(CASE WHEN members > 1 THEN radius END) AS r FROM prim GROUP BY step) SELECT p.step, p.ordinal, round(coalesce(r / scale, p.radius / scale), 6) AS radius FROM prim p JOIN t ON t.step = p.step""")
def g05_radius_override(spark, sf):
    of_step = Window.partitionBy("step")
    scale = F.sqrt(F.sum("size").over(of_step))
    known = F.avg(F.when(F.col("members") > 1, F.col("radius"))).over(of_step)
    return B.primitives(spark, sf).select("step", "ordinal", F.round(F.coalesce(known, F.col("radius")) / scale, 6).alias("radius"))


@query(f"""WITH {S.PRIM} SELECT step, count(*) AS nodes, sha256(string_agg(kind || ':' || geometry_type || ':' || members, chr(10) ORDER BY kind || ':' || geometry_type || ':' || members)) AS commitment FROM prim GROUP BY step""")
def g07_topology_commitment(spark, sf):
    return G.commitments(B.primitives(spark, sf), F.concat_ws(":", "kind", "geometry_type", "members"))


_FACE = _E + """, face AS (SELECT label AS part, vec_id AS face, [e[1], e[2], e[3]] AS c, [abs(e[7]), abs(e[8]), abs(e[9])] AS h, abs(e[10]) AS area, CASE vec_id % 3 WHEN 0 THEN 'plane' WHEN 1 THEN 'cylinder' ELSE 'spline' END AS surface_type,
  vec_id % 11 = 0 AS helical, vec_id % 13 AS edge_count, abs(e[11]) AS radius, vec_id % 17 = 0 AS non_mating, CASE WHEN e[12] < 0 THEN -1 ELSE 1 END AS concavity, vec_id % 19 = 0 AS thread_hint FROM v)"""


def _faces(spark, sf):
    three = lambda at, f: F.array(*[f(F.col("e")[at + i]) for i in range(3)])
    kind = F.col("vec_id") % 3
    return _vectors(spark, sf).select(
        F.col("label").alias("part"), F.col("vec_id").alias("face"), three(0, lambda x: x).alias("center"), three(6, F.abs).alias("half"), F.abs(F.col("e")[9]).alias("area"),
        F.when(kind == 0, "plane").when(kind == 1, "cylinder").otherwise("spline").alias("surface_type"), (F.col("vec_id") % 11 == 0).alias("helical"), (F.col("vec_id") % 13).alias("edge_count"),
        F.abs(F.col("e")[10]).alias("radius"), (F.col("vec_id") % 17 == 0).alias("non_mating"), F.when(F.col("e")[11] < 0, -1).otherwise(1).alias("concavity"), (F.col("vec_id") % 19 == 0).alias("thread_hint"),
    )


@query(f"WITH {_FACE} SELECT part, round(count(*) + 10 * count(*) FILTER (WHERE helical) + 4 * count(*) FILTER (WHERE surface_type = 'spline') + 0.15 * max(edge_count), 6) AS score FROM face GROUP BY part")
def g08_complexity_score(spark, sf):
    return G.complexity(_faces(spark, sf)).withColumn("score", F.round("score", 6))


@query(f"WITH {_FACE} SELECT part, round(min(c[1] - h[1]), 6) AS lo0, round(max(c[3] + h[3]), 6) AS hi2, round(sum(area * c[2]) / sum(area), 6) + 0.0 AS c1, round(sqrt(greatest(max(c[1] + h[1]) - min(c[1] - h[1]), 1e-6) ** 2 + greatest(max(c[2] + h[2]) - min(c[2] - h[2]), 1e-6) ** 2 + greatest(max(c[3] + h[3]) - min(c[3] - h[3]), 1e-6) ** 2), 6) AS diagonal FROM face GROUP BY part")
def g09_model_frame(spark, sf):
    return G.frames(_faces(spark, sf)).select("part", *[(F.round(c, 6) + 0.0).alias(c) for c in ("lo0", "hi2", "c1", "diagonal")])


@query(f"WITH {_ADJ}, m AS (SELECT w.step, w.a AS ordinal, avg(q.measure) AS mean FROM way w JOIN prim q ON q.step = w.step AND q.ordinal = w.b GROUP BY ALL) SELECT p.step, p.ordinal, round(coalesce(m.mean, 0), 4) AS mean FROM prim p LEFT JOIN m ON m.step = p.step AND m.ordinal = p.ordinal")
def g14_neighbor_mean(spark, sf):
    return G.neighbour_mean(B.primitives(spark, sf), _edges(spark, sf), "measure").withColumn("mean", F.round("mean", 4))


@query(f"WITH {_E}, g AS (SELECT label AS part, vec_id % 4 AS grp, e[1] AS logit, e[2] AS value FROM v), m AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY part, grp)) AS w FROM g) SELECT part, grp AS \"group\", round(sum(w * value) / sum(w), 6) + 0.0 AS mean FROM m GROUP BY part, grp")
def g15_orbit_pool(spark, sf):
    members = _vectors(spark, sf).select(F.col("label").alias("part"), (F.col("vec_id") % 4).alias("group"), F.col("e")[0].alias("logit"), F.col("e")[1].alias("value"))
    return G.pooled(members).withColumn("mean", F.round("mean", 6) + 0.0)


@query(f"""WITH {S.CAND}, l AS (SELECT query, edge, unnest(['a', 'b']) AS side FROM edge), s AS (SELECT *, CASE WHEN query % 7 = 0 AND side = 'b' THEN 'unmapped' WHEN (query + edge) % 5 = 0 THEN 'mapped_type_differs' ELSE 'mapped_type_consistent' END AS status FROM l)
  SELECT count(DISTINCT query) AS queries, count(*) AS endpoints, count(*) // 2 AS edges, (SELECT count(*) FROM edge WHERE query % 7 <> 0) AS mapped_edges, count(*) FILTER (WHERE status = 'mapped_type_consistent') AS consistent, count(*) FILTER (WHERE status = 'mapped_type_differs') AS differs, count(*) FILTER (WHERE status = 'unmapped') AS unmapped FROM s""")
def g17_supervision_summary(spark, sf):
    sides = B.edges(spark, sf).select("query", "edge", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("side"))
    status = F.when((F.col("query") % 7 == 0) & (F.col("side") == "b"), "unmapped").when((F.col("query") + F.col("edge")) % 5 == 0, "mapped_type_differs").otherwise("mapped_type_consistent")
    out = Q.supervision_summary(sides.withColumn("status", status))
    at = lambda n: F.coalesce(F.try_element_at("statuses", F.lit(n)), F.lit(0))
    return out.select("queries", "endpoints", "edges", "mapped_edges", at("mapped_type_consistent").alias("consistent"), at("mapped_type_differs").alias("differs"), at("unmapped").alias("unmapped"))


def _refine_sql(rounds: int) -> str:
    out = ["c0 AS MATERIALIZED (SELECT step, ordinal, sha256(kind || ':' || geometry_type) AS colour FROM prim)"]
    for i in range(rounds):
        out.append(f"""n{i} AS MATERIALIZED (SELECT w.step, w.a AS ordinal, string_agg(w.feature || ':' || c.colour, ',' ORDER BY w.feature || ':' || c.colour) AS seen FROM way w JOIN c{i} c ON c.step = w.step AND c.ordinal = w.b GROUP BY w.step, w.a),
  c{i + 1} AS MATERIALIZED (SELECT c.step, c.ordinal, sha256(c.colour || '|' || coalesce(n.seen, '')) AS colour FROM c{i} c LEFT JOIN n{i} n ON n.step = c.step AND n.ordinal = c.ordinal)""")
    return f"WITH {_ADJ}, {', '.join(out)} SELECT step, ordinal, colour FROM c{rounds}"


@query(_refine_sql(3))
def i02_structural_orbits(spark, sf):
    return G.refined(B.primitives(spark, sf).withColumn("label", F.concat_ws(":", "kind", "geometry_type")), _edges(spark, sf))


_KEPT = "kept AS (SELECT * FROM (SELECT *, max(area) OVER (PARTITION BY part, surface_type) AS largest FROM face) x WHERE area >= largest * 0.2 AND (surface_type <> 'cylinder' OR radius >= 0.02) AND NOT helical AND surface_type <> 'spline' AND NOT non_mating)"


@query(f"WITH {_FACE}, {_KEPT} SELECT part, face, surface_type FROM kept")
def k01_face_filter(spark, sf):
    return G.kept_faces(_faces(spark, sf), 0.2, 0.02).select("part", "face", "surface_type")


_KIND = "CASE WHEN concavity < 0 AND (thread_hint OR helical OR (radius <= 0.1 AND edge_count >= 8)) THEN 'threaded_hole' WHEN concavity < 0 THEN 'hole' ELSE 'pin' END"


def _kind():
    return G.cylinder_kind(*map(F.col, ["concavity", "helical", "thread_hint", "radius", "edge_count"]), 0.1)


@query(f"WITH {_FACE} SELECT part, face, {_KIND} AS kind FROM face WHERE surface_type = 'cylinder'")
def k02_classify_cylinder(spark, sf):
    return _faces(spark, sf).where("surface_type = 'cylinder'").select("part", "face", _kind().alias("kind"))


@query(f"WITH {_FACE}, {_KEPT}, n AS (SELECT part, face, CASE WHEN surface_type = 'plane' THEN 'plane' ELSE {_KIND} END AS kind, round(ln(1 + area), 9) AS score FROM kept) SELECT part, face, kind || '_' || lpad(CAST(row_number() OVER (PARTITION BY part, kind ORDER BY score DESC, face) - 1 AS VARCHAR), 2, '0') AS name FROM n")
def w14_socket_names(spark, sf):
    kept = G.kept_faces(_faces(spark, sf), 0.2, 0.02).withColumn("kind", F.when(F.col("surface_type") == "plane", "plane").otherwise(_kind()))
    return G.named_sockets(kept.select("part", "face", "kind", F.round(F.log1p("area"), 9).alias("score"))).select("part", "face", "name")


@query(f"""WITH {_FACE}, box AS (SELECT part, [(min(c[1] - h[1]) + max(c[1] + h[1])) / 2, (min(c[2] - h[2]) + max(c[2] + h[2])) / 2, (min(c[3] - h[3]) + max(c[3] + h[3])) / 2] AS mid, sqrt(greatest(max(c[1] + h[1]) - min(c[1] - h[1]), 1e-6) ** 2 + greatest(max(c[2] + h[2]) - min(c[2] - h[2]), 1e-6) ** 2 + greatest(max(c[3] + h[3]) - min(c[3] - h[3]), 1e-6) ** 2) AS reach FROM face GROUP BY part),
  d0 AS (SELECT f.part, f.face, f.surface_type AS kind, f.c, f.radius, f.area, b.mid, b.reach, [e[4], e[5], e[6]] AS v, sqrt(e[4] ** 2 + e[5] ** 2 + e[6] ** 2) AS s FROM face f JOIN box b ON b.part = f.part JOIN v ON v.vec_id = f.face),
  d1 AS (SELECT *, [x / s FOR x IN v] AS u, list_position([abs(x) FOR x IN v], list_max([abs(x) FOR x IN v])) AS top FROM d0), d2 AS (SELECT *, CASE WHEN v[top] < 0 THEN [-x FOR x IN u] ELSE u END AS w, [c[1] - mid[1], c[2] - mid[2], c[3] - mid[3]] AS o, greatest(0.05, reach * 0.08) AS step FROM d1),
  d3 AS (SELECT *, list_dot_product(o, w) AS al, [CAST(round_even(x / 0.4, 0) AS BIGINT) FOR x IN w] AS dir FROM d2),
  d4 AS (SELECT part, face, area, kind, dir, CAST(round_even(al / step, 0) AS BIGINT) AS off, CASE WHEN kind <> 'plane' THEN CAST(round_even(sqrt((o[1] - al * w[1]) ** 2 + (o[2] - al * w[2]) ** 2 + (o[3] - al * w[3]) ** 2) / step, 0) AS BIGINT) ELSE 0 END AS rad, CASE WHEN kind <> 'plane' THEN CAST(round_even(radius / greatest(0.05, radius * 0.06), 0) AS BIGINT) ELSE -1 END AS width FROM d3)
  SELECT part, face, first FROM (SELECT part, face, row_number() OVER (PARTITION BY part, kind, dir, off, rad, width ORDER BY area DESC, face) AS t, min(face) OVER (PARTITION BY part, kind, dir, off, rad, width) AS first FROM d4) z WHERE t = 1""")
def k04_cluster_dedup(spark, sf):
    """The largest face of each cluster of kind, direction, place along it and off it, and radius; planes lie by their normal, the others by their axis."""
    faces = _faces(spark, sf).join(_vectors(spark, sf).select(F.col("vec_id").alias("face"), F.slice("e", 4, 3).alias("v")), "face")
    frame = G.frames(faces)
    middle = F.array(*[(F.col(f"lo{i}") + F.col(f"hi{i}")) / 2 for i in range(3)])
    unit = F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, y: s + y * y)))
    flat = F.col("surface_type") == "plane"
    rows = faces.join(frame.select("part", middle.alias("middle"), "diagonal"), "part").select(
        "part", F.col("surface_type").alias("kind"), "face", F.col("face").alias("turn"), F.col("center").alias("origin"), F.when(~flat, unit).alias("axis"), F.when(flat, unit).alias("normal"),
        F.when(~flat, F.col("radius")).alias("radius"), F.col("area").alias("score"), "middle", "diagonal",
    )
    rules = Z.ExtractionRules(direction_step=0.4, likeness=Z.Likeness(origin=0.05, radius=0.05))
    return Z.cluster_best(rows, rules).select("part", "face", F.col("turn").alias("first"))


@query(f"""WITH {S.CAND} SELECT 'query' AS name, query, count(*) AS place, CAST(max(n_roles) AS VARCHAR) AS value FROM role GROUP BY query UNION ALL SELECT 'role', query, pos, role FROM role
  UNION ALL SELECT 'candidate', query, row_number() OVER (PARTITION BY query, role ORDER BY candidate) - 1, role || ':' || candidate FROM cand UNION ALL SELECT 'edge', query, row_number() OVER (PARTITION BY query ORDER BY edge) - 1, role_a || '-' || role_b || ':' || status FROM edge""")
def s01_load_protocol(spark, sf):
    """Documents of all requests, written as JSON files and read back with an explicit schema as four flat tables."""
    cands = written(B.candidates(spark, sf), "candidates")
    sets = cands.groupBy("query", "role").agg(F.sort_array(F.collect_list("candidate")).alias("ids"))
    roles = cands.groupBy("query").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "role"))), lambda x: x["role"]).alias("roles"))
    edges = B.edges(spark, sf, cands).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("edge", "role_a", "role_b", "status"))).alias("functional_edges"))
    documents = roles.join(sets.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct("role", "ids"))).alias("candidate_sets")), "query").join(edges, "query", "left")
    folder = shared_folder(spark, "requests")
    documents.write.json(folder)
    tables = load_protocol(spark, folder)
    pick = {"query": ("n_roles", F.col("n_roles").cast("string")), "role": ("pos", F.col("role")), "candidate": ("pos", F.concat_ws(":", "role", "candidate")), "edge": ("pos", F.concat(F.concat_ws("-", "role_a", "role_b"), F.lit(":"), F.col("status")))}
    parts = [tables[n].select(F.lit(n).alias("name"), "query", F.col(place).cast("long").alias("place"), value.alias("value")) for n, (place, value) in pick.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"""WITH {S.ASSIGN}, top AS (SELECT * FROM ranking WHERE rank < 3), one AS (SELECT query, rank, unnest([0, 1, 2, 3, 4]) AS pos, unnest([p0, p1, p2, p3, p4]) AS candidate FROM top),
  m AS (SELECT o.query, o.rank, e.edge, e.side, p.ordinal FROM endpoint e JOIN role r ON r.query = e.query AND r.role = e.role JOIN one o ON o.query = e.query AND o.pos = r.pos JOIN port p ON p.step = o.candidate AND (e.contract IS NULL OR p.contract = e.contract)),
  x AS (SELECT a.query, a.rank, a.edge, a.ordinal AS a, b.ordinal AS b, row_number() OVER (PARTITION BY a.query, a.rank, a.edge ORDER BY a.ordinal, b.ordinal) - 1 AS place FROM m a JOIN m b ON a.query = b.query AND a.rank = b.rank AND a.edge = b.edge AND a.side = 'a' AND b.side = 'b'),
  alt AS (SELECT query, rank, edge, string_agg('=' || place || '|=' || a || '|=' || b, ';' ORDER BY place) AS t FROM x WHERE place < 2 GROUP BY ALL),
  prog AS (SELECT t.query, t.rank, string_agg('=' || e.edge || '|=' || ['fixed', 'revolute', 'prismatic'][(e.query + e.edge) % 3 + 1] || '(' || coalesce(a.t, '') || ')', ';' ORDER BY e.edge) AS t FROM top t JOIN edge e ON e.query = t.query LEFT JOIN alt a ON a.query = t.query AND a.rank = t.rank AND a.edge = e.edge GROUP BY ALL),
  hyp AS (SELECT t.query, count(*) AS n, string_agg('=' || t.rank || '|=' || CAST(round(t.score * 1000000) AS BIGINT) || '|=' || t.identity || '[' || coalesce(p.t, '') || ']', ';' ORDER BY t.rank) AS t FROM top t LEFT JOIN prog p ON p.query = t.query AND p.rank = t.rank GROUP BY t.query),
  led AS (SELECT q.query, CASE WHEN h.n IS NULL THEN 'no_candidate' ELSE 'prediction_ready' END AS status, coalesce(h.n, 0) AS hypotheses, sha256('=' || q.query || '|=' || CASE WHEN h.n IS NULL THEN 'no_candidate' ELSE 'prediction_ready' END || chr(10) || coalesce(h.t, '')) AS row_sha256 FROM (SELECT DISTINCT query FROM cand) q LEFT JOIN hyp h ON h.query = q.query),
  pos AS (SELECT 0 AS k, query || ':' || row_sha256 AS t, row_number() OVER (ORDER BY query) - 1 AS pos FROM led), {S.tree_hashes('pos', 'k', 64)}
  SELECT led.query, led.status, led.hypotheses, led.row_sha256, sha256('beam=3' || chr(10) || 'policy=minimum_port_ambiguity' || chr(10) || tree.n || chr(10) || tree.hash) AS payload_sha256, 0 AS faults FROM led, tree""")
def s08_prediction_ledger(spark, sf):
    """The ledger of every request: its three best assignments, their edges' programs, and of each edge the two first pairs of primitives; with the payload's hash and what its check finds."""
    ports = written(B.ports(spark, sf), "ports")
    top = written(A.ranked(_best(spark, sf), beam=3), "top-assignments")
    hypotheses = top.select("query", "rank", F.round(F.col("score") * 1e6).cast("long").alias("score"), "identity")
    edges = written(B.edges(spark, sf), "edges")
    names = F.element_at(F.array(*map(F.lit, ["fixed", "revolute", "prismatic"])), ((F.col("query") + F.col("edge")) % 3 + 1).cast("int"))
    programs = top.select("query", "rank").join(edges.select("query", "edge", names.alias("mobility")), "query")
    roles = B.candidates(spark, sf).select("query", "pos", "role").distinct()
    picked = top.select("query", "rank", F.posexplode("picks").alias("pos", "step")).join(roles, ["query", "pos"]).select("query", "rank", "role", "step")
    own = ports.select("step", "ordinal", F.col("contract").alias("own"))
    matches = B.endpoints(spark, sf, ports).join(picked, ["query", "role"]).join(own, "step").where("contract is null or contract = own")
    side = lambda s: matches.where(F.col("side") == s).select("query", "rank", "edge", F.col("ordinal").alias(s))
    order = Window.partitionBy("query", "rank", "edge").orderBy("a", "b")
    pairs = side("a").join(side("b"), ["query", "rank", "edge"]).withColumn("place", F.row_number().over(order) - 1).where("place < 2")
    ledger = written(K.prediction_ledger(B.candidates(spark, sf).select("query"), hypotheses, programs, pairs), "ledger")
    payload = K.ledger_payload(ledger, {"policy": "minimum_port_ambiguity", "beam": "3"}, fan=64)
    faults = K.ledger_faults(ledger).agg(F.count("*").cast("int").alias("faults"))
    # one row each
    return ledger.select("query", "status", F.size("hypotheses").cast("long").alias("hypotheses"), "row_sha256").crossJoin(F.broadcast(payload.select("payload_sha256"))).crossJoin(F.broadcast(faults))


@query(f"""WITH {S.ASSIGN}, picked AS (SELECT query, rank, unnest([0, 1, 2, 3, 4]) AS pos, unnest([p0, p1, p2, p3, p4]) AS candidate FROM ranking WHERE rank < 25), seen AS (SELECT query, pos, candidate, min(rank) AS seen FROM picked WHERE candidate IS NOT NULL GROUP BY ALL),
  place AS (SELECT c.query, c.pos, c.candidate, row_number() OVER (PARTITION BY c.query, c.role ORDER BY s.seen IS NULL, s.seen, c.candidate) - 1 AS place FROM cand c LEFT JOIN seen s ON s.query = c.query AND s.pos = c.pos AND s.candidate = c.candidate),
  long_ AS (SELECT query, identity, unnest([0, 1, 2, 3, 4]) AS pos, unnest([p0, p1, p2, p3, p4]) AS candidate FROM assigned),
  scored AS (SELECT l.query, l.identity, CAST(-sum(p.place) AS DOUBLE) AS score FROM long_ l JOIN place p ON p.query = l.query AND p.pos = l.pos AND p.candidate = l.candidate GROUP BY ALL),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, identity) - 1 AS INTEGER) AS rank FROM scored) SELECT query, rank, identity FROM r WHERE rank < 25""")
def j08_contract_dispatch(spark, sf):
    ready = _ready(spark, sf)
    places = R.role_rankings(B.candidates(spark, sf), A.ranked(A.best_assignments(ready)))
    return A.ranked(A.best_assignments(R.place_costs(ready, places))).select("query", "rank", "identity")


@query(f"""WITH {S.CAND}, d AS (SELECT DISTINCT l_returnflag || '|' || l_linestatus || '|' || l_linenumber AS descriptor FROM lineitem), c AS (SELECT row_number() OVER (ORDER BY sha256(descriptor)) - 1 AS idx, substr(sha256(descriptor), 1, 16) AS id, descriptor FROM d)
  SELECT e.query, e.edge, e.role_a AS endpoint_a, e.role_b AS endpoint_b, c.idx, c.id, c.descriptor FROM edge e, c""")
def j31_catalog_candidates(spark, sf):
    """Every edge with every entry of the catalog that the lines' flags, states and numbers make up."""
    known = catalog(B.table(spark, sf, "lineitem").select(F.concat_ws("|", "l_returnflag", "l_linestatus", "l_linenumber").alias("descriptor")))
    edges = B.edges(spark, sf).select("query", "edge", F.col("role_a").alias("endpoint_a"), F.col("role_b").alias("endpoint_b"))
    return K.catalog_candidates(edges, known)


_LOSS_PARTS = {"mobility": ["fixed", "revolute", "prismatic", "ball"], "support": ["axial", "planar", "mixed"]}
_H = "CAST(('0x' || substr(sha256({}), 1, 5)) AS BIGINT)"


def _entropy_sql(name: str) -> str:
    """name_l: query and the mean loss over units, of name_s (query, unit, choice, score) and name_t (query, unit, choice)."""
    return f"""{name}_l AS (SELECT t.query, avg(n.z - s.score) AS {name} FROM {name}_t t JOIN {name}_s s ON s.query = t.query AND s.unit = t.unit AND s.choice = t.choice
    JOIN (SELECT query, unit, ln(sum(exp(score))) AS z FROM {name}_s GROUP BY query, unit) n ON n.query = t.query AND n.unit = t.unit GROUP BY t.query)"""


def _named_sql(name: str) -> str:
    many = len(_LOSS_PARTS[name])
    text = f"query || ':{name}:' || unit || ':' || choice"
    return f"{name}_s AS (SELECT query, unit, choice, {_H.format(text)} / 1e5 AS score FROM (SELECT query, edge AS unit, unnest(range({many})) AS choice FROM edge) x), {name}_t AS (SELECT query, edge AS unit, (query + edge) % {many} AS choice FROM edge)"


@query(f"""WITH {_SCORES}, unary_s AS (SELECT query, pos AS unit, candidate AS choice, score / 1e5 AS score FROM unary WHERE (query + pos) % 3 <> 0 OR candidate % 5 <> 0), unary_t AS (SELECT query, pos AS unit, candidate AS choice FROM target),
  pair_s AS (SELECT query, pos AS unit, a || '/' || b AS choice, score / 1e5 AS score FROM pair), pair_t AS (SELECT b.query, b.pos AS unit, a.candidate || '/' || b.candidate AS choice FROM target a JOIN target b ON b.query = a.query AND b.pos = a.pos + 1),
  {_named_sql('mobility')}, {_named_sql('support')},
  interface_s AS (SELECT query, unit, choice, {_H.format("query || ':interface:' || unit || ':' || choice")} / 1e5 AS score FROM (SELECT query, edge AS unit, unnest(range(6)) AS choice FROM edge WHERE query % 3 <> 0) x), interface_t AS (SELECT query, edge AS unit, (query + edge) % 8 AS choice FROM edge WHERE query % 3 <> 0),
  proposal_s AS (SELECT query, unit, choice, {_H.format("query || ':proposal:' || unit || ':' || choice")} / 1e5 AS score FROM (SELECT query, edge AS unit, unnest(range(4)) AS choice FROM edge) x), proposal_t AS (SELECT query, edge AS unit, (query + edge) % 5 AS choice FROM edge),
  {', '.join(map(_entropy_sql, ['unary', 'pair', 'mobility', 'support', 'interface', 'proposal']))},
  wrong AS (SELECT u.query, u.pos, max(u.score) AS score FROM unary u JOIN target t ON t.query = u.query AND t.pos = u.pos AND t.candidate <> u.candidate GROUP BY ALL),
  structured_l AS (SELECT w.query, avg(ln(1 + exp(1 + w.score / 1e5 - u.score / 1e5))) AS structured FROM wrong w JOIN target t ON t.query = w.query AND t.pos = w.pos JOIN unary u ON u.query = t.query AND u.pos = t.pos AND u.candidate = t.candidate GROUP BY w.query),
  masked AS (SELECT DISTINCT query FROM target WHERE (query + pos) % 3 = 0 AND candidate % 5 = 0), q AS (SELECT DISTINCT query FROM target),
  every AS (SELECT q.query, m.query IS NULL AS fine, coalesce(a.unary, 0) AS unary, coalesce(b.pair, 0) AS pair, CASE WHEN q.query % 4 = 0 THEN 0 ELSE coalesce(c.mobility, 0) END AS mobility, coalesce(d.support, 0) AS support, coalesce(e.interface, 0) AS interface, coalesce(f.proposal, 0) AS proposal, coalesce(g.structured, 0) AS structured
    FROM q LEFT JOIN masked m ON m.query = q.query LEFT JOIN unary_l a ON a.query = q.query LEFT JOIN pair_l b ON b.query = q.query LEFT JOIN mobility_l c ON c.query = q.query LEFT JOIN support_l d ON d.query = q.query LEFT JOIN interface_l e ON e.query = q.query LEFT JOIN proposal_l f ON f.query = q.query LEFT JOIN structured_l g ON g.query = q.query)
  SELECT query, CASE WHEN fine THEN 'scored' ELSE 'target_unavailable' END AS status, {', '.join(f'CASE WHEN fine THEN round({c}, 5) + 0.0 END AS {c}' for c in ['unary', 'pair', 'mobility', 'support', 'interface', 'proposal', 'structured'])},
    CASE WHEN fine THEN round(unary + pair + mobility + support + 0.5 * interface + 0.5 * proposal + 0.25 * structured, 5) END AS loss FROM every""")
def e03_linker_loss(spark, sf):
    """All parts of the loss by query, over score tables of roles, edges, names and choices; some targets are masked, and some lie outside the proposals."""
    cands = written(B.candidates(spark, sf), "candidates")
    scored, goal = written(_unary(spark, sf, cands), "unary-scores"), written(_targets(spark, sf, cands), "targets")
    edges = written(B.edges(spark, sf, cands).select("query", F.col("edge").alias("unit")), "edge-units")
    mark = (F.col("query") + F.col("pos")) % 3 != 0
    unary = scored.select("query", F.col("pos").alias("unit"), F.col("candidate").alias("choice"), (F.col("score") / 1e5).alias("score"), (mark | (F.col("candidate") % 5 != 0)).alias("available"))
    a, b = goal.select("query", (F.col("pos") + 1).alias("pos"), F.col("candidate").alias("a")), goal.select("query", "pos", F.col("candidate").alias("b"))
    both = lambda df: df.withColumn("choice", F.concat_ws("/", "a", "b")).withColumnRenamed("pos", "unit")

    def named(name: str, many: int, goal_of: int, units):
        score = _micro("query", F.lit(name), "unit", "choice") / 1e5
        return units.select("query", "unit", F.explode(F.sequence(F.lit(0), F.lit(many - 1))).alias("choice")).withColumn("score", score), units.withColumn("choice", (F.col("query") + F.col("unit")) % goal_of)

    parts = {
        "unary": (unary, goal.select("query", F.col("pos").alias("unit"), F.col("candidate").alias("choice"))),
        "pair": (both(_scored_pairs(spark, sf, cands)).withColumn("score", F.col("score") / 1e5), both(shuffled(a).join(b, ["query", "pos"]))),
        "mobility": named("mobility", 4, 4, edges), "support": named("support", 3, 3, edges),
        "interface": named("interface", 6, 8, edges.where("query % 3 <> 0")), "proposal": named("proposal", 4, 5, edges),
    }
    right = shuffled(goal).join(scored, ["query", "pos", "candidate"]).select("query", "pos", "candidate", (F.col("score") / 1e5).alias("positive"))
    wrong = shuffled(scored).join(goal.withColumnRenamed("candidate", "goal"), ["query", "pos"]).where("candidate <> goal").groupBy("query", "pos").agg((F.max("score") / 1e5).alias("negative"))
    out = L.linker_loss(parts, shuffled(right).join(wrong, ["query", "pos"]), goal.where("query % 4 = 0").select("query"))
    return out.select("query", "status", *[(F.round(c, 5) + 0.0).alias(c) for c in [*L.PARTS, "structured", "loss"]])


@query(f"""WITH {_SCORES}, m AS (SELECT query, pos - 1 AS pos, a AS candidate, max(score) AS m FROM pair GROUP BY ALL UNION ALL SELECT query, pos, b, max(score) FROM pair GROUP BY ALL), s AS (SELECT u.query, u.pos, u.candidate, u.score + sum(m.m) AS total, count(*) + 1 AS degree FROM unary u JOIN m ON m.query = u.query AND m.pos = u.pos AND m.candidate = u.candidate GROUP BY u.query, u.pos, u.candidate, u.score)
  SELECT query, pos, candidate, round(CAST(total AS DOUBLE) / degree, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query, pos ORDER BY total DESC, candidate) AS t FROM s) x WHERE t = 1""")
def i10_independent_role_beam(spark, sf):
    p = _scored_pairs(spark, sf)
    best = p.groupBy("query", (F.col("pos") - 1).alias("pos"), F.col("a").alias("candidate")).agg(F.max("score").alias("m")).unionByName(p.groupBy("query", "pos", F.col("b").alias("candidate")).agg(F.max("score").alias("m")))
    summed = best.groupBy("query", "pos", "candidate").agg(F.sum("m").alias("m"), (F.count("*") + 1).alias("degree"))
    total = _unary(spark, sf).join(summed, ["query", "pos", "candidate"]).withColumn("total", F.col("score") + F.col("m"))
    order = Window.partitionBy("query", "pos").orderBy(F.desc("total"), "candidate")
    return total.withColumn("t", F.row_number().over(order)).where("t = 1").select("query", "pos", "candidate", F.round(F.col("total").cast("double") / F.col("degree"), 4).alias("score"))


_SLOTS = ", ".join(f"('{r}', {i}, '{f}')" for (r, _, _, _), families in zip(D.ROLES, D.LARGE_FAMILIES, strict=True) for i, f in enumerate(families))


@query(f"""WITH slot(role, slot, family) AS (VALUES {_SLOTS}), q AS (SELECT c_custkey AS query, substr(sha256('271828:query:' || c_custkey), 1, 16) AS seed FROM customer),
  r AS (SELECT q.query, q.seed, s.role, string_agg(s.family, ',' ORDER BY sha256(q.seed || ':' || s.role || ':' || s.slot), s.slot) AS families FROM q, slot s GROUP BY ALL),
  t AS (SELECT query, seed, string_agg(role || '=' || families, ';' ORDER BY role) AS roles FROM r GROUP BY query, seed)
  SELECT query, seed, roles, 'proc_' || substr(sha256(seed || '|' || roles), 1, 20) AS query_id FROM t""")
def d01_schedule(spark, sf):
    """A generated request for every customer: eight families at each role, in the order of their draws."""
    out = D.schedule_ids(D.schedule(B.table(spark, sf, "customer").select(F.col("c_custkey").alias("query")), 271828, large=True))
    return out.withColumn("roles", F.array_join(F.transform("roles", lambda r: F.concat(r["role"], F.lit("="), F.array_join(r["families"], ","))), ";"))


@query("""WITH s AS (SELECT event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS chamfer FROM events)
  SELECT event_type, count(*) AS rows, count(chamfer) AS scored, round(avg(chamfer), 6) AS conditional, round(avg(coalesce(least(chamfer, 100), 100)), 6) AS failure_aware, round(avg(CASE WHEN chamfer IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS rate FROM s GROUP BY event_type""")
def e08_geometry_summary(spark, sf):
    rows = B.table(spark, sf, "events").select("event_type", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("chamfer"))
    return rows.groupBy("event_type").agg(
        F.count("*").alias("rows"), F.count("chamfer").alias("scored"), F.round(F.avg("chamfer"), 6).alias("conditional"),
        F.round(F.avg(F.when(F.col("chamfer").isNull(), 100.0).otherwise(F.least("chamfer", F.lit(100.0)))), 6).alias("failure_aware"), F.round(F.avg(F.col("chamfer").isNotNull().cast("double")), 6).alias("rate"),
    )


@query("""WITH s AS (SELECT doc_id, source, CASE WHEN source < 'src13' THEN 'train' WHEN source < 'src16' THEN 'dev' ELSE 'test' END AS split FROM documents), h AS (SELECT split, source, doc_id, row_number() OVER (PARTITION BY split ORDER BY source, doc_id) - 1 AS slot, sha256(array_to_string(['=' || doc_id, '=' || source], chr(31))) AS hash FROM s WHERE split <> 'test')
  SELECT split, slot, source AS "case", doc_id AS ordinal, hash FROM h""")
def v10_authority_projection(spark, sf):
    """Rows of the train and dev sources by slot; those of the test sources never come out."""
    docs = B.table(spark, sf, "documents").select(F.col("source").alias("case"), F.col("doc_id").alias("ordinal"))
    split = F.when(F.col("case") < "src13", "train").when(F.col("case") < "src16", "dev").otherwise("test")
    return K.authority_projection(docs, docs.select("case").distinct().withColumn("split", split), row_hash(F.col("ordinal"), F.col("case")), ["train", "dev"])[0]
