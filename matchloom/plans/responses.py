"""Queries on responses, commitments, alignments and verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.functions import vectors as V
from matchloom.functions.ports import MOBILITIES
from matchloom.operators import assignments as A
from matchloom.operators import graphs as G
from matchloom.operators import ports as O
from matchloom.operators import requests as R
from matchloom.operators import symmetries as Y
from matchloom.operators.assemblies import aligned
from matchloom.operators.ordering import positions
from matchloom.operators.records import face_bindings, semantic_commitments
from matchloom.sources.tables import tasks_for, written

from . import bindings as B
from . import sql as S
from .geometry import _PLACED, _placed
from .graphs import _FACE, _faces
from .registry import query


@query(f"""WITH {S.CAND}, q AS (SELECT query, max(n_roles) AS n FROM role GROUP BY query) SELECT query, CASE WHEN query % 9 = 0 THEN 'coverage' WHEN query % 7 = 0 THEN 'roles' WHEN query % 13 = 0 AND NOT (query % 6 = 0 AND n = 2) THEN 'mobility' WHEN query % 6 = 0 AND n > 1 THEN 'connectivity' ELSE 'valid' END AS reason FROM q""")
def r06_validate_graph_response(spark, sf):
    roles = B.candidates(spark, sf).select("query", "pos", "role").distinct()
    said_roles = roles.where("query % 9 <> 0").select("query", F.when((F.col("query") % 7 == 0) & (F.col("pos") == 0), "other").otherwise(F.col("role")).alias("role"))
    given = B.edges(spark, sf).where("query % 9 <> 0 and (query % 6 <> 0 or pos_a <> 0)")
    said = given.select("query", "edge", "role_a", "role_b", F.when(F.col("query") % 13 == 0, "welded").otherwise("fixed").alias("mobility"))
    return R.graph_response_reasons(roles.select("query", "role"), said_roles, said, MOBILITIES)


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents), x AS (SELECT source, count(*) AS rows, count(*) FILTER (WHERE doc_id % 37 = 0) AS missing, count(*) FILTER (WHERE doc_id % 37 <> 0 AND (doc_id % 31 = 0 OR doc_id % 29 = 0)) AS differing FROM r GROUP BY source)
  SELECT source AS "case", CASE WHEN source < 'src13' THEN 'train' ELSE 'dev' END AS split, rows, missing, CASE WHEN rows % 5 = 0 THEN 1 ELSE 0 END AS extra, differing, missing + differing = 0 AND rows % 5 <> 0 AND rows % 7 <> 0 AS verified FROM x""")
def j28_semantic_commitments(spark, sf):
    """Rows of every source against commitments of which some are lacking, have another hash or id, or are one too many; some sources declare another number."""
    docs = B.table(spark, sf, "documents").select(F.col("source").alias("case"), "doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    rows = written(positions(docs, ["case"], ["doc_id"], "place").withColumnRenamed("doc_id", "id"), "library-rows")
    i = F.col("id")
    committed = rows.where("id % 37 <> 0").select("case", "place", F.when(i % 29 == 0, -1).otherwise(i).alias("id"), F.when(i % 31 == 0, "other").otherwise(F.col("sha")).alias("sha"))
    n = rows.groupBy("case").agg(F.count("*").alias("n"))
    more = n.where("n % 5 = 0").select("case", F.col("n").alias("place"), F.lit(0).cast("long").alias("id"), F.lit("more").alias("sha"))
    cases = n.select("case", F.when(F.col("case") < "src13", "train").otherwise("dev").alias("split"), F.when(F.col("n") % 7 == 0, F.col("n") + 1).otherwise(F.col("n")).alias("row_count"))
    return semantic_commitments(rows, committed.unionByName(more), cases)[0]


@query(f"""WITH {_PLACED} SELECT user_id * 1000000 + pos // 5 AS query, count(*) AS parts, CASE WHEN max(user_id) % 7 = 0 AND count(*) > 1 THEN 'role_domain' ELSE 'aligned' END AS status FROM pl GROUP BY 1""")
def j25_anchor_align(spark, sf):
    """Five parts in a row, moved by 25 along x and turned, come back by the pose of their first; some predictions lack their last part."""
    pose = V.pose(F.col("value"), F.col("value"), (F.col("event_id") % 17).cast("double"), F.lit(0.0))
    parts = _placed(spark, sf).select((F.col("user_id") * 1_000_000 + F.floor(F.col("pos") / 5)).alias("query"), (F.col("pos") % 5).alias("role"), "user_id", pose.alias("world"))
    last = F.max("role").over(Window.partitionBy("query"))
    moved = parts.withColumn("last", last).where("user_id % 7 <> 0 or role = 0 or role <> last").select("query", "role", V.multiplied(V.pose(F.lit(40.0), F.lit(25.0), F.lit(0.0), F.lit(0.0)), F.col("world")).alias("world"))
    back = aligned(moved, parts.select("query", "role", "world"))
    off = F.array_max(F.zip_with("world", "reference", lambda x, y: F.abs(x - y)))
    fits = F.bool_and(off < 1e-8)
    return back.groupBy("query").agg(F.count("*").alias("parts"), F.when(F.max("status") != "aligned", F.max("status")).when(fits, "aligned").otherwise("off").alias("status"))


@query("""WITH n AS (SELECT user_id, event_type, value AS v, event_id % 17 AS y, lead(value) OVER w AS v2, lead(event_id) OVER w % 17 AS y2, lead(event_type) OVER w AS t2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  m AS (SELECT *, t2 = event_type AS fits, CASE event_type WHEN 'click' THEN [0, 90, 180, 270] WHEN 'purchase' THEN [0, 120, 240] WHEN 'view' THEN [0, 180] ELSE [0] END AS turns FROM n WHERE v2 IS NOT NULL),
  e AS (SELECT user_id, fits, sqrt((v2 - v) ** 2 + (y2 - y) ** 2) AS d, list_min(list_transform(turns, lambda f: least((v2 - v + f) - 360 * floor((v2 - v + f) / 360), 360 - ((v2 - v + f) - 360 * floor((v2 - v + f) / 360))))) AS a FROM m)
  SELECT user_id AS query, count(*) AS parts, count(*) FILTER (WHERE fits) AS matching, round(avg(d) FILTER (WHERE fits), 4) + 0.0 AS translation_pct, round(avg(a) FILTER (WHERE fits) + 0.0002, 3) + 0.0 AS rotation_deg FROM e GROUP BY user_id""")
def j26_pose_errors(spark, sf):
    """Each event's pose held against the next one's, where both are of one type; types turn by their symmetries: quarter and third turns about z, half turns about z and x."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pose = V.pose(F.col("value"), F.col("value"), (F.col("event_id") % 17).cast("double"), F.lit(0.0))
    rows = written(B.table(spark, sf, "events").select(F.col("user_id").alias("query"), place.alias("role"), F.col("event_type").alias("part"), pose.alias("pose")), "poses")
    predicted = rows.withColumn("role", F.col("role") - 1)
    reference = rows.join(predicted.select("query", "role"), ["query", "role"], "left_semi")
    turn = lambda degrees: V.pose(F.lit(float(degrees)), *[F.lit(0.0)] * 3)
    flat = lambda p: F.array(*[p[4 * i + j] for i in range(3) for j in range(3)])
    over = F.array(*map(F.lit, [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0]))
    given = [("click", flat(turn(90))), ("purchase", flat(turn(120))), ("view", flat(turn(180))), ("view", over)]
    types = rows.select("part").distinct()
    generators = types.select("part", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), r.alias("rotation")) for n, r in given])).alias("g")).where("part = g.n").select("part", "g.rotation")
    errors = Y.pose_errors(predicted, reference, Y.closed_symmetries(generators))
    out = Y.pose_error_means(errors, reference, reference.select("query").distinct().withColumn("diagonal", F.lit(100.0)))
    # angles have two digits, so their means may lie half way between three; both sides are moved off that before they are rounded
    return out.select("query", "parts", "matching", (F.round("translation_pct", 4) + 0.0).alias("translation_pct"), (F.round(F.col("rotation_deg") + 0.0002, 3) + 0.0).alias("rotation_deg"))


@query(f"""WITH f AS (SELECT DISTINCT label AS part, vec_id AS face FROM embeddings WHERE vec_id >= 0), p AS (SELECT part, face || ':' || sha256(part || '/' || face) AS t, row_number() OVER (PARTITION BY part ORDER BY face) - 1 AS pos FROM f), {S.tree_hashes('p', 'part', 64)}
  SELECT part, n AS faces, sha256('faces' || chr(0) || 'label' || chr(0) || n || chr(0) || hash) AS hash FROM tree""")
def v12_face_binding_hash(spark, sf):
    """A binding of all faces of a label: name space, gauge, how many distinct indices, and their ordered tree with each face's signature."""
    faces = B.table(spark, sf, "embeddings").select(F.col("label").alias("part"), F.col("vec_id").alias("face"))
    return face_bindings(faces.withColumn("signature", F.sha2(F.concat_ws("/", "part", "face"), 256)), "faces", "label", fan=64)


@query(f"""WITH {S.ASSIGN}, one AS (SELECT query, unnest([0, 1, 2, 3, 4]) AS pos, unnest([p0, p1, p2, p3, p4]) AS candidate FROM ranking WHERE rank = 0),
  m AS (SELECT o.query, e.edge, e.side, p.ordinal, p.kind, round(p.size, 6) AS size FROM endpoint e JOIN role r ON r.query = e.query AND r.role = e.role JOIN one o ON o.query = e.query AND o.pos = r.pos JOIN port p ON p.step = o.candidate AND (e.contract IS NULL OR p.contract = e.contract)),
  x AS (SELECT a.query, a.edge, a.ordinal AS a, b.ordinal AS b, row_number() OVER (PARTITION BY a.query, a.edge ORDER BY a.kind, a.size, a.ordinal, b.kind, b.size, b.ordinal) - 1 AS rank FROM m a JOIN m b ON a.query = b.query AND a.edge = b.edge AND a.side = 'a' AND b.side = 'b')
  SELECT query, edge, a, b, CAST(rank AS INTEGER) AS rank FROM x WHERE rank < 3""")
def w08_hypothesis_alternatives(spark, sf):
    """For the first assignment of each query: an edge's pairs of matching primitives, the least features first."""
    cands = written(B.candidates(spark, sf), "candidates")
    ports = written(B.ports(spark, sf).select("step", "ordinal", "kind", "size", "contract"), "ports")
    counted = written(O.contract_counts(ports.repartition(tasks_for(ports, 500_000), "step")), "contracts")
    ends = written(B.endpoints(spark, sf, counted.select("step", F.lit(0).alias("ordinal"), F.col("stated").alias("contract")), cands), "endpoints")
    ready = A.endpoint_costs(cands, O.match_counts(cands, ends, counted))
    first = A.ranked(A.best_assignments(ready), beam=1).select("query", F.posexplode("picks").alias("pos", "candidate"))
    roles = cands.select("query", "pos", "role").distinct()
    picked = first.join(roles, ["query", "pos"]).select("query", "role", F.col("candidate").alias("step"))
    found = ports.select("step", "ordinal", "kind", F.round("size", 6).alias("size"), F.col("contract").alias("own"))
    asked = ends.join(picked, ["query", "role"])
    tasks = tasks_for(ports, 500_000)
    matches = asked.repartition(tasks, "step").join(found.repartition(tasks, "step"), "step").where("contract is null or contract = own")
    # the first three pairs have no primitive behind the third of its side
    near = Window.partitionBy("query", "edge", "side").orderBy("kind", "size", "ordinal")
    matches = written(matches.withColumn("place", F.row_number().over(near)).where("place <= 3"), "matches")
    side = lambda s: matches.where(F.col("side") == s).select("query", "edge", *[F.col(c).alias(f"{c}_{s}") for c in ("ordinal", "kind", "size")])
    order = Window.partitionBy("query", "edge").orderBy("kind_a", "size_a", "ordinal_a", "kind_b", "size_b", "ordinal_b")
    pairs = side("a").join(side("b"), ["query", "edge"]).withColumn("rank", F.row_number().over(order) - 1).where("rank < 3")
    return pairs.select("query", "edge", F.col("ordinal_a").alias("a"), F.col("ordinal_b").alias("b"), "rank")


@query(f"""WITH {_FACE}, f AS (SELECT part, (min(c[1] - h[1]) + max(c[1] + h[1])) / 2 AS m1, (min(c[2] - h[2]) + max(c[2] + h[2])) / 2 AS m2, (min(c[3] - h[3]) + max(c[3] + h[3])) / 2 AS m3, sqrt((max(c[1] + h[1]) - min(c[1] - h[1])) ** 2 + (max(c[2] + h[2]) - min(c[2] - h[2])) ** 2 + (max(c[3] + h[3]) - min(c[3] - h[3])) ** 2) AS diag FROM face GROUP BY part)
  SELECT x.part, x.face, round(ln(1 + x.area) + 0.75 * greatest(0, 1 - sqrt((x.c[1] - f.m1) ** 2 + (x.c[2] - f.m2) ** 2 + (x.c[3] - f.m3) ** 2) / greatest(0.5 * f.diag, 1e-6)), 6) AS score FROM face x JOIN f ON f.part = x.part WHERE x.surface_type = 'plane'""")
def k03_face_scores(spark, sf):
    faces = _faces(spark, sf)
    frame = G.frames(faces)
    mid = [(F.col(f"lo{i}") + F.col(f"hi{i}")) / 2 for i in range(3)]
    far = F.sqrt(sum(((F.col("center")[i] - mid[i]) ** 2 for i in range(3)), F.lit(0.0)))
    central = F.greatest(F.lit(0.0), 1 - far / F.greatest(0.5 * F.col("diagonal"), F.lit(1e-6)))
    planes = faces.where("surface_type = 'plane'").join(frame.drop("area"), "part")
    return planes.select("part", "face", F.round(F.log1p("area") + 0.75 * central, 6).alias("score"))
