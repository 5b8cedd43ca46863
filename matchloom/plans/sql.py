"""The bindings as SQL common table expressions, for the oracle."""

PRIM = """
prim AS MATERIALIZED (
  SELECT *, CASE WHEN geometry_type IN ('circle', 'cylinder') AND radius > 0 THEN radius ELSE size END AS measure FROM (
    SELECT l_orderkey AS step,
      CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS ordinal,
      CASE WHEN l_linestatus = 'F' THEN 'face' ELSE 'edge' END AS kind,
      CASE WHEN l_returnflag = 'A' THEN 'plane' WHEN l_returnflag = 'N' THEN 'cylinder' ELSE 'circle' END AS geometry_type,
      CAST(l_extendedprice AS DOUBLE) AS size, CAST(l_quantity AS DOUBLE) AS radius, l_partkey % 2 + 1 AS members
    FROM lineitem) x)"""

ADJ = PRIM + """,
last_ AS (SELECT step, max(ordinal) AS last FROM prim GROUP BY step),
adj AS MATERIALIZED (SELECT a.step, a.ordinal AS a, b.ordinal AS b, abs(a.members - b.members) AS feature FROM prim a JOIN prim b ON a.step = b.step AND b.ordinal = a.ordinal + 1
  UNION ALL SELECT l.step, 0, l.last, abs(a.members - b.members) FROM last_ l JOIN prim a ON a.step = l.step AND a.ordinal = 0 JOIN prim b ON b.step = l.step AND b.ordinal = l.last WHERE l.last >= 2),
way AS MATERIALIZED (SELECT step, a, b, feature FROM adj UNION ALL SELECT step, b, a, feature FROM adj)"""

PORT = ADJ + """,
near AS (SELECT w.step, w.a AS ordinal, count(*) AS n, count(*) FILTER (WHERE geometry_type = 'plane') AS p, count(*) FILTER (WHERE geometry_type = 'cylinder') AS c, count(*) FILTER (WHERE geometry_type = 'circle') AS r
  FROM way w JOIN prim q ON q.step = w.step AND q.ordinal = w.b GROUP BY w.step, w.a),
beside AS (SELECT m.step, m.ordinal, coalesce(nullif(array_to_string(list_filter([CASE WHEN p >= 0.24 * n THEN 'plane' END, CASE WHEN c >= 0.24 * n THEN 'cylinder' END, CASE WHEN r >= 0.24 * n THEN 'circle' END], lambda x: x IS NOT NULL)[1:2], '+'), ''), 'none') AS adjacent
  FROM prim m LEFT JOIN near USING (step, ordinal)),
peer AS (
  SELECT p.step, p.ordinal, count(*) AS n, count(*) FILTER (WHERE q.measure < p.measure - 1e-7) AS lo, count(*) FILTER (WHERE q.measure > p.measure + 1e-7) AS hi
  FROM prim p JOIN prim q ON p.step = q.step AND p.geometry_type = q.geometry_type GROUP BY p.step, p.ordinal),
port AS (
  SELECT *, kind || '|' || geometry_type || '|' || size_class || '|' || adjacent || '|' || symmetry AS contract FROM (
    SELECT p.*, beside.adjacent, CASE WHEN n = 1 THEN 'only' WHEN lo = 0 AND hi > 0 THEN 'smallest' WHEN hi = 0 AND lo > 0 THEN 'largest'
        WHEN (lo + 0.5 * (n - lo - hi)) / n < 1.0 / 3.0 THEN 'small' WHEN (lo + 0.5 * (n - lo - hi)) / n > 2.0 / 3.0 THEN 'large' ELSE 'medium' END AS size_class,
      CASE WHEN members > 1 THEN 'repeated' ELSE 'single' END AS symmetry
    FROM prim p JOIN peer USING (step, ordinal) JOIN beside USING (step, ordinal)) y)"""

CAND = """
cand0 AS (SELECT * FROM (SELECT o_custkey AS query, o_orderpriority AS role, o_orderkey AS candidate, CAST(o_totalprice AS DOUBLE) AS volume,
  count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders) x WHERE n > 1),
cand1 AS (SELECT query, role, candidate, volume, CAST(dense_rank() OVER (PARTITION BY query ORDER BY role) - 1 AS INTEGER) AS pos FROM cand0),
cand AS (SELECT * FROM (SELECT *, max(pos) OVER (PARTITION BY query) + 1 AS n_roles FROM cand1) x WHERE n_roles > 1),
role AS (SELECT DISTINCT query, pos, role, n_roles FROM cand),
edge AS (SELECT a.query, CASE WHEN b.pos = a.pos + 1 THEN a.pos ELSE b.pos END AS edge, a.pos AS pos_a, b.pos AS pos_b, a.role AS role_a, b.role AS role_b, CASE WHEN a.query % 10 = 0 THEN 'unknown' ELSE 'specified' END AS status
  FROM role a JOIN role b ON a.query = b.query AND (b.pos = a.pos + 1 OR (a.pos = 0 AND b.pos = b.n_roles - 1 AND b.pos >= 2)))"""

REQ = PORT + "," + CAND + """,
target AS (SELECT query, role, max(candidate) AS step FROM cand WHERE candidate IN (SELECT step FROM prim) GROUP BY query, role),
wanted AS (SELECT t.query, t.role, p.contract FROM target t JOIN port p ON p.step = t.step AND p.ordinal = 0),
side AS (SELECT query, edge, status, 'a' AS side, role_a AS role FROM edge UNION ALL SELECT query, edge, status, 'b', role_b FROM edge),
endpoint AS (SELECT s.query, s.edge, s.side, s.role, CASE WHEN s.status = 'specified' THEN w.contract END AS contract
  FROM side s LEFT JOIN wanted w ON w.query = s.query AND w.role = s.role),
n_of AS (SELECT step, contract, count(*) AS n FROM port GROUP BY step, contract),
n_all AS (SELECT step, count(*) AS n FROM port GROUP BY step),
counts AS (
  SELECT e.query, e.edge, e.side, e.role, c.candidate, coalesce(CASE WHEN e.contract IS NULL THEN a.n ELSE o.n END, 0) AS n
  FROM endpoint e JOIN cand c ON c.query = e.query AND c.role = e.role
  LEFT JOIN n_of o ON o.step = c.candidate AND o.contract = e.contract LEFT JOIN n_all a ON a.step = c.candidate)"""

ASSIGN = REQ + """,
stop AS (SELECT query, role, candidate, min(n) AS least, sum(ln(greatest(n, 1))) AS cost FROM counts GROUP BY query, role, candidate),
cost AS (SELECT c.query, c.pos, c.n_roles, c.candidate, s.cost FROM cand c JOIN stop s ON s.query = c.query AND s.role = c.role AND s.candidate = c.candidate WHERE s.least > 0),
full_ AS (
  SELECT c0.query, -(c0.cost + c1.cost + coalesce(c2.cost, 0) + coalesce(c3.cost, 0) + coalesce(c4.cost, 0)) AS score, c0.candidate AS p0, c1.candidate AS p1, c2.candidate AS p2, c3.candidate AS p3, c4.candidate AS p4
  FROM (SELECT * FROM cost WHERE pos = 0) c0 JOIN (SELECT * FROM cost WHERE pos = 1) c1 ON c1.query = c0.query
  LEFT JOIN (SELECT * FROM cost WHERE pos = 2) c2 ON c2.query = c0.query LEFT JOIN (SELECT * FROM cost WHERE pos = 3) c3 ON c3.query = c0.query
  LEFT JOIN (SELECT * FROM cost WHERE pos = 4) c4 ON c4.query = c0.query
  WHERE (c0.n_roles < 3 OR c2.candidate IS NOT NULL) AND (c0.n_roles < 4 OR c3.candidate IS NOT NULL) AND (c0.n_roles < 5 OR c4.candidate IS NOT NULL)),
assigned AS (SELECT *, sha256('["' || concat_ws('","', p0, p1, p2, p3, p4) || '"]') AS identity FROM full_),
ranking AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, identity) - 1 AS rank FROM assigned),
ranking_h AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY identity) - 1 AS rank FROM assigned)"""


def tree_hashes(source: str, key: str, fan: int, name: str = "tree", levels: int = 4) -> str:
    """Expressions that end in `name` (key, n, hash): the ordered hash tree of source (key, pos from 0, t)."""
    out = [f"{name}1 AS (SELECT {key}, pos // {fan} AS pos, sha256(string_agg(t, chr(10) ORDER BY pos)) AS t, count(*) AS n FROM {source} GROUP BY {key}, pos // {fan})"]
    for i in range(2, levels + 1):
        out.append(f"""{name}{i} AS (SELECT {key}, pos // {fan} AS pos, CASE WHEN max(size) = 1 THEN max(t) ELSE sha256(string_agg(t, chr(10) ORDER BY pos)) END AS t, CAST(sum(n) AS BIGINT) AS n
    FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS size FROM {name}{i - 1}) x GROUP BY {key}, pos // {fan})""")
    return ", ".join(out) + f", {name} AS (SELECT {key}, n, t AS hash FROM {name}{levels})"
