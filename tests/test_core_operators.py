"""Operators on small tables written from the rules."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions import ports as P
from matchloom.functions import text as X
from matchloom.functions import vectors as V
from matchloom.operators import assemblies, assignments, decoding, geometry, ports, requests
from matchloom.sources import records
from matchloom.streaming.resume import content_entries, materialize_new


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_feature_tokens_of_short_and_very_long_texts(spark):
    tokens = lambda text: one(spark, X.feature_tokens(F.lit(text).cast("string")))
    assert tokens(None) is None and tokens("") == [] and tokens("A!b") == ["w:a", "w:b", "c3:a_b"]
    assert tokens("Ab, cd") == ["w:ab", "w:cd", "c3:ab_", "c3:b_c", "c3:_cd"]
    # 900,000 characters: a line worked out for each triple would take hours
    long = spark.range(1).select(F.repeat(F.lit("word 12345 "), 90_000).alias("t"))
    assert long.select(F.size(X.feature_tokens(F.col("t"))).alias("n")).first().n == 2 * 90_000 + 11 * 90_000 - 1 - 2


def test_size_classes_with_ties_within_the_tolerance(spark):
    def classes(values):
        kind = "step int, ordinal int, kind string, geometry_type string, measure double, members int"
        table = spark.createDataFrame([(0, i, "face", "plane", v, 1) for i, v in enumerate(values)], kind)
        none = spark.createDataFrame([], "step int, a int, b int, feature int")
        return [r.size_class for r in ports.described_ports(table, none, ["plane"]).orderBy("ordinal").collect()]

    assert classes([1.0]) == ["only"]
    assert classes([1.0, 1.0 + 1e-9]) == ["medium", "medium"]
    assert classes([1.0, 2.0, 3.0, 4.0]) == ["smallest", "medium", "medium", "largest"]
    assert classes([1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0])[1] == "small"


def test_contracts_hold_what_is_adjacent(spark):
    kind = "step int, ordinal int, kind string, geometry_type string, measure double, members int"
    table = spark.createDataFrame([(0, 0, "face", "plane", 1.0, 1), (0, 1, "face", "cylinder", 2.0, 2), (0, 2, "edge", "circle", 3.0, 1)], kind)
    edges = spark.createDataFrame([(0, 0, 1, 0), (0, 0, 2, 0)], "step int, a int, b int, feature int")
    got = {r.ordinal: r.contract for r in ports.described_ports(table, edges, ["plane", "cylinder", "circle"]).collect()}
    assert got == {0: "face|plane|only|cylinder+circle|single", 1: "face|cylinder|only|plane|repeated", 2: "edge|circle|only|plane|single"}


def test_support_families(spark):
    pairs = {("line", "line"): "linear_support", ("circle", "line"): "axial_support", ("plane", "plane"): "planar_support", ("cone", "plane"): "axis_plane_support", ("plane", "torus"): "other"}
    for (a, b), want in pairs.items():
        assert one(spark, P.primitive_support(F.lit(a), F.lit(b))) == want
    assert one(spark, P.decoded_support(F.lit("plane"), F.lit("torus"), F.lit("learned"))) == "learned"
    assert one(spark, P.shape_support(F.lit("SphereSurfaceType"), F.lit("PlaneSurfaceType"))) == "point_frame_support"
    assert one(spark, P.other_mobilities(F.lit("fixed"))) == ["revolute", "prismatic", "cylindrical"]
    assert len(one(spark, P.other_mobilities(F.lit("ball")))) == 6


def test_strict_json_and_names(spark):
    good = lambda t: one(spark, X.strict_object(F.lit(t)).isNotNull())
    assert good('{"a": 1}') and not any(map(good, ['{"a":1,"a":2}', '{"a":NaN}', "[1]", "", "{"]))
    assert one(spark, X.safe_name(F.lit("__a b//c.."))) == "a_b_c" and one(spark, X.safe_name(F.lit("é"))) == "assembly"
    assert one(spark, X.names_identity(F.lit("Use candidate ID 7."))) and not one(spark, X.names_identity(F.lit("Use the shaft.")))
    assert one(spark, X.sentences(F.lit(" One two.  Three!\nFour"))) == ["One two.", "Three!", "Four"]


def test_poses(spark):
    p = V.pose(F.lit(30.0), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    unit = one(spark, V.multiplied(p, V.inverse(p)))
    assert all(abs(x - (i % 5 == 0)) < 1e-12 for i, x in enumerate(unit))
    assert one(spark, V.pose_status(p)) == "valid"
    assert abs(one(spark, V.rotation_angle(p, V.pose(F.lit(75.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)))) - 0.7853981) < 1e-6
    assert one(spark, V.canonical_direction(F.array(F.lit(0.0), F.lit(-2.0), F.lit(1.0))))[1] > 0


def test_missing_features_give_no_match(spark):
    candidates = spark.createDataFrame([(1, "a", c, p, 2) for c, p in ((10, 0), (11, 0))] + [(1, "b", 12, 1, 2), (1, "b", 13, 1, 2)], "query int, role string, candidate int, pos int, n_roles int")
    found = spark.createDataFrame([(10, "face|cylinder"), (11, "face|box"), (12, "face|box"), (12, "face|box")], "step int, contract string")
    ends = spark.createDataFrame([(1, 0, "a", "a", "face|cylinder"), (1, 0, "b", "b", None)], "query int, edge int, side string, role string, contract string")
    counts = ports.match_counts(candidates, ends, found)
    assert {(r.candidate, r.n) for r in counts.collect()} == {(10, 1), (11, 0), (12, 2), (13, 0)}
    got = assignments.feasible_assignments(assignments.endpoint_costs(candidates, counts)).collect()
    assert [r.picks for r in got] == [[10, 12]] and abs(got[0].score + 0.6931471805599453) < 1e-12
    none = assignments.feasible_assignments(assignments.endpoint_costs(candidates, counts.withColumn("n", F.lit(0))))
    assert {r.status for r in assignments.predictions(candidates, assignments.ranked(none)).collect()} == {"no_candidate"}


def test_beam_ties_go_to_the_lesser_picks(spark):
    unary = spark.createDataFrame([(1, p, 2, c, 5) for p in (0, 1) for c in (1, 2)], "query int, pos int, n_roles int, candidate int, score long")
    pairs = spark.createDataFrame([(1, 0, 0, 1, a, b, 0) for a in (1, 2) for b in (1, 2) if (a, b) != (1, 1)], "query int, edge int, pos_a int, pos_b int, a int, b int, score long")
    got = decoding.beam_decode(unary, pairs, beam=2).orderBy("picks").collect()
    assert [r.picks for r in got] == [[1, 2], [2, 1]]


def test_touching_boxes_do_not_overlap(spark):
    rows = [(1, i, [float(x), 0.0, 0.0], [x + 10.0, 10.0, 10.0]) for i, x in enumerate((0, 10, -10, 5))]
    boxes = spark.createDataFrame(rows, "assembly int, id int, lo array<double>, hi array<double>")
    for cell in (3.0, 10.0, 100.0):
        got = geometry.box_overlaps(boxes, cell).collect()
        assert {(r.a, r.b, r.volume) for r in got} == {(0, 3, 500.0), (1, 3, 500.0)}


def test_missing_predictions_stay_in_the_denominator(spark):
    kind = "query int, lo string, hi string, value int"
    want = spark.createDataFrame([(1, "a", "b", 0), (2, "a", "b", 0)], kind)
    got = requests.evaluated_edges(want, spark.createDataFrame([(1, "a", "b", 0)], kind)).first()
    assert (got.queries, got.precision, got.recall, got.exact) == (2, 1.0, 0.5, 0.5)
    none = requests.evaluated_edges(want, spark.createDataFrame([], kind)).first()
    assert (none.queries, none.recall, none.f1) == (2, 0.0, 0.0)


def test_connected(spark):
    roles = spark.createDataFrame([(q, p) for q in (1, 2) for p in range(4)] + [(3, p) for p in range(12)] + [(4, 0)], "query int, role int")
    rows = [(1, 3, 2), (1, 1, 2), (1, 0, 3), (2, 0, 1), (2, 2, 3)] + [(3, p, p + 1) for p in range(11)]
    edges = spark.createDataFrame([(q, i, a, b) for i, (q, a, b) in enumerate(rows)], "query int, edge int, role_a int, role_b int")
    assert {r.query: r.connected for r in requests.connected(roles, edges).collect()} == {1: True, 2: False, 3: True, 4: True}


def test_walks_go_by_role_then_edge(spark):
    roles = spark.createDataFrame([(1, r) for r in "dcbae"], "query int, role string")
    edges = spark.createDataFrame([(1, "e3", "a", "c"), (1, "e1", "b", "a"), (1, "e2", "a", "b"), (1, "e4", "c", "b"), (1, "e5", "d", "c"), (1, "e6", "e", "e")], "query int, edge string, role_a string, role_b string")
    got = assemblies.graph_walk(roles, edges).first()
    assert got.order == ["a", "b", "c", "d"] and not got.connected
    assert [(t.parent, t.child, t.edge) for t in got.tree] == [("a", "b", "e1"), ("a", "c", "e3"), ("c", "d", "e5")]
    assert got.closing == ["e2", "e4", "e6"]


def _request(spark, n, edges, seed):
    """A request of n roles with three candidates each, and match counts of some of them."""
    rng = random.Random(seed)
    kinds = ["query int, role string, pos int, n_roles int, candidate int", "query int, edge int, side string, role string, candidate int, n int"]
    rows = [(1, f"r{p:02d}", p, n, 10 * p + c) for p in range(n) for c in range(2 if n > 9 else 3)]
    counts = [(1, e, s, f"r{p:02d}", c, rng.choice([1, 2, 3] if c % 10 != 1 else [0, 1, 2, 3])) for e, ends in enumerate(edges) for s, p in zip("ab", ends, strict=True) for _, _, q, _, c in rows if q == p]
    return [spark.createDataFrame(x, k) for x, k in zip((rows, counts), kinds, strict=True)], rows, counts


@pytest.mark.parametrize("n,edges", [(6, [(i, i + 1) for i in range(5)]), (9, [((i - 1) // 2, i) for i in range(1, 9)]), (12, [(0, i) for i in range(1, 11)] + [(3, 4)])])
def test_assignments_of_many_roles_and_any_graph(spark, n, edges):
    (candidates, counts), rows, flat = _request(spark, n, edges, n)
    ready = assignments.endpoint_costs(candidates, counts)
    of = {}
    for _, e, s, r, c, k in flat:
        of.setdefault(c, []).append(k)
    pools = [[c for _, _, p, _, c in rows if p == pos and 0 not in of.get(c, [])] for pos in range(n)]
    want = {pick: -sum(math.log(k) for c in pick for k in of.get(c, [])) for pick in itertools.product(*pools)}
    assert want
    got = {tuple(r.picks): r.score for r in assignments.feasible_assignments(ready).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    full = [(r.rank, r.picks) for r in assignments.ranked(assignments.feasible_assignments(ready)).orderBy("rank").collect()]
    assert full == [(r.rank, r.picks) for r in assignments.ranked(assignments.best_assignments(ready)).orderBy("rank").collect()]
    each = assignments.feasible_counts(candidates, ready).first()
    assert (each.raw, each.feasible) == (math.prod(len([1 for r in rows if r[2] == p]) for p in range(n)), len(want))


def test_beam_over_any_graph(spark):
    """Seven roles, with edges that skip roles and lead back: a wide beam finds the best of all assignments."""
    rng, n = random.Random(4), 7
    edges = [(0, 3), (5, 1), (2, 6), (6, 0), (4, 5)]
    rows = [(1, p, n, c, rng.randrange(100)) for p in range(n) for c in range(2)]
    pairs = [(1, e, a, b, x, y, rng.randrange(100)) for e, (a, b) in enumerate(edges) for x in range(2) for y in range(2) if rng.random() < 0.8]
    unary = spark.createDataFrame(rows, "query int, pos int, n_roles int, candidate int, score long")
    table = spark.createDataFrame(pairs, "query int, edge int, pos_a int, pos_b int, a int, b int, score long")
    score = {(p, c): s for _, p, _, c, s in rows}
    joint = {(e, x, y): s for _, e, _, _, x, y, s in pairs}
    want = []
    for pick in itertools.product(range(2), repeat=n):
        ends = [joint.get((e, pick[a], pick[b])) for e, (a, b) in enumerate(edges)]
        if None not in ends:
            want.append((-sum(ends) - sum(score[p, c] for p, c in enumerate(pick)), list(pick)))
    got = sorted((-r.score, r.picks) for r in decoding.beam_decode(unary, table, beam=1000).collect())
    assert want and got == sorted(want)


_POSE = "query int, edge string, hypothesis_rank int, candidate_a int, candidate_b int, accepted boolean, pose_rank int, pose array<double>"


def _assembly(spark, poses, edges=(("e1", "a", "b"), ("e2", "a", "c"))):
    """Three boxes of 10 mm; poses {edge: shifts along x}."""
    at = {"a": 1, "b": 2, "c": 3}
    roles = spark.createDataFrame([(1, r) for r in at], "query int, role string")
    table = spark.createDataFrame([(1, *e) for e in edges], "query int, edge string, role_a string, role_b string")
    picks = spark.createDataFrame([(1, r, c) for r, c in at.items()], "query int, role string, candidate int")
    move = lambda x: [1.0, 0, 0, x, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
    rows = [(1, e, 0, at[a], at[b], True, i, [float(v) for v in move(x)]) for e, a, b in edges for i, x in enumerate(poses.get(e, []))]
    verdicts, options = assemblies.accepted_options(table, picks, spark.createDataFrame(rows, _POSE))
    boxes = spark.createDataFrame([(1, r, [0.0] * 3, [10.0] * 3) for r in at], "query int, role string, lo array<double>, hi array<double>")
    return verdicts, options, assemblies.graph_walk(roles, table), table, boxes, picks


@pytest.mark.parametrize("shifts,status,pruned", [((10, -10), "accepted_global_assembly", 0), ((10, 10), "rejected_no_collision_free_global_pose", 1)])
def test_pose_search_of_three_boxes(spark, shifts, status, pruned):
    verdicts, options, walk, edges, boxes, _ = _assembly(spark, {"e1": [shifts[0]], "e2": [shifts[1]]})
    out, found = assemblies.pose_search(walk, options, boxes)
    got = out.first()
    assert (got.status, got.collision_pruned, got.truncated) == (status, pruned, 0)
    audit = assemblies.assembly_audit(walk, verdicts, options, edges, boxes).first()
    assert (audit.status, audit.pairs, audit.collisions) == (("accepted_global_assembly", 3, 0) if not pruned else ("rejected_global_collision", 3, 1))
    assert found.count() == (0 if pruned else 1)


def test_pose_search_takes_the_second_option_and_keeps_its_budget(spark):
    verdicts, options, walk, edges, boxes, picks = _assembly(spark, {"e1": [10], "e2": [10, -10, -10, -20]})
    out, found = assemblies.pose_search(walk, options, boxes)
    assert out.first().status == "accepted_global_assembly"
    assert [(c.edge, c.option, c.pose_rank) for c in found.first().chosen] == [("e1", 0, 0), ("e2", 1, 1)]
    programs = spark.createDataFrame([(1, e, "revolute", "axial_support", 0, 1) for e in ("e1", "e2")], "query int, edge string, mobility string, support string, primitive_a int, primitive_b int")
    chosen = found.select("query", F.explode("chosen").alias("c")).select("query", "c.edge", "c.pose_rank")
    evidence = assemblies.connection_evidence(edges, programs, options, chosen)
    assert {(r.edge, r.pose_rank, r.pose[3], r.status) for r in evidence.collect()} == {("e1", 0, 10.0, "complete"), ("e2", 1, -10.0, "complete")}
    manifest = assemblies.assembly_manifests(out, found, picks, evidence).first()
    assert (manifest.status, manifest.anchor, manifest.components, manifest.connections) == ("exported", "a", 3, 2) and len(manifest.sha256) == 64
    part = assemblies.assembly_manifests(out, found, picks, assemblies.connection_evidence(edges, programs.where("edge = 'e1'"), options, chosen)).first()
    assert (part.status, part.manifest) == ("incomplete_evidence", None)
    # one state may stay: the choice that would have worked is cut off, and the result says so
    few, none = assemblies.pose_search(assemblies.graph_walk(*_four(spark)[:2]), *_four(spark)[2:], budget=1)
    assert (few.first().status, few.first().truncated, none.count()) == ("unknown_bounded_no_global_pose", 1, 0)


def _four(spark):
    """Box b may stand to the right or left of a, and c only where b would be if it stood to the right."""
    _, options, _, edges, boxes, _ = _assembly(spark, {"e1": [10, -10], "e2": [10]})
    return spark.createDataFrame([(1, r) for r in "abc"], "query int, role string"), edges, options, boxes


def test_pose_search_needs_every_edge_and_closes_cycles(spark):
    verdicts, *_ = _assembly(spark, {"e1": [10]})
    assert (verdicts.first().status, verdicts.first().accepted) == ("unknown_incomplete_pair_execution", 1)
    ring = (("e1", "a", "b"), ("e2", "a", "c"), ("e3", "b", "c"))
    for last, status, pruned in ((-20, "accepted_global_assembly", 0), (-30, "rejected_no_cycle_consistent_global_pose", 1)):
        verdicts, options, walk, edges, boxes, _ = _assembly(spark, {"e1": [10], "e2": [-10], "e3": [last]}, ring)
        got = assemblies.pose_search(walk, options, boxes)[0].first()
        assert (got.status, got.closure_pruned, got.closure_edges) == (status, pruned, 1)
        audit = assemblies.assembly_audit(walk, verdicts, options, edges, boxes).first()
        assert audit.status == ("accepted_global_assembly" if not pruned else "unknown_pose_graph_closure_failure")


def test_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x")
    files = records.read_files(spark, str(tmp_path)).withColumn("declared", F.when(F.lit(True), F.sha2("content", 256)))
    assert [r.status for r in records.verified(files).collect()] == ["ok"]
    assert [r.status for r in records.verified(files.withColumn("path", F.lit("a/../b"))).collect()] == ["path"]


def test_a_second_run_takes_only_what_is_new(spark, tmp_path):
    source, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    add = lambda v: spark.createDataFrame([(v,)], "content binary").write.mode("append").parquet(source)
    add(bytearray(b"a"))
    add(None)
    run = lambda: materialize_new(spark, source, spark.read.parquet(source).schema, out, progress, content_entries)
    assert (run(), run()) == (2, 0)
    add(bytearray(b"b"))
    assert run() == 1
    assert sorted(r.status for r in spark.read.parquet(out).collect()) == ["entry", "entry", "excluded"]
