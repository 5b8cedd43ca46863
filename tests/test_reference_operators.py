"""Operators on small tables with known answers: ordering, sockets, records, losses, evaluation, planner, symmetries, batches."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from matchloom.operators import evaluation as E
from matchloom.operators import geometry as G
from matchloom.operators import graphs
from matchloom.operators import losses as L
from matchloom.operators import ordering as O
from matchloom.operators import planner as P
from matchloom.operators import records as K
from matchloom.operators import requests as R
from matchloom.operators import schedules as D
from matchloom.operators import sockets as S
from matchloom.operators import symmetries as Y
from matchloom.functions import text as X
from matchloom.streaming.batches import run_batches


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def rows(df, *order):
    return sorted(tuple(r) for r in df.collect())


# ordering


def test_positions_of_groups_with_ties(spark):
    rng = random.Random(1)
    data = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 3)) for _ in range(500)]
    got = O.positions(spark.createDataFrame(data, "k string, v int").repartition(7), ["k"], ["v"]).collect()
    for k in ("a", "b", None):
        mine = sorted((r.position, r.v) for r in got if r.k == k)
        assert [p for p, _ in mine] == list(range(len(mine)))
        assert [v for _, v in mine] == sorted(v for x, v in data if x == k)
    assert O.positions(spark.createDataFrame([], "k string, v int"), ["k"], ["v"]).collect() == []


@pytest.mark.parametrize("linear", [False, True])
def test_quantiles_are_exact(spark, linear):
    """One value makes up a third of a group, one group most of all rows; empty groups have none."""
    rng = random.Random(2)
    data = [("big", float(rng.choice([7, 7, rng.randint(0, 1000)]))) for _ in range(900)] + [("one", 4.0), ("none", None)] + [("two", x) for x in (1.0, 2.0, None)]
    got = {r[0]: tuple(r)[1:] for r in O.quantiles(spark.createDataFrame(data, "k string, v double").repartition(6), ["k"], "v", {"p0": 0.0, "p33": 0.33, "p95": 0.95, "p100": 1.0}, linear).collect()}

    def want(values, p):
        values = sorted(values)
        if not values:
            return None
        if not linear:
            return values[max(0, math.ceil(p * len(values)) - 1)]
        at = p * (len(values) - 1)
        low = int(at)
        return values[low] + (at - low) * (values[min(low + 1, len(values) - 1)] - values[low])

    for k in ("big", "one", "none", "two"):
        values = [v for x, v in data if x == k and v is not None]
        assert got[k] == pytest.approx(tuple(want(values, p) for p in (0, 0.33, 0.95, 1.0)))


def test_ordered_hashes_are_a_tree(spark):
    texts = {"long": [f"t{i:03}" for i in range(70)], "short": ["x", "y"]}
    table = spark.createDataFrame([(k, t) for k, v in texts.items() for t in reversed(v)], "k string, t string").repartition(5)
    got = {r.k: (r.n, r.hash) for r in O.ordered_hashes(table, ["k"], ["t"], F.col("t"), fan=8).collect()}

    def tree(values):
        level = [sha("\n".join(values[i : i + 8])) for i in range(0, len(values), 8)]
        while len(level) > 1:
            level = [sha("\n".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        return level[0]

    assert got == {k: (len(v), tree(v)) for k, v in texts.items()}
    assert got["short"][1] == sha("x\ny")
    assert O.ordered_hashes(table.limit(0), [], ["t"], F.col("t")).collect() == []


# geometry


def test_nearest_distances_of_clusters_outliers_and_copies(spark):
    rng = random.Random(3)
    near = [("k", i, [rng.gauss(0, 0.001), rng.gauss(0, 0.001), 0.0]) for i in range(150)]
    far = [("k", 1000 + i, [rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(-50, 50)]) for i in range(40)]
    target = [("k", [rng.gauss(0, 0.001), rng.gauss(0, 0.001), 0.0]) for _ in range(200)] + [("k", [9.0, 9.0, 9.0])] * 30 + [("one", [1.0, 1.0, 1.0])]
    source = [*near, *far, ("one", 1, [1.0, 1.0, 1.0]), ("one", 2, [4.0, 5.0, 1.0]), ("lost", 1, [0.0, 0.0, 0.0])]
    got = G.nearest_distances(spark.createDataFrame(source, "key string, id int, p array<double>"), spark.createDataFrame(target, "key string, p array<double>"), leaf=8)
    want = {(k, i): min(math.dist(p, q) for x, q in target if x == k) for k, i, p in source if k != "lost"}
    assert {(r.key, r.id): r.distance for r in got.collect()} == pytest.approx(want)


def test_axial_offsets(spark):
    data = [(1, [0.0] * 3, [2.0] * 3, [5.0, 0.0, 0.0], [6.0, 1.0, 1.0], [2.0, 0.0, 0.0]), (2, [0.0] * 3, [0.0] * 3, [-1e-6, 0.0, 0.0], [-1e-6, 0.0, 0.0], [1.0, 0.0, 0.0])]
    table = spark.createDataFrame(data, "id int, lo_a array<double>, hi_a array<double>, lo_b array<double>, hi_b array<double>, axis array<double>")
    got = [(i, t, round(o, 9)) for i, t, o in rows(G.axial_offsets(table, ["id"]))]
    # the second box already touches: the seat before it is where it lies
    assert got == [(1, 0, 0.0), (1, 1, -6.000001), (1, 2, -2.999999), (2, 0, 0.0), (2, 1, 2e-06)]


# sockets

FACE = "part int, face long, surface_type string, center array<double>, normal array<double>, axis array<double>, extents array<double>, area double, radius double, concavity int, edge_count long, helical boolean, thread_hint boolean, non_mating boolean"
Z, XX = [0.0, 0.0, 1.0], [1.0, 0.0, 0.0]


def plate(part=1):
    """A plate of 40 x 20 x 12 (so thick that its sides fall into different clusters) with four holes through it, a threaded one, a pin at its side, and faces that make no sockets."""
    flat = lambda i, c, n, x, a, **k: (part, i, k.get("t", "plane"), c, n, None, x, a, None, 1, k.get("e", 4), k.get("h", False), False, k.get("off", False))
    tube = lambda i, c, r, a, conc, e=2, hint=False, axis=Z: (part, i, "cylinder", c, None, axis, None, a, r, conc, e, False, hint, False)
    return [
        flat(0, [0.0, 0.0, 6.0], Z, [40.0, 20.0, 0.0], 800.0), flat(1, [0.0, 0.0, -6.0], Z, [40.0, 20.0, 0.0], 780.0), flat(2, [20.0, 0.0, 0.0], XX, [0.0, 20.0, 12.0], 40.0),
        flat(3, [-20.0, 0.0, 0.0], XX, [0.0, 20.0, 12.0], 40.0), flat(4, [0.0, 10.0, 0.0], [0.0, 1.0, 0.0], [40.0, 0.0, 12.0], 1.0), flat(5, [0.0, 5.0, 0.0], Z, [1.0, 1.0, 0.0], 700.0, e=30), flat(6, [0.0, 6.0, 0.0], None, [1.0, 1.0, 0.0], 700.0),
        tube(10, [15.0, 7.0, 0.0], 2.0, 25.0, -1), tube(11, [-15.0, 7.0, 0.0], 2.0, 25.0, -1), tube(12, [15.0, -7.0, 0.0], 2.0, 25.0, -1), tube(13, [-15.0, -7.0, 0.0], 2.0, 25.0, -1),
        tube(14, [0.0, 0.0, 0.0], 3.0, 37.0, -1, hint=True), tube(15, [25.0, 0.0, 0.0], 1.0, 62.8, 1, axis=XX), tube(16, [5.0, 5.0, 0.0], 0.01, 9.0, -1),
        tube(17, [15.05, 7.0, 0.0], 2.05, 24.0, -1),
    ]


@pytest.mark.parametrize("intrinsic", [False, True])
def test_extracted_sockets_of_a_plate(spark, intrinsic):
    found, frames = S.extracted_sockets(spark.createDataFrame(plate() + plate(2), FACE), intrinsic=intrinsic)
    names = {(r.part, r.name): r for r in found.collect()}
    one = {n: r for (p, n), r in names.items() if p == 1}
    flat = {n: r.face for n, r in one.items() if r.kind == "plane"}
    # the largest of the planes; the small one is under 1.2 % of it, one has too many edges, one no normal
    assert flat == {"base_plane": 0, "plane_00": 1, "plane_01": 2, "plane_02": 3}
    # the fifth hole is like the first, the thin one under the least radius; a cluster's cell knows how far a hole is from the middle, not on which side, and the box's middle lies towards the pin
    holes = {10, 11, 12, 13} if intrinsic else {10, 11}
    assert {r.face for r in one.values() if r.kind == "hole"} == holes
    assert one["threaded_hole_00"].face == 14 and not one["threaded_hole_00"].mates and one["pin_00"].face == 15
    # both large planes have all holes along them, the threaded one too
    assert [one[n].face for n in ("flange_plane_00", "flange_plane_01")] == [0, 1]
    assert one["flange_plane_00"].quality == pytest.approx(one["base_plane"].quality + 0.35 * (len(holes) + 1))
    slots = {n for n in one if n.startswith("guide_slot")}  # no two planes are three times as long as wide
    assert not slots
    # enough sockets mate, so there are no stand-ins
    assert not {"axis_00", "proxy_plane_00"} & set(one)
    of = {n: {r.frame for r in frames.collect() if r.part == 1 and r.name == n} for n in ("base_plane", "hole_00", "pin_00")}
    assert of["base_plane"] == {"primary", "support"}
    assert of["hole_00"] == {"primary", *(n for n, _ in S.END_FRAMES + S.HOLE_FRAMES)} and of["pin_00"] == {"primary", *(n for n, _ in S.END_FRAMES + S.PIN_FRAMES)}


def test_extracted_slots_and_stand_ins(spark):
    flat = lambda i, z, a: (1, i, "plane", [0.0, 0.0, z], Z, None, [30.0, 6.0, 0.0], a, None, 1, 4, False, False, False)
    spline = (2, 9, "bspline", [0.0, 0.0, 0.0], Z, None, [9.0, 1.0, 1.0], 5.0, None, 1, 4, False, False, False)
    found, _ = S.extracted_sockets(spark.createDataFrame([flat(0, 0.0, 180.0), flat(1, 4.0, 170.0), spline], FACE))
    one = {r.name: r for r in found.where("part = 1").collect()}
    slot = one["guide_slot_00"]
    assert (slot.face, slot.other, slot.origin, slot.axis) == (0, 1, [0.0, 0.0, 2.0], XX)
    assert slot.quality == pytest.approx(math.log1p(350) + 0.7 * 5 - 0.25 * 4 / 6)
    # two planes and a slot are three mating sockets: an axis and two ends stand in
    assert one["axis_00"].origin == [0.0, 0.0, 2.0] and one["proxy_plane_01"].origin == [15.0, 0.0, 2.0]
    assert {r.name for r in found.where("part = 2").collect()} == {"axis_00", "proxy_plane_00", "proxy_plane_01"}
    assert S.extracted_sockets(spark.createDataFrame([], FACE))[0].collect() == []


def test_intrinsic_frames_do_not_turn(spark):
    turn = lambda v: None if v is None else [(v[0] - v[1]) / 2**0.5, (v[0] + v[1]) / 2**0.5, v[2]]
    turned = [(2, f[1], f[2], turn(f[3]), turn(f[4]), turn(f[5]), f[6], *f[7:]) for f in plate()]
    found, _ = S.extracted_sockets(spark.createDataFrame(plate() + turned, FACE), S.ExtractionRules(stand_ins=False), intrinsic=True)
    both = {p: {r.name: (r.face, round(r.quality, 9)) for r in found.where(f"part = {p}").collect()} for p in (1, 2)}
    assert both[1] == both[2]


def test_flange_planes_count_directions_of_either_sign(spark):
    tilt = lambda d: [math.sin(math.radians(d)), 0.0, math.cos(math.radians(d))]
    planes = spark.createDataFrame([(1, 1, Z, 1.0), (1, 2, [0.0, 0.0, -2.0], 2.0), (1, 3, XX, 1.0), (2, 4, Z, 1.0)], "part int, face int, normal array<double>, score double")
    holes = spark.createDataFrame([(1, Z), (1, [0.0, 0.0, -1.0]), (1, tilt(16.0)), (1, tilt(16.5)), (2, Z)], "part int, axis array<double>")
    assert rows(S.flange_planes(planes, holes)) == [(1, 1, 3, 2.05), (1, 2, 3, 3.05)]


def test_guide_slots_and_suppression_and_world_sockets(spark):
    sockets = spark.createDataFrame(
        [(1, "hole", i, [float(x), 0.0, 0.0], Z, None, r, s) for i, x, r, s in ((0, 0, 2.0, 5.0), (1, 0, 2.05, 4.0), (2, 0, 3.0, 3.0), (3, 9, 2.0, 3.0), (4, 20, 2.0, 1.0))],
        "part int, kind string, id int, origin array<double>, axis array<double>, normal array<double>, radius double, score double",
    )
    parts = spark.createDataFrame([(1, 10.0)], "part int, diagonal double")
    assert rows(S.suppressed(sockets, parts, 3)) == [(1, "hole", 0, 0), (1, "hole", 2, 1), (1, "hole", 3, 2)]
    turn = [0.0, -1.0, 0.0, 5.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    bound = sockets.where("id = 3").select("part", "id", "origin", F.array(*map(F.lit, [1.0, 0.0, 0.0])).alias("axis"), "normal", "radius", F.lit("r").alias("radius_param"), F.lit(0.5).alias("radius_scale"))
    instances = spark.createDataFrame([(7, 1, turn, {"r": 8.0}), (8, 1, turn, {})], "instance int, part int, pose array<double>, params map<string, double>")
    assert rows(S.world_sockets(bound, instances)) == [(7, 3, [5.0, 9.0, 0.0], [0.0, 1.0, 0.0], None, 4.0), (8, 3, [5.0, 9.0, 0.0], [0.0, 1.0, 0.0], None, 2.0)]


def test_guide_slots_of_planes_with_one_side(spark):
    plane = lambda part, face, y, extents: (part, face, 10.0 - face, [0.0, 0.0, y], Z, extents)
    thin, wide = [0.2, 0.001, 0.001], [0.4, 0.2, 0.001]
    planes = spark.createDataFrame(
        [plane(1, 0, 0.0, thin), plane(1, 1, 0.1, thin), plane(2, 0, 0.0, wide), plane(2, 1, 0.1, wide)],
        "part int, face int, area double, center array<double>, normal array<double>, extents array<double>",
    )
    parts = spark.createDataFrame([(1, 0.5), (2, 0.5)], "part int, diagonal double")
    assert rows(S.guide_slots(planes, parts, S.SlotRules(parallel=0.8, gap=0.01, least_aspect=1.2)).select("part", "a", "b", F.round("aspect", 6))) == [(2, 0, 1, 2.0)]


# graphs


def test_steps_in_a_row_and_by_joins_are_alike(spark, monkeypatch):
    rng = random.Random(4)
    nodes = spark.createDataFrame([(s, i, rng.choice("pqr"), rng.choice("xy")) for s in range(12) for i in range(s + 1)], "step int, ordinal int, kind string, label string")
    # loops, repeated edges and steps without any
    links = [(s, rng.randint(0, s), rng.randint(0, s), rng.randint(0, 1)) for s in range(11) for _ in range(rng.randint(0, 2 * s))]
    edges = spark.createDataFrame(links, "step int, a int, b int, feature int")
    first = nodes.where("ordinal = 0").select("step", "ordinal")

    def found():
        shells = graphs.endpoint_shells(edges, first, most_hops=2, most_faces=5, most_edges=6)
        return [rows(x) for x in (graphs.face_order(nodes, edges, ["kind"]), graphs.refined(nodes, edges), shells)]

    whole = found()
    assert [len(x) for x in whole] == [78, 78, 12]
    monkeypatch.setattr(graphs, "ROW_NODES", 4)
    monkeypatch.setattr(graphs, "ROW_EDGES", 3)
    assert found() == whole


def test_face_order_shells_and_intrinsic_graph(spark):
    nodes = spark.createDataFrame([(1, i, "p" if i else "c") for i in range(5)], "step int, ordinal int, kind string")
    edges = spark.createDataFrame([(1, a, a + 1, 1) for a in range(4)], "step int, a int, b int, feature int")
    order = {r.ordinal: r.place for r in graphs.face_order(nodes, edges, ["kind"]).collect()}
    assert order[0] == 0 and sorted(order.values()) == [0, 1, 2, 3, 4]
    shells = graphs.endpoint_shells(edges, nodes.where("ordinal = 0").select("step", "ordinal"), most_hops=2).first()
    assert (shells.faces, shells.taken_faces, shells.taken_edges, shells.radius, shells.reason, shells.omitted_faces) == (5, 3, 2, 2, "max_hop_radius", 2)
    faces = spark.createDataFrame([(1, 0, 3.0, 8.0, 0.5, None, 1, 4), (1, 1, 1.0, 4.0, 0.0, 0.0, 1, 4)], "part int, face int, area double, perimeter double, mean_curvature double, gaussian_curvature double, wires int, edges int")
    got, links = graphs.intrinsic_graph(faces, spark.createDataFrame([(1, 1, 0, 2.0, 0.6), (1, 1, 7, 1.0, 0.0)], "part int, a int, b int, length double, cosine double"))
    assert [(r.area_fraction, r.perimeter, r.curvature_known) for r in got.orderBy("face").collect()] == [(0.75, 4.0, False), (0.25, 2.0, True)]
    link = links.collect()
    assert len(link) == 1 and (link[0].source, link[0].target, link[0].length) == (0, 1, 1.0) and link[0].sine == pytest.approx(0.8)


# records


def ledger(spark):
    queries = spark.createDataFrame([(1,), (2,)], "query int")
    hypotheses = spark.createDataFrame([(1, 1, -2, "b"), (1, 0, -1, "a")], "query int, rank int, score int, identity string")
    programs = spark.createDataFrame([(1, 0, 0, "fixed"), (1, 0, 1, "ball")], "query int, rank int, edge int, mobility string")
    alternatives = spark.createDataFrame([(1, 0, 1, 1, 5, 6), (1, 0, 1, 0, 3, 4)], "query int, rank int, edge int, place int, a int, b int")
    return K.prediction_ledger(queries, hypotheses, programs, alternatives)


def test_prediction_ledger(spark):
    one, two = ledger(spark).orderBy("query").collect()
    assert one.status == "prediction_ready" and [h["rank"] for h in one.hypotheses] == [0, 1]
    assert [(p["edge"], [(a["a"], a["b"]) for a in p["alternatives"]]) for p in one.hypotheses[0]["programs"]] == [(0, []), (1, [(3, 4), (5, 6)])]
    assert one.row_text == "=1|=prediction_ready\n=0|=-1|=a[=0|=fixed();=1|=ball(=0|=3|=4;=1|=5|=6)];=1|=-2|=b[]"
    assert (two.status, two.hypotheses, two.row_sha256) == ("no_candidate", [], sha("=2|=no_candidate\n"))
    payload = K.ledger_payload(ledger(spark), {"b": "2", "a": "1"}).first()
    assert tuple(payload) == (2, sha("a=1\nb=2\n2\n" + sha(f"1:{one.row_sha256}\n2:{two.row_sha256}")))
    assert K.ledger_payload(ledger(spark).limit(0), {}).first().queries == 0


def test_ledger_faults(spark):
    good = ledger(spark)
    assert K.ledger_faults(good).collect() == []
    changed = F.transform("hypotheses", lambda h: h.withField("score", h["score"] - 1))
    assert rows(K.ledger_faults(good.withColumn("hypotheses", changed))) == [(1, "text")]
    assert rows(K.ledger_faults(good.withColumn("row_sha256", F.lit("0")))) == [(1, "hash"), (2, "hash")]
    assert rows(K.ledger_faults(good.withColumn("status", F.lit("no_candidate")))) == [(1, "status")]


def test_batch_progress_is_bound_to_its_items(spark):
    items = spark.createDataFrame([(i, f"t{i}", i == 5 or None if i == 7 else i == 5) for i in range(10)], "id int, text string, failed boolean")
    bound = K.item_binding(items, ["id"]).first()
    snapshot = spark.createDataFrame([(bound.input_sha256, 10, 4, 0), ("other", 10, 4, 1), (bound.input_sha256, 10, 5, 1)], "input_sha256 string, items long, size int, batch long")
    assert rows(K.batch_progress(items, ["id"], 4, snapshot)) == [(0, 4, 0, True, "resumed"), (1, 4, 2, False, "run"), (2, 2, 0, True, "run")]


def test_face_bindings(spark):
    faces = spark.createDataFrame([(1, 3, "s3"), (1, 1, "s1"), (1, 3, "s9"), (1, -1, "x"), (1, 2, None)], "part int, face int, signature string")
    assert rows(K.face_bindings(faces, "faces", "g")) == [(1, 2, sha("faces\0g\x002\0" + sha("1:s1\n3:s3")))]


def test_example_reasons(spark):
    def program(example, idx, descriptor="d", kind="a", relation="a", wrong=False):
        return (example, idx, "catalog_" + sha("x" if wrong else descriptor)[:16], kind, descriptor, relation)

    same = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    mirror = [-1.0, *same[1:]]
    programs, targets = [], []
    for e in ("valid", "target", "translation", "rotation", "rotation2", "nan"):
        programs += [program(e, 0, "d0"), program(e, 1, "d1")]
        targets.append((e, 7 if e == "target" else 1, [0.0, 0.0] if e == "translation" else [0.0] * 3, {"rotation": mirror, "rotation2": [2.0, *same[1:]], "nan": [float("nan"), *same[1:]]}.get(e, same)))
    programs += [program("too_few", 0), program("index", 0, "d0"), program("index", 0, "d1"), program("type", 0, "d0", "zz"), program("type", 1, "d1"), program("relation", 0, "d0", "a", "b"), program("relation", 1, "d1")]
    programs += [program("id", 0, "d0", wrong=True), program("id", 1, "d1"), program("twin", 0, "d0"), program("twin", 1, "d0")]
    got = dict(rows(K.example_reasons(spark.createDataFrame(programs, "example string, idx int, id string, type string, descriptor string, relation string"), spark.createDataFrame(targets, "example string, idx int, translation array<double>, rotation array<double>"), ["a", "b"])))
    want = {e: e for e in ("valid", "too_few", "index", "type", "id", "twin", "target", "translation", "rotation")} | {"relation": "type", "rotation2": "rotation", "nan": "rotation"}
    assert got == want


def test_model_view_payload(spark):
    same = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    graphs = spark.createDataFrame([(1, "v1"), (2, "v2")], "graph int, view string")
    examples = spark.createDataFrame([("x", 1, 2), ("y", 1, 3), ("z", 1, 2)], "example string, graph_a int, graph_b int")
    programs = spark.createDataFrame([(e, i, "catalog_" + sha(f"d{i}")[:16], "a", f"d{i}", "a") for e in "xyz" for i in (1, 0) if (e, i) != ("z", 1)], "example string, idx int, id string, type string, descriptor string, relation string")
    targets = spark.createDataFrame([(e, 0, [0.0, -0.0, 0.5], same) for e in "xyz"], "example string, idx int, translation array<double>, rotation array<double>")
    out, payload = K.model_view_payload(graphs, examples, programs, targets, ["a"])
    got = {r.example: r for r in out.collect()}
    assert {e: r.reason for e, r in got.items()} == {"x": "valid", "y": "graph", "z": "too_few"}
    ids = [f"{i}:catalog_{sha(f'd{i}')[:16]}:a:d{i}" for i in (0, 1)]
    number = lambda v: ",".join(f"{x + 0.0:.12f}" for x in v)
    assert got["x"].text == f"v1/v2/{ids[0]};{ids[1]}/0|{number([0.0, 0.0, 0.5])}|{number(same)}"
    one = payload.first()
    assert (one.graphs, one.examples, one.refused, one.sha256) == (2, 1, 2, sha(f"2\n{sha('1:v1' + chr(10) + '2:v2')}\n1\n{sha(got['x'].text)}"))
    turned = graphs.orderBy(F.desc("graph"))
    assert K.model_view_payload(turned, examples, programs.orderBy("idx"), targets, ["a"])[1].first() == one
    assert K.model_view_payload(turned.withColumn("view", F.upper("view")), examples, programs, targets, ["a"])[1].first() != one


def test_commitments_and_projection(spark):
    lib = spark.createDataFrame([("a", 0, 1, "x"), ("a", 1, 2, "y"), ("b", 0, 3, "z"), ("c", 0, 4, "w")], "case string, place int, id int, sha string")
    said = spark.createDataFrame([("a", 0, 1, "x"), ("a", 1, 2, "y"), ("b", 0, 9, "z"), ("c", 1, 4, "w")], "case string, place int, id int, sha string")
    cases = spark.createDataFrame([("a", "train", 2), ("b", "train", 1), ("c", "dev", 1), ("d", "dev", 0)], "case string, split string, row_count int")
    each, totals = K.semantic_commitments(lib, said, cases)
    assert rows(each) == [("a", "train", 2, 0, 0, 0, True), ("b", "train", 1, 0, 0, 1, False), ("c", "dev", 1, 1, 1, 0, False), ("d", "dev", 0, 0, 0, 0, True)]
    assert rows(totals) == [("dev", 1, 0), ("train", 1, 2)]
    docs = spark.createDataFrame([("a", 1), ("a", 0), ("b", 0), ("t", 0)], "case string, ordinal int")
    assigned = spark.createDataFrame([("a", "train"), ("b", "dev"), ("t", "test")], "case string, split string")
    out, receipts = K.authority_projection(docs, assigned, F.sha2(F.concat_ws("/", "case", "ordinal"), 256), ["train", "dev"])
    assert [r[:4] for r in rows(out)] == [("dev", 0, "b", 0), ("train", 0, "a", 0), ("train", 1, "a", 1)]
    assert K.projection_faults(out, receipts, ["train", "dev"]).collect() == []
    assert rows(K.projection_faults(out.where("case <> 'a' or ordinal = 1"), receipts, ["train", "dev"])) == [("train", "gap")]
    assert rows(K.projection_faults(out.withColumn("hash", F.upper("hash")), receipts, ["train"])) == [("dev", "held_out"), ("train", "receipt")]
    with pytest.raises(ValueError):
        K.catalog_candidates(docs, docs, most=3)


def test_scope_fault(spark):
    texts = ['{"open": false, "x": {"a": 1}}', '{"open": true}', '{"a": 1}', '{"open": false, "x": [{"y": {"target": 1}}]}', '{"open": false, "my_target": 1, "t": "target: x"}', "{", None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.scope_fault(F.col("t"), ["open"], ["target"]))
    assert [x for _, x in rows(got)] == [None, "flag", "flag", "field", None, "not_json", "not_json"]


# losses


def test_linker_loss(spark):
    s = lambda rows_: spark.createDataFrame(rows_, "query int, unit int, choice int, score double")
    t = lambda rows_: spark.createDataFrame(rows_, "query int, unit int, choice int")
    unary = spark.createDataFrame([(1, 0, 0, 900.0, True), (1, 0, 1, 901.0, True), (1, 0, 2, 5000.0, False), (2, 0, 0, 1.0, False), (2, 0, 1, 1.0, True), (3, 0, 0, float("nan"), True)], "query int, unit int, choice int, score double, available boolean")
    parts = {
        "unary": (unary, t([(1, 0, 0), (2, 0, 0), (3, 0, 0)])), "pair": (s([(1, 5, 0, 0.0), (1, 5, 1, 0.0)]), t([(1, 5, 1)])), "mobility": (s([(1, 5, 0, 0.0), (1, 5, 1, 0.0)]), t([(1, 5, 1)])),
        "interface": (s([(1, 5, 0, 1.0), (1, 5, 1, 1.0)]), t([(1, 5, 0), (1, 6, 9)])), "proposal": (s([(1, 5, 0, 1.0)]), t([(1, 5, 4)])),
    }
    margins = spark.createDataFrame([(1, 0, 3.0, 3.0)], "query int, unit int, positive double, negative double")
    one, two, three = L.linker_loss(parts, margins).orderBy("query").collect()
    soft, half = math.log1p(math.e), math.log(2)
    assert one.unary == pytest.approx(math.log(1 + math.e)) and (one.pair, one.mobility, one.interface, one.structured) == pytest.approx((half, half, half, soft))
    assert (one.support, one.proposal) == (0.0, 0.0) and one.loss == pytest.approx(math.log(1 + math.e) + 2 * half + 0.5 * half + 0.25 * soft)
    assert (two.status, two.loss, three.status) == ("target_unavailable", None, "not_finite")
    assert L.linker_loss(parts, margins, spark.createDataFrame([(1,)], "query int")).where("query = 1").first().mobility == 0.0


# evaluation


def test_program_verdicts_and_method(spark):
    parts = spark.createDataFrame([(q, r, r) for q in (1, 2, 3, 4) for r in (0, 1)], "query long, role int, candidate long")
    edges = spark.createDataFrame([(q, 0, "fixed", "s", 0, 1) for q in (1, 2, 3, 4)], "query long, edge int, mobility string, support string, primitive_a int, primitive_b int")
    wrong = edges.where("query <> 4").withColumn("mobility", F.when(F.col("query") == 2, "ball").otherwise(F.col("mobility")))
    made = parts.where("query < 3").unionByName(parts.where("query = 3 and role = 0"))
    checks = spark.createDataFrame([(1, None, True), (2, False, True), (3, True, False)], "query long, collision_free boolean, feasible boolean")
    got = E.program_verdicts(made, wrong, checks, parts, edges)
    assert rows(got) == [(1, True, True, True, True, True), (2, True, False, False, True, False), (3, False, True, True, False, False), (4, False, False, False, False, False)]
    references = spark.createDataFrame([(1, "verified"), (2, "verified"), (3, "failed")], "query long, status string")
    scores = spark.createDataFrame([(1, 150.0, 1.0, 0.5, 1.0, 2.0), (3, 1.0, 1.0, 0.5, 1.0, 2.0)], "query long, chamfer double, part_accuracy double, f_score double, translation double, rotation double")
    judged = E.method_rows(got, references, scores)
    assert [(r[0], r[1]) for r in rows(judged)] == [(1, "scored"), (2, "method_output_unavailable"), (3, "failed"), (4, "reference_unavailable")]
    total = E.method_summary(judged).first()
    assert (total.queries, total.evaluable, total.scored, total.program_rate, total.exact_rate, total.chamfer, total.chamfer_with_failures) == (4, 2, 1, 0.5, 0.25, 150.0, 100.0)


def test_manifest_rows_check_the_hash(spark):
    text = '{"query":1,"components":[{"role":0,"candidate":5}],"connections":[{"edge":2,"mobility":"fixed","support":"s","primitive_a":0,"primitive_b":1}]}'
    table = spark.createDataFrame([(1, text, sha(text)), (2, text, sha(text)), (1, text, "0"), (3, None, None)], "query long, manifest string, sha256 string")
    parts, joins = E.manifest_rows(table)
    assert rows(parts) == [(1, 0, 5)] and rows(joins) == [(1, 2, "fixed", "s", 0, 1)]


def test_strict_metrics(spark):
    beams = spark.createDataFrame([(1, 0, [10, 21]), (1, 1, [10, 20]), (2, 0, [30, 40])], "query int, rank int, picks array<long>")
    targets = spark.createDataFrame([(1, 0, 10), (1, 1, 20), (2, 0, 30), (2, 1, 40), (3, 0, 50), (3, 1, 60)], "query int, pos int, candidate long")
    edges = spark.createDataFrame([(q, 0, 0, 1) for q in (1, 2, 3)], "query int, edge int, pos_a int, pos_b int")
    program = spark.createDataFrame([(q, 0, "fixed", "s", 0, 0) for q in (1, 2, 3)], "query int, edge int, mobility string, support string, a int, b int")
    alone = spark.createDataFrame([(1, 0, 10), (1, 1, 20), (2, 0, 30)], "query int, pos int, candidate long")
    pairs = spark.createDataFrame([(1, 0, 10, 20)], "query int, edge int, a long, b long")
    got = E.strict_metrics(beams, targets, edges, program, program.where("query < 3"), alone, pairs).first().asDict()
    third = pytest.approx(1 / 3)
    assert (got["queries"], got["role"], got["independent_role"]) == (3, 0.5, 0.5)
    assert all(got[c] == third for c in ("strict_part", "strict_program", "edge_pair", "joint", "independent_part", "independent_edge"))
    assert got["recall"] == pytest.approx(2 / 3) == got["mobility"] == got["support"] == got["interface"]


# planner


def planned(spark):
    return spark.createDataFrame(
        [(1, 0, "x", "y", "specified", "fixed", "a|b", "c|d", "own 0"), (1, 1, "y", "z", "unknown", "ball", "a|b", None, "own 1"), (2, 0, "x", "y", "maybe", "fixed", "a", "b", "own"), (2, 1, "x", "z", "specified", "fixed", None, "b", "own"), (3, 0, "x", "y", "unknown", "welded", None, None, "own")],
        "query int, edge int, role_a string, role_b string, status string, mobility string, port_a string, port_b string, instruction string",
    )


def test_planner_targets_inputs_and_variants(spark):
    got = {(r.query, r.edge): r for r in P.target_connections(planned(spark), ["fixed", "ball"]).collect()}
    assert [got[k].reason for k in sorted(got)] == ["ok", "ok", "status", "port", "mobility"]
    assert (got[1, 0].port_a, got[1, 1].port_a, got[3, 0].mobility) == ("a|b", None, None)
    inputs, targets = P.planner_benchmark(planned(spark).where("query = 1"), "train", F.array(*[F.concat(F.lit(f"{i} "), "role_a") for i in range(6)]))
    variant = int(sha("train:1:0"), 16) % 6
    assert [r.instruction for r in inputs.orderBy("edge").collect()] == [f"{variant} x", "own 1"]
    assert [(r.variant, r.port_a) for r in targets.orderBy("edge").collect()] == [(variant, "a|b"), (None, None)]


def test_planner_responses_and_rates(spark):
    items = planned(spark).where("query = 1")
    cols = ["query", "edge", "role_a", "role_b", "status", "port_a", "port_b", "mobility"]
    right = items.select(*cols).withColumn("port_a", F.when(F.col("status") == "specified", F.col("port_a")))
    reason = lambda df: dict((r.edge, r.reason) for r in P.planner_response_reasons(items, df, ["fixed", "ball"]).collect())
    assert reason(right) == {0: "valid", 1: "valid"}
    assert reason(right.where("edge = 0").unionByName(right.where("edge = 0"))) == {0: "twice", 1: "missing"}
    assert reason(right.withColumn("role_a", F.lit("q")).withColumn("edge", F.col("edge") + 1)) == {0: "missing", 1: "role", 2: "extra"}
    assert reason(right.withColumn("status", F.lit("specified"))) == {0: "valid", 1: "port"}
    assert reason(right.withColumn("mobility", F.lit("welded"))) == {0: "mobility", 1: "mobility"}
    rates, fields = P.evaluated_planner(right, right.where("edge = 0").withColumn("port_b", F.lit("c|x")))
    one = rates.first()
    assert (one.edges, one.status, one.mobility, one.ports, one.edge, one.queries, one.query) == (2, 0.5, 0.5, 0.0, 0.0, 1, 0.0)
    assert {r.field: (r.sides, r.equal) for r in fields.collect()}["geometry_type"] == (2, 1)


@pytest.mark.parametrize("mode,texts", [("canonical", ["x-y-fixed-a|b", "own 1"]), ("natural", ["own 0", "own 1"])])
def test_planner_conditioned(spark, mode, texts):
    edges = planned(spark).where("query = 1")
    said = edges.select("query", "edge", "status", "port_a", "port_b", F.when(F.col("edge") == 0, "fixed").alias("mobility"))
    plain = F.concat_ws("-", "role_a", "role_b", "mobility")
    got = P.planner_conditioned(edges, edges, said, ["fixed"], plain, F.concat_ws("-", plain, "port_a"), mode).orderBy("edge").collect()
    assert [r.instruction for r in got] == texts and [(r.status, r.port_a, r.mobility, r.source) for r in got] == [("specified", "a|b", "fixed", "specified"), ("unknown", None, "unknown", "unknown")]
    assert P.planner_conditioned(edges, edges, said.limit(0), ["fixed"], plain, plain, mode).where("source = 'missing' and mobility = 'unknown'").count() == 2
    with pytest.raises(ValueError):
        P.planner_conditioned(edges, edges, said, [], plain, plain, "other")


def test_samples_and_supervision(spark):
    labels = spark.createDataFrame([(1, 0, "a", 1, "mapped_x"), (1, 0, "b", 2, "mapped_y"), (1, 1, "a", 0, "mapped_x"), (1, 1, "b", None, "lost")], "query int, edge int, side string, target int, status string")
    parts = spark.createDataFrame([(1, 0, "a", 5), (1, 0, "b", 5), (1, 1, "a", 6), (1, 1, "b", 5)], "query int, edge int, side string, step int")
    prim = spark.createDataFrame([(5, 1, "p"), (5, 0, "q")], "step int, ordinal int, kind string")
    got = R.endpoint_samples(labels, parts, prim, ["kind"]).collect()
    assert [(r.side, r.target, [tuple(p) for p in r.primitives]) for r in got] == [("a", 1, [(0, "q"), (1, "p")])]
    assert R.supervision_summary(labels).first().asDict() == {"queries": 1, "endpoints": 4, "edges": 2, "mapped_edges": 1, "statuses": {"lost": 1, "mapped_x": 2, "mapped_y": 1}}


# schedules and symmetries


@pytest.mark.parametrize("large", [False, True])
def test_schedule_is_a_permutation(spark, large):
    got = D.schedule(spark.range(30).select(F.col("id").alias("query")), 7, large).collect()
    lists = {r: (big if large else small) for (r, _, _, small), big in zip(D.ROLES, D.LARGE_FAMILIES)}
    orders = set()
    for q in range(30):
        for role, families in lists.items():
            mine = [r.family for r in sorted(got, key=lambda r: r.place) if r.query == q and r.role == role]
            assert sorted(mine) == sorted(families)
            orders.add((role, tuple(mine)))
        assert {r.seed for r in got if r.query == q} == {sha(f"7:query:{q}")[:16]}
    assert len(orders) > 40
    ids = D.schedule_ids(D.schedule(spark.range(30).select(F.col("id").alias("query")), 7, large)).collect()
    assert len({r.query_id for r in ids}) == 30 and all(r.query_id.startswith("proc_") and len(r.query_id) == 25 for r in ids)


def test_symmetries_are_closed(spark):
    c, s = math.cos(1.0), math.sin(1.0)
    quarter, half, odd = [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0], [1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0], [c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0]
    cube = [0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    table = spark.createDataFrame([("d4", quarter), ("d4", half), ("cube", quarter), ("cube", cube), ("odd", odd), ("bad", None)], "part string, rotation array<double>")
    got = Y.closed_symmetries(table)
    assert rows(got.groupBy("part", "closed").count()) == [("cube", True, 24), ("d4", True, 8), ("odd", False, 2)]


def test_pose_errors_do_not_count_symmetries(spark):
    pose = lambda a, x: [math.cos(a), -math.sin(a), 0.0, x, math.sin(a), math.cos(a), 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    kind = "query int, role int, part string, pose array<double>"
    reference = spark.createDataFrame([(1, 0, "d4", pose(0.2, 0.0)), (1, 1, "plain", pose(0.0, 0.0)), (1, 2, "d4", pose(0.0, 0.0))], kind)
    predicted = spark.createDataFrame([(1, 0, "d4", pose(0.2 + math.pi / 2 + 0.01, 3.0)), (1, 1, "plain", pose(math.pi / 2, 1.0)), (1, 2, "other", pose(0.0, 0.0))], kind)
    quarter = spark.createDataFrame([("d4", [0.0, -1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0])], "part string, rotation array<double>")
    errors = Y.pose_errors(predicted, reference, Y.closed_symmetries(quarter))
    assert [(r[1], round(r[2], 6), round(r[3], 4)) for r in rows(errors)] == [(0, 3.0, round(math.degrees(0.01), 4)), (1, 1.0, 90.0)]
    mean = Y.pose_error_means(errors, reference, spark.createDataFrame([(1, 50.0)], "query int, diagonal double")).first()
    assert (mean.parts, mean.matching, mean.translation_pct) == (3, 2, 4.0)


# batches


def test_batches_resume_and_isolate(spark, tmp_path):
    items = spark.createDataFrame([(i, "x" if i in (3, 7) else str(i)) for i in range(11)], "id int, text string")
    work = lambda df: df.select("item", F.col("text").cast("int").alias("value"))
    folder = str(tmp_path / "run")
    got = run_batches(items, ["id"], work, folder, 4)
    assert rows(got) == [(0, 4, 1, False), (1, 4, 1, False), (2, 3, 0, True)]
    assert rows(spark.read.parquet(f"{folder}/results").select("value")) == [(i,) for i in range(11) if i not in (3, 7)]
    errors = spark.read.parquet(f"{folder}/errors").orderBy("item").collect()
    assert [(r.item, r.batch) for r in errors] == [(3, 0), (7, 1)] and all("CAST_INVALID_INPUT" in r.message for r in errors)
    with pytest.raises(ValueError, match="resume"):
        run_batches(items, ["id"], work, folder, 4)
    with pytest.raises(ValueError, match="bound"):
        run_batches(items.withColumn("text", F.lit("1")), ["id"], work, folder, 4, resume=True)
    before = spark.read.parquet(f"{folder}/results").inputFiles()
    run_batches(items, ["id"], work, folder, 4, resume=True)
    assert sorted(spark.read.parquet(f"{folder}/results").inputFiles()) == sorted(before)
