"""What a query moves: steps that were worked out or dealt more often than they need."""

import random

import __spark_entry__ as entry
from matchloom.functions import vectors as V
from matchloom.operators import geometry
from matchloom.operators import graphs as G
from matchloom.operators import ports as P
from matchloom.operators.ordering import positions
from matchloom.operators.records import model_view_payload
from matchloom.sources.tables import tasks_for
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_views_of_linked_nodes(spark):
    nodes = spark.createDataFrame([(1, 0, "p"), (1, 1, "q"), (1, 2, "p"), (2, 0, "p")], "step long, ordinal int, kind string")
    edges = spark.createDataFrame([(1, 0, 1, 5), (1, 2, 0, 3), (1, 1, 2, 5)], "step long, a int, b int, feature int")
    links = edges.groupBy("step", F.col("a").alias("ordinal")).agg(F.collect_list(F.struct("a", "b", "feature")).alias("links"))
    linked = nodes.join(links, ["step", "ordinal"], "left").withColumn("links", F.coalesce("links", F.array().cast("array<struct<a:int,b:int,feature:int>>")))
    rows = lambda df: sorted(map(tuple, df.select("step", "nodes", "edges", "view").collect()))
    assert rows(G.model_views(linked, None, F.col("kind"))) == rows(G.model_views(nodes, edges, F.col("kind")))


def test_payload_rows_are_worked_out_once(spark):
    graphs = spark.createDataFrame([(1, "v1"), (2, "v2")], "graph long, view string")
    examples = spark.createDataFrame([(7, 1, 2), (8, 1, 3)], "example long, graph_a long, graph_b long")
    kind = "example long, idx int, id string, type string, relation string, descriptor string"
    programs = spark.createDataFrame([(e, i, "", "t", "t", f"d{i}") for e in (7, 8) for i in (0, 1)], kind).withColumn("id", F.concat(F.lit("catalog_"), F.substring(F.sha2("descriptor", 256), 1, 16)))
    one = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    targets = spark.createDataFrame([(e, 0, [1.0, 2.0, 3.0], one) for e in (7, 8)], "example long, idx int, translation array<double>, rotation array<double>")
    rows, payload = model_view_payload(graphs, examples, programs, targets, ["t"])
    assert sorted((r.example, r.reason, r.text is None) for r in rows.collect()) == [(7, "valid", False), (8, "graph", True)]
    assert rows.where("example = 7").first().text.startswith("v1/v2/0:catalog_")
    assert tuple(payload.first())[:3] == (2, 1, 1)
    assert "Join" not in _plan(rows)


def test_positions_with_and_without_few_groups(spark):
    rows = spark.createDataFrame([(k, i % 50) for k in (None, 1, 2) for i in range(200)], "k int, v int").repartition(5)
    for few in (False, True):
        found = positions(rows, ["k"], ["v"], few=few).collect()
        for k in (None, 1, 2):
            mine = sorted((r.position, r.v) for r in found if r.k == k)
            assert [p for p, _ in mine] == list(range(200)) and [v for _, v in mine] == sorted(i % 50 for i in range(200))


def test_frames_of_a_six_move_once(spark):
    assert _plan(entry.queries()["j16_pose_candidates"](spark, SF)).count("Exchange") == 1


def test_contracts_of_a_step_are_one_row(spark):
    found = spark.createDataFrame([(1, 0, "x"), (1, 1, "y"), (1, 2, "x"), (2, 0, "y")], "step long, ordinal int, contract string")
    counted = P.contract_counts(found)
    rows = {r.step: (r.n_all, sorted(map(tuple, r["of"])), r.stated) for r in counted.collect()}
    assert rows == {1: (3, [("x", 2), ("y", 1)], "x"), 2: (1, [("y", 1)], "y")}
    cands = spark.createDataFrame([(9, "a", 1), (9, "a", 2), (9, "a", 3)], "query long, role string, candidate long")
    for contract, want in (("x", [2, 0, 0]), ("y", [1, 1, 0]), (None, [3, 1, 0])):
        ends = spark.createDataFrame([(9, 0, "a", "a", contract)], "query long, edge int, side string, role string, contract string")
        for ports in (found, counted):
            assert [r.n for r in P.match_counts(cands, ends, ports).orderBy("candidate").collect()] == want


def test_tasks_grow_with_rows(spark):
    rows = spark.range(100)
    assert tasks_for(rows) == spark.sparkContext.defaultParallelism and tasks_for(rows, 5) == 20


def test_ports_sort_a_line_twice(spark):
    plan = _plan(entry.queries()["w01_describe_ports"](spark, SF))
    assert (plan.count("Sort ["), plan.count("Exchange")) == (2, 1)


def test_matches_are_counted_where_a_step_lies(spark):
    plan = _plan(entry.queries()["p06_contract_matches"](spark, SF))
    assert (plan.count("Sort ["), plan.count("Exchange"), plan.count("HashAggregate")) == (2, 1, 0)


def test_boxes_of_a_full_cell_are_spread(spark):
    at = random.Random(1)
    # in eighths, so that boxes touch; all of 1 and most of 2 lie in one cell
    corner = lambda wide: [at.randrange(-wide, wide) / 8 for _ in range(3)]
    rows = [(k, i, lo, [x + at.randrange(0, 6) / 8 for x in lo]) for k, wide in ((1, 4), (2, 20)) for i in range(60) for lo in [corner(wide)]]
    rows = [(k, i, [abs(x) for x in lo] if k == 1 else lo, [abs(x) + 0.25 for x in lo] if k == 1 else hi) for k, i, lo, hi in rows]
    boxes = spark.createDataFrame(rows, "assembly int, id int, lo array<double>, hi array<double>")
    want = {}
    for k, a, lo, hi in rows:
        for other, b, low, high in rows:
            sides = [min(x, y) - max(u, v) for x, y, u, v in zip(hi, high, lo, low)]
            if k == other and a < b and min(sides) > 0:
                size = lambda u, v: (v[0] - u[0]) * (v[1] - u[1]) * (v[2] - u[2])
                want[k, a, b] = (sides[0] * sides[1] * sides[2], min(size(lo, hi), size(low, high)))
    for cell in (0.3, 1.0):
        found = geometry.box_overlaps(boxes, cell, block=10, share=100).withColumn("task", F.spark_partition_id()).collect()
        assert len(found) == len(want) and {(r.assembly, r.a, r.b): (r.volume, r.small) for r in found} == want
    assert len({r.task for r in found if r.assembly == 1}) > 4


def test_rounded(spark):
    values = [0.0, 1.25e-7, 0.123456785, 0.5, 2.000000004999, 999999.1, 1e6, 123456789.123456789, 1e20]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", V.rounded(F.col("v"), 8).alias("r")).collect()
    assert [r.r for r in rows] == [0.0, 1.3e-7, 0.12345679, 0.5, 2.0, 999999.1, 1e6, 123456789.12345679, 1e20]


def _plans(query, spark, monkeypatch):
    """Of all tables that a query writes and of what it returns."""
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(_plan(self._df)), write(self, *a, **k)))
    last = _plan(entry.queries()[query](spark, SF))
    return [*plans, last]


def test_losses_join_by_shuffles(spark, monkeypatch):
    plans = _plans("e03_linker_loss", spark, monkeypatch)
    assert len(plans) > 4 and not [p for p in plans if "BroadcastHashJoin" in p]


def test_planned_edges_join_by_shuffles(spark, monkeypatch):
    for query in ("r10_evaluate_planner", "r04_planner_benchmark", "r13_planner_conditioned_protocol"):
        plans = _plans(query, spark, monkeypatch)
        monkeypatch.undo()
        assert len(plans) > 3 and not [p for p in plans if "BroadcastHashJoin" in p]
