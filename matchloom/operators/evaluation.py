"""Exported assemblies against their targets: verdicts, one row for every target, summaries.  What fails stays, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCORES = ["chamfer", "part_accuracy", "f_score", "translation", "rotation"]


def manifest_rows(manifests: DataFrame, query: str = "bigint", role: str = "int", candidate: str = "bigint", edge: str = "int", primitive: str = "int") -> tuple[DataFrame, DataFrame]:
    """Manifests (query, manifest: JSON text, sha256) -> their components (query, role, candidate) and connections (query, edge, mobility, support, primitive_a, primitive_b).

    A text that is no such JSON, or has another hash than the one given with it, has no rows.
    """
    kind = (
        f"query {query}, components array<struct<role:{role},candidate:{candidate}>>, "
        f"connections array<struct<edge:{edge},mobility:string,support:string,primitive_a:{primitive},primitive_b:{primitive}>>"
    )
    sound = manifests.where(F.col("sha256") == F.sha2("manifest", 256)).select("query", F.from_json("manifest", kind).alias("m")).where(F.col("m.query") == F.col("query"))
    parts = sound.select("query", F.explode("m.components").alias("c")).select("query", "c.*")
    return parts, sound.select("query", F.explode("m.connections").alias("c")).select("query", "c.*")


def _all_equal(want: DataFrame, got: DataFrame, keys: list[str], values: list[str], name: str) -> DataFrame:
    """query, name: whether both sides have the same keys, with equal values."""
    left = want.select(*keys, *[F.col(v).alias(f"w_{v}") for v in values], F.lit(True).alias("wanted"))
    right = got.select(*keys, *[F.col(v).alias(f"g_{v}") for v in values], F.lit(True).alias("given"))
    fits: Column = F.col("wanted").isNotNull() & F.col("given").isNotNull()
    for v in values:
        fits = fits & F.col(f"w_{v}").eqNullSafe(F.col(f"g_{v}"))
    return left.join(right, keys, "full_outer").groupBy("query").agg(F.bool_and(fits).alias(name))


def program_verdicts(components: DataFrame, connections: DataFrame, checks: DataFrame, target_parts: DataFrame, target_edges: DataFrame) -> DataFrame:
    """query, parts, program, collision_free, executable, exact of every query with target parts.

    components (query, role, candidate) and connections (query, edge, mobility, support, primitive_a, primitive_b) of the exported assemblies; checks (query, collision_free: null if it was not looked at, feasible);
    target_parts and target_edges like them.  parts: the same candidate at every role, no role more or less; program: the same edges, with the same mobility, support and primitives;
    an assembly without a collision check is as free as it is feasible; executable: feasible; exact: all three.  A query that was not exported is false in all.
    """
    parts = _all_equal(target_parts, components, ["query", "role"], ["candidate"], "parts")
    program = _all_equal(target_edges, connections, ["query", "edge"], ["mobility", "support", "primitive_a", "primitive_b"], "program")
    exported = components.select("query").distinct().withColumn("exported", F.lit(True))
    rows = target_parts.select("query").distinct()
    for more in (parts, program, exported, checks.select("query", "collision_free", "feasible")):
        rows = rows.join(more, "query", "left")
    there = F.coalesce("exported", F.lit(False))
    yes = lambda c: there & F.coalesce(c, F.lit(False))
    feasible = yes(F.col("feasible"))
    # a request without edges has the empty program
    out = rows.select("query", yes(F.col("parts")).alias("parts"), (there & F.coalesce("program", F.lit(True))).alias("program"), yes(F.coalesce("collision_free", "feasible")).alias("collision_free"), feasible.alias("executable"))
    return out.withColumn("exact", F.col("parts") & F.col("program") & F.col("executable"))


def method_rows(verdicts: DataFrame, references: DataFrame, scores: DataFrame) -> DataFrame:
    """One row for every verdict: query, status, scoreable, the verdict, and SCORES.

    references (query, status), those that can be measured being `verified`; scores (query and SCORES) of the assemblies that were measured.  status: the reference's, or reference_unavailable, where it
    cannot be measured; method_output_unavailable where the method has no scores; else scored.  Only a scored row has scores.
    """
    rows = verdicts.join(references.select("query", F.col("status").alias("reference")), "query", "left").join(scores.withColumn("measured", F.lit(True)), "query", "left")
    known = F.col("reference").eqNullSafe(F.lit("verified"))
    status = F.when(~known, F.coalesce("reference", F.lit("reference_unavailable"))).when(F.col("measured").isNull(), "method_output_unavailable").otherwise("scored")
    rows = rows.withColumn("status", status).withColumn("scoreable", known)
    return rows.select("query", "status", "scoreable", *verdicts.drop("query").columns, *[F.when(F.col("status") == "scored", F.col(c)).alias(c) for c in SCORES])


def method_summary(rows: DataFrame, worst: float = 100.0) -> DataFrame:
    """One row: queries, evaluable, scored, the rates of every verdict over all queries, chamfer over scored ones, and over all evaluable ones with a failure counting as `worst`."""
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    scored = F.col("status") == "scored"
    bounded = F.when(F.col("scoreable"), F.when(scored, F.least("chamfer", F.lit(worst))).otherwise(worst))
    return rows.agg(
        F.count("*").alias("queries"), F.count_if("scoreable").alias("evaluable"), F.count_if(scored).alias("scored"), *[rate(F.col(c)).alias(f"{c}_rate") for c in ("parts", "program", "collision_free", "executable", "exact")],
        F.avg("chamfer").alias("chamfer"), F.avg(bounded).alias("chamfer_with_failures"), F.avg("f_score").alias("f_score"),
    )


def strict_metrics(beams: DataFrame, targets: DataFrame, edges: DataFrame, programs: DataFrame, said: DataFrame, independent_roles: DataFrame, independent_edges: DataFrame) -> DataFrame:
    """One row over all queries with targets, as rates: what a decoder gets right at every grain, beside what it would without joint decoding.

    beams (query, rank, picks: candidates by role), targets (query, pos, candidate), edges (query, edge, pos_a, pos_b), programs and said (query, edge, mobility, support, a, b: the edge's right program, and that said for
    the first beam), independent_roles (query, pos, candidate), independent_edges (query, edge, a, b: candidates).  role, strict_part (all roles of a query), edge_pair (both ends of an edge), mobility, support, interface (both
    primitives), joint (an edge's pair with its whole program), strict_program (all roles and all edges), recall (any beam has all roles), independent_role, independent_part, independent_edge.  What a decoder says nothing of
    counts as wrong, and edges are judged over all edges, roles over all roles.
    """
    want = targets.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "candidate"))), lambda x: x["candidate"]).alias("goal"))
    hit = beams.join(want, "query").where(F.col("picks") == F.col("goal")).select("query").distinct().withColumn("hit", F.lit(True))
    first = want.join(beams.where("rank = 0").select("query", "picks"), "query", "left").join(hit, "query", "left")
    at = lambda c, i: F.get(c, F.col(i).cast("int"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    role = targets.join(first.select("query", "picks"), "query").select("query", yes(at("picks", "pos") == F.col("candidate")).alias("role"))
    alone = targets.join(independent_roles.select("query", "pos", F.col("candidate").alias("own")), ["query", "pos"], "left").select("query", yes(F.col("own") == F.col("candidate")).alias("own"))
    mine = said.select("query", "edge", *[F.col(c).alias(f"s_{c}") for c in ("mobility", "support", "a", "b")])
    loose = independent_edges.select("query", "edge", F.col("a").alias("i_a"), F.col("b").alias("i_b"))
    rows = edges.join(first.select("query", "picks", "goal"), "query").join(programs, ["query", "edge"], "left").join(mine, ["query", "edge"], "left").join(loose, ["query", "edge"], "left")
    pair = yes((at("picks", "pos_a") == at("goal", "pos_a")) & (at("picks", "pos_b") == at("goal", "pos_b")))
    inter = yes((F.col("a") == F.col("s_a")) & (F.col("b") == F.col("s_b")))
    rows = rows.select(
        "query", pair.alias("edge_pair"), yes(F.col("mobility") == F.col("s_mobility")).alias("mobility"), yes(F.col("support") == F.col("s_support")).alias("support"), inter.alias("interface"),
        yes((F.col("i_a") == at("goal", "pos_a")) & (F.col("i_b") == at("goal", "pos_b"))).alias("independent_edge"),
    ).withColumn("joint", F.col("edge_pair") & F.col("mobility") & F.col("support") & F.col("interface"))
    whole = rows.groupBy("query").agg(F.bool_and("joint").alias("joints"))
    all_alone = alone.groupBy("query").agg(F.bool_and("own").alias("alone"))
    each = first.join(whole, "query", "left").join(all_alone, "query", "left").select(
        yes(F.col("picks") == F.col("goal")).alias("strict_part"), (yes(F.col("picks") == F.col("goal")) & F.coalesce("joints", F.lit(True))).alias("strict_program"), yes(F.col("hit")).alias("recall"), yes(F.col("alone")).alias("independent_part")
    )
    rate = lambda df, *names: df.agg(*[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in names])
    out = each.agg(F.count("*").alias("queries"), *[F.coalesce(F.avg(F.col(c).cast("double")), F.lit(0.0)).alias(c) for c in ("strict_part", "strict_program", "recall", "independent_part")])
    # one row beside one row
    out = out.crossJoin(rate(role, "role")).crossJoin(rate(alone.withColumnRenamed("own", "independent_role"), "independent_role"))
    return out.crossJoin(rate(rows, "edge_pair", "mobility", "support", "interface", "joint", "independent_edge"))
