"""The language planner's tables: inputs apart from targets, responses checked and judged, requests that carry what was predicted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.sources.tables import shuffled

VARIANTS = 6
FIELDS = ["kind", "geometry_type", "size_class", "adjacent", "symmetry"]


def hash_variant(split: Column, query: Column, edge: Column) -> Column:
    """SHA-256(`split:query:edge`) as a number, modulo six."""
    digest = F.sha2(F.concat_ws(":", split, query.cast("string"), edge.cast("string")), 256)
    digits = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.instr(F.lit("0123456789abcdef"), F.substring(digest, i, F.lit(1))) - 1)
    # 16 to any power above 0 is 4 modulo 6
    return F.pmod(F.aggregate(digits, F.lit(0).cast("long"), lambda a, x: a + 4 * x) - 3 * F.element_at(digits, 64), F.lit(VARIANTS)).cast("int")


def target_connections(edges: DataFrame, mobilities: list[str]) -> DataFrame:
    """query, edge, status, mobility, port_a, port_b, reason of edges (query, edge, status, mobility, port_a, port_b: contract keys or null).

    reason: status (neither specified nor unknown), port (specified without both ports), mobility (unknown name), else ok.  Only ok rows keep their mobility, and specified ones their ports.
    """
    known = F.coalesce(F.col("status").isin("specified", "unknown"), F.lit(False))
    bare = (F.col("status") == "specified") & (F.col("port_a").isNull() | F.col("port_b").isNull())
    reason = F.when(~known, "status").when(bare, "port").when(~F.coalesce(F.col("mobility").isin(mobilities), F.lit(False)), "mobility").otherwise("ok")
    out = edges.withColumn("reason", reason)
    fine = F.col("reason") == "ok"
    port = lambda c: F.when(fine & (F.col("status") == "specified"), F.col(c)).alias(c)
    return out.select("query", "edge", "status", F.when(fine, F.col("mobility")).alias("mobility"), port("port_a"), port("port_b"), "reason")


def planner_benchmark(edges: DataFrame, split: str, texts: Column) -> tuple[DataFrame, DataFrame]:
    """Edges (query, edge, role_a, role_b, status, mobility, port_a, port_b, instruction) -> inputs (query, edge, role_a, role_b, instruction) and targets (query, edge, role_a, role_b, status, port_a, port_b, mobility, variant).

    A specified edge is said by one of six texts (an array column), by the hash of split, query and edge; an unknown one keeps its own instruction, and its target has no ports.
    """
    rows = edges.withColumn("variant", hash_variant(F.lit(split), F.col("query"), F.col("edge")))
    said = F.when(F.col("status") == "specified", F.get(texts, F.col("variant"))).otherwise(F.col("instruction"))
    port = lambda c: F.when(F.col("status") == "specified", F.col(c)).alias(c)
    inputs = rows.select("query", "edge", "role_a", "role_b", said.alias("instruction"))
    return inputs, rows.select("query", "edge", "role_a", "role_b", "status", port("port_a"), port("port_b"), "mobility", F.when(F.col("status") == "specified", F.col("variant")).alias("variant"))


def planner_response_reasons(items: DataFrame, response: DataFrame, mobilities: list[str]) -> DataFrame:
    """query, edge, reason of every edge asked for or answered: missing, extra, twice, role (other ones than asked), status, port (specified without both, or unknown with one), mobility (an unknown name, null is none), else valid.

    items (query, edge, role_a, role_b), response (these, status, port_a, port_b, mobility).
    """
    asked = items.select("query", "edge", F.col("role_a").alias("want_a"), F.col("role_b").alias("want_b"), F.lit(True).alias("asked"))
    times = response.groupBy("query", "edge").agg(F.count("*").alias("times"), *[F.min(c).alias(c) for c in ("role_a", "role_b", "status", "port_a", "port_b", "mobility")])
    both = asked.join(times, ["query", "edge"], "full_outer")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    ports = F.when(F.col("status") == "specified", F.col("port_a").isNotNull() & F.col("port_b").isNotNull()).otherwise(F.col("port_a").isNull() & F.col("port_b").isNull())
    reason = (
        F.when(F.col("times").isNull(), "missing").when(F.col("asked").isNull(), "extra").when(F.col("times") > 1, "twice")
        .when(no((F.col("role_a") == F.col("want_a")) & (F.col("role_b") == F.col("want_b"))), "role").when(no(F.col("status").isin("specified", "unknown")), "status")
        .when(~ports, "port").when(F.col("mobility").isNotNull() & ~F.col("mobility").isin(mobilities), "mobility").otherwise("valid")
    )
    return both.select("query", "edge", reason.alias("reason"))


def evaluated_planner(targets: DataFrame, predictions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(One row of rates: edges, queries, status, mobility, ports (over specified targets), edge (all of them), query (all its edges); one row of each port field: field, sides, equal.)

    targets and predictions (query, edge, status, mobility, port_a, port_b: contract keys, five fields with | between).  Edges without a prediction are wrong in everything.
    """
    got = predictions.select("query", "edge", *[F.col(c).alias(f"g_{c}") for c in ("status", "mobility", "port_a", "port_b")])
    both = shuffled(targets.select("query", "edge", "status", "mobility", "port_a", "port_b")).join(got, ["query", "edge"], "left")
    same = lambda c: F.coalesce(F.col(c) == F.col(f"g_{c}"), F.lit(False))
    open_ = F.col("status") != "specified"
    rows = both.withColumns({"s": same("status"), "m": same("mobility"), "p": same("port_a") & same("port_b"), "open": open_})
    rows = rows.withColumn("e", F.col("s") & F.col("m") & (F.col("open") | F.col("p")))
    each = rows.groupBy("query").agg(F.bool_and("e").alias("q"))
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    out = rows.agg(F.count("*").alias("edges"), rate(F.col("s")).alias("status"), rate(F.col("m")).alias("mobility"), rate(F.when(~F.col("open"), F.col("p"))).alias("ports"), rate(F.col("e")).alias("edge"))
    # one row beside one row
    out = out.crossJoin(each.agg(F.count("*").alias("queries"), rate(F.col("q")).alias("query")))
    sides = rows.where(~F.col("open")).select(F.explode(F.array(*[F.struct(F.split(F.col(c), r"\|").alias("w"), F.split(F.col(f"g_{c}"), r"\|").alias("g")) for c in ("port_a", "port_b")])).alias("x"))
    fields = sides.select(F.posexplode(F.array(*[F.coalesce(F.get("x.w", F.lit(i)) == F.get("x.g", F.lit(i)), F.lit(False)) for i in range(len(FIELDS))])).alias("i", "same"))
    name = F.element_at(F.array(*map(F.lit, FIELDS)), F.col("i") + 1)
    return out, fields.groupBy(name.alias("field")).agg(F.count("*").alias("sides"), F.count_if("same").alias("equal"))


def planner_conditioned(edges: DataFrame, inputs: DataFrame, predictions: DataFrame, mobilities: list[str], mobility_text: Column, port_text: Column, mode: str = "canonical") -> DataFrame:
    """query, edge, role_a, role_b, status, port_a, port_b, mobility, instruction, source: requests whose ports, mobility and text are what a planner predicted of them.

    A prediction that is specified gives both ports, every other edge is unknown and has none; a mobility outside the list is `unknown`.  In natural mode the input's text stays.  In canonical mode an edge with a known mobility is said anew: by
    `port_text` if it is specified, else by `mobility_text` (columns over role_a, role_b, mobility, port_a, port_b); one without keeps the input's text.  source: specified, unknown (predicted so), missing.
    """
    if mode not in ("canonical", "natural"):
        raise ValueError(f"mode is canonical or natural: {mode}")
    said = predictions.select("query", "edge", F.col("status").alias("given"), "port_a", "port_b", F.col("mobility").alias("said"))
    rows = shuffled(edges.select("query", "edge", "role_a", "role_b")).join(said, ["query", "edge"], "left")
    rows = shuffled(rows).join(inputs.select("query", "edge", F.col("instruction").alias("natural")), ["query", "edge"], "left")
    full = F.coalesce(F.col("given") == "specified", F.lit(False))
    known = F.coalesce(F.col("said").isin(mobilities), F.lit(False))
    rows = rows.withColumns({"status": F.when(full, "specified").otherwise("unknown"), "port_a": F.when(full, F.col("port_a")), "port_b": F.when(full, F.col("port_b")), "mobility": F.when(known, F.col("said")).otherwise("unknown")})
    text = F.col("natural") if mode == "natural" else F.when(known & full, port_text).when(known, mobility_text).otherwise(F.col("natural"))
    source = F.when(F.col("given").isNull(), "missing").when(full, "specified").otherwise("unknown")
    return rows.select("query", "edge", "role_a", "role_b", "status", "port_a", "port_b", "mobility", text.alias("instruction"), source.alias("source"))


def replayed_joints(sources: DataFrame, rules: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """Source joints (id and what the rules read) -> (accepted rows, excluded rows with their reason): the first rule that holds excludes a joint; a rule that is null does not hold."""
    reason = F.coalesce(*[F.when(rule, F.lit(name)) for name, rule in rules], F.lit("accepted"))
    rows = sources.withColumn("reason", reason)
    return rows.where("reason = 'accepted'").drop("reason"), rows.where("reason <> 'accepted'")
