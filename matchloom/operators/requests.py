"""Request graphs: roles, connections, supervision and their evaluation.  Rows that fail stay, with a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .assemblies import graph_walk


def role_status(roles: DataFrame) -> DataFrame:
    """query, roles, status of (query, role): empty_role, duplicate_role, too_few, else ok."""
    name = F.trim(F.coalesce("role", F.lit("")))
    out = roles.groupBy("query").agg(F.count("*").alias("roles"), F.count_distinct(name).alias("names"), F.count_if(name == "").alias("empty"))
    status = F.when(F.col("empty") > 0, "empty_role").when(F.col("names") < F.col("roles"), "duplicate_role").when(F.col("roles") < 2, "too_few").otherwise("ok")
    return out.select("query", "roles", status.alias("status"))


def connected(roles: DataFrame, edges: DataFrame) -> DataFrame:
    """query, connected: whether all roles (query, role) of a query hang together by edges (query, edge, role_a, role_b)."""
    return graph_walk(roles, edges).select("query", "connected")


def graph_response_reasons(roles: DataFrame, said_roles: DataFrame, said: DataFrame, mobilities: list[str]) -> DataFrame:
    """query, reason: the first rule that a response (said_roles: query, role; said: query, edge, role_a, role_b, mobility) breaks against the roles asked for.

    coverage: there is none; roles: its set of roles is another; mobility: an unknown name; connectivity: its roles do not hang together; else valid.
    """
    both = roles.select("query", "role", F.lit(1).alias("w")).join(said_roles.select("query", "role", F.lit(1).alias("g")).distinct(), ["query", "role"], "full_outer")
    per = both.groupBy("query").agg(F.count("g").alias("given"), F.count_if(F.col("w").isNull() | F.col("g").isNull()).alias("differ"))
    wrong = said.groupBy("query").agg(F.count_if(~F.coalesce(F.col("mobility").isin(mobilities), F.lit(False))).alias("wrong"))
    reason = (
        F.when(F.col("given") == 0, "coverage").when(F.col("differ") > 0, "roles").when(F.coalesce("wrong", F.lit(0)) > 0, "mobility")
        .when(~F.coalesce("connected", F.lit(False)), "connectivity").otherwise("valid")
    )
    return per.join(wrong, "query", "left").join(connected(roles, said), "query", "left").select("query", reason.alias("reason"))


def edge_supervision(sides: DataFrame) -> DataFrame:
    """query, edge, a, b of edges both of whose sides (query, edge, side, target) are mapped."""
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("target")))
    return sides.groupBy("query", "edge").agg(pick("a").alias("a"), pick("b").alias("b")).where("a is not null and b is not null")


def evaluated_edges(want: DataFrame, got: DataFrame) -> DataFrame:
    """One row over (query, lo, hi, value): edge precision, recall and F1, exact queries, and the share of equal values on matched
    edges.  A query without a prediction counts as wrong in every rate."""
    both = want.withColumnRenamed("value", "w").join(got.withColumnRenamed("value", "g"), ["query", "lo", "hi"], "full_outer")
    matched = F.col("w").isNotNull() & F.col("g").isNotNull()
    each = both.groupBy("query").agg(
        F.count_if(matched).alias("shared"), F.count_if(F.col("w").isNotNull()).alias("wanted"), F.count_if(F.col("g").isNotNull()).alias("given"), F.count_if(matched & (F.col("w") == F.col("g"))).alias("equal")
    )
    known = each.where("wanted > 0")
    out = known.agg(
        F.count("*").alias("queries"), F.try_divide(F.sum("shared"), F.sum("given")).alias("precision"), F.try_divide(F.sum("shared"), F.sum("wanted")).alias("recall"),
        F.avg(((F.col("shared") == F.col("wanted")) & (F.col("given") == F.col("wanted"))).cast("double")).alias("exact"), F.try_divide(F.sum("equal"), F.sum("shared")).alias("value_rate"),
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def conditioned(edges: DataFrame, predicted: DataFrame) -> DataFrame:
    """Edges with the predicted instruction in place of their own, or status missing."""
    return edges.join(predicted.select("query", "edge", F.col("instruction").alias("given")), ["query", "edge"], "left").select(
        "query", F.concat(F.lit("edge_"), F.lpad(F.col("edge").cast("string"), 2, "0")).alias("edge_id"), F.when(F.col("given").isNull(), "missing").otherwise("predicted").alias("status"), "given"
    )


def replaced(edges: DataFrame, others: DataFrame) -> DataFrame:
    """Edges (query, edge, mobility) with the mobility of their counterfactual, where they have one."""
    return edges.join(others.select("query", "edge", F.col("mobility").alias("other")), ["query", "edge"], "left").select(
        "query", "edge", F.coalesce("other", "mobility").alias("mobility"), F.col("other").isNotNull().alias("changed")
    )


def whole_requests(edges: DataFrame) -> DataFrame:
    """query, text, edges, pairs, unique: an edge's instructions (query, edge, instruction, lo, hi) in order as one request."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("edge", "instruction"))), lambda x: x["instruction"])
    out = edges.groupBy("query").agg(F.array_join(ordered, " ").alias("text"), F.count("*").alias("edges"), F.count_distinct(F.struct("lo", "hi")).alias("pairs"))
    return out.withColumn("unique", F.col("edges") == F.col("pairs"))


def first_rows(rows: DataFrame, by: str, order: list) -> DataFrame:
    """The first row of each group in an order that names every tie."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("turn = 1").drop("turn")


def two_pass(requests: DataFrame, graph: DataFrame, parsed: DataFrame, sentences: Column) -> DataFrame:
    """query, status, edge_id, role_a, role_b, instruction, parse, contract_status, port_a, port_b, mobility: topology from one pass, attributes from another.

    requests (query, text), graph (query, role_a, role_b, mobility), parsed (query, role_a, role_b, contract_status, port_a, port_b, mobility, instruction).  A graph's edges are numbered in the
    order of the first of the text's `sentences` that names both roles, then by the pair; an edge is matched with its parse in either direction, and the ports
    are swapped with it.  Without a parse an edge keeps the graph's mobility and the sentence, unknown; a request without a graph keeps one error row.
    """
    pair = lambda df: df.withColumn("lo", F.least("role_a", "role_b")).withColumn("hi", F.greatest("role_a", "role_b"))
    rows = pair(graph).join(requests.select("query", sentences.alias("said")), "query")
    names = F.transform("said", lambda s: F.contains(s, F.col("role_a")) & F.contains(s, F.col("role_b")))
    at = F.array_position(names, True)
    rows = rows.withColumn("at", F.when(at > 0, at)).withColumn("natural", F.when(at > 0, F.get("said", (at - 1).cast("int"))))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.asc_nulls_last("at"), "lo", "hi")) - 1
    rows = rows.withColumn("edge_id", F.concat(F.lit("edge_"), F.lpad(place.cast("string"), 2, "0")))
    given = pair(parsed).select("query", "lo", "hi", F.col("role_a").alias("a"), F.col("contract_status").alias("s"), F.col("port_a").alias("pa"), F.col("port_b").alias("pb"), F.col("mobility").alias("m"), F.col("instruction").alias("text"))
    both = rows.join(given, ["query", "lo", "hi"], "left")
    same = F.col("a") == F.col("role_a")
    edges = both.select(
        "query", "edge_id", "role_a", "role_b", F.when(F.col("a").isNull(), F.col("natural")).otherwise(F.col("text")).alias("instruction"), F.when(F.col("a").isNull(), "missing").otherwise("parsed").alias("parse"),
        F.coalesce("s", F.lit("unknown")).alias("contract_status"), F.when(same, F.col("pa")).otherwise(F.col("pb")).alias("port_a"), F.when(same, F.col("pb")).otherwise(F.col("pa")).alias("port_b"), F.coalesce("m", "mobility").alias("mobility"),
    )
    out = requests.select("query").join(edges, "query", "left")
    return out.withColumn("status", F.when(F.col("edge_id").isNull(), "error").otherwise("compiled"))


def endpoint_samples(labels: DataFrame, parts: DataFrame, primitives: DataFrame, features: list[str]) -> DataFrame:
    """query, edge, side, step, target, primitives of every labelled side of an edge: the primitive table of the part that stands there, and the label's place in it.

    labels (query, edge, side, target), parts (query, edge, side, step), primitives (step, ordinal and features).  primitives: an array of ordinal and features, in order.  A side
    without a part, without primitives, or with a target outside its table is left out.
    """
    tables = primitives.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("ordinal", *features))).alias("primitives"))
    rows = labels.join(parts, ["query", "edge", "side"]).join(tables, "step")
    return rows.where((F.col("target") >= 0) & (F.col("target") < F.size("primitives"))).select("query", "edge", "side", "step", "target", "primitives")


def supervision_summary(labels: DataFrame) -> DataFrame:
    """One row of labels (query, edge, side, status): queries, endpoints, edges, mapped_edges (both sides mapped), statuses (their counts by name)."""
    each = labels.groupBy("query", "edge").agg((F.count_if((F.col("side") == "a") & F.startswith("status", F.lit("mapped"))) * F.count_if((F.col("side") == "b") & F.startswith("status", F.lit("mapped"))) > 0).alias("mapped"))
    counts = labels.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("statuses"))
    totals = labels.agg(F.count_distinct("query").alias("queries"), F.count("*").alias("endpoints"))
    # one row beside one row
    return totals.crossJoin(each.agg(F.count("*").alias("edges"), F.count_if("mapped").alias("mapped_edges"))).crossJoin(counts)
