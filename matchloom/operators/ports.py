"""Ports: contracts of primitives, and how candidates meet them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.ports import SIZE_TOLERANCE, adjacent_key, contract_key, size_class, symmetry_class

from matchloom.sources.tables import tasks_for

from .graphs import neighbour_shares

LEAST_SHARE = 0.24
CONTRACT = ["kind", "geometry_type", "size_class", "adjacent", "symmetry"]


def described_ports(primitives: DataFrame, edges: DataFrame | None, types: list[str]) -> DataFrame:
    """Primitives with size_class, adjacent, symmetry and contract, the key of all five fields.

    The peers of a primitive are those of its step and type; they, the smaller and the larger ones are counted by range frames over their measures, which
    read no more than the peers in one order.  adjacent: the first two of `types` that make up a quarter or so of its neighbours by edges (step, a, b, feature), or without
    edges of the primitives' `near`, an array of their types.
    """
    frame = "count(*) over (partition by step, geometry_type order by measure range between {0})"
    tolerance = f"{SIZE_TOLERANCE!r}D"
    smaller = F.expr(frame.format(f"unbounded preceding and {tolerance} preceding"))
    larger = F.expr(frame.format(f"{tolerance} following and unbounded following"))
    peers = F.expr(frame.format("unbounded preceding and unbounded following"))
    counted = primitives.withColumns({"_peers": peers, "_smaller": smaller, "_larger": larger})
    found = counted.withColumn("size_class", size_class(F.col("_peers"), F.col("_smaller"), F.col("_larger"))).withColumn("symmetry", symmetry_class(F.col("members")))
    found = found.drop("_peers", "_smaller", "_larger")
    if edges is None:
        like = lambda t: F.size(F.filter("near", lambda x: x == t))
        often = F.filter(F.array(*[F.when(like(t) >= LEAST_SHARE * F.size("near"), F.lit(t)) for t in types]), lambda x: x.isNotNull())
        full = found.withColumn("adjacent", adjacent_key(F.when(F.size("near") > 0, F.slice(often, 1, 2)).otherwise(F.slice(often, 1, 0)))).drop("near")
    else:
        near = neighbour_shares(primitives, edges, types, LEAST_SHARE).select("step", "ordinal", adjacent_key(F.col("adjacent")).alias("adjacent"))
        full = found.join(near, ["step", "ordinal"])
    return full.withColumn("contract", contract_key(*map(F.col, CONTRACT)))


def selected_port(ports: DataFrame, kind: str, geometry: str, size: str) -> DataFrame:
    """step, ordinal, status: the first port of kind, type and size, else the first, or for the sizes towards the
    large end the last, of kind and type; status says which, or that there is none."""
    match = (F.col("kind") == kind) & (F.col("geometry_type") == geometry)
    exact = match & (F.col("size_class") == size)
    last = size in ("large", "largest")
    rank = F.when(exact, 0).when(match, 1).otherwise(2)
    near = F.when(exact | (not last), F.col("ordinal")).otherwise(-F.col("ordinal"))
    order = Window.partitionBy("step").orderBy(rank, near, "ordinal")
    best = ports.withColumn("rank", rank).withColumn("turn", F.row_number().over(order)).where("turn = 1")
    return best.select(
        "step", F.when(F.col("rank") < 2, F.col("ordinal")).alias("ordinal"),
        F.when(F.col("rank") == 0, "exact").when(F.col("rank") == 1, "type").otherwise("missing").alias("status"),
    )


def contract_counts(ports: DataFrame) -> DataFrame:
    """step, n_all, of (its contracts, each with its number n), stated (the contract of its first primitive, null where ports have no ordinal): one row of each step, made where its ports are."""
    place = F.col("ordinal") if "ordinal" in ports.columns else F.lit(None).cast("int")
    each = ports.groupBy("step", "contract").agg(F.count("*").alias("n"), F.min(place).alias("least"))
    first = F.max(F.when(F.col("least") == 0, F.col("contract"))).alias("stated")
    return each.groupBy("step").agg(F.sum("n").alias("n_all"), F.collect_list(F.struct("contract", "n")).alias("of"), first)


def match_counts(candidates: DataFrame, endpoints: DataFrame, ports: DataFrame) -> DataFrame:
    """query, edge, side, role, candidate, n: how many of a candidate's primitives meet an endpoint's contract.  ports: the described ports or, where they are at hand, their contract_counts.

    Without a contract every primitive does.  A candidate without primitives has n = 0.
    """
    counted = ports if "of" in ports.columns else contract_counts(ports)
    tasks = tasks_for(candidates)
    dealt = lambda df, *keys: df.repartition(tasks, *keys)
    asked = dealt(endpoints, "query", "role").join(dealt(candidates.select("query", "role", "candidate"), "query", "role"), ["query", "role"])
    full = dealt(asked, "candidate").join(dealt(counted.select(F.col("step").alias("candidate"), "n_all", "of"), "candidate"), "candidate", "left")
    n_of = F.get(F.filter("of", lambda x: x["contract"] == F.col("contract")), 0)["n"]
    n = F.coalesce(F.when(F.col("contract").isNull(), F.col("n_all")).otherwise(n_of), F.lit(0))
    return full.select("query", "edge", "side", "role", "candidate", n.alias("n"))


def compatible_counts(counts: DataFrame) -> DataFrame:
    """query, edge, side, compatible, candidates."""
    return counts.groupBy("query", "edge", "side").agg(F.count_if(F.col("n") > 0).alias("compatible"), F.count("*").alias("candidates"))
