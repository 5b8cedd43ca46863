"""Places, quantiles and hashes of ordered groups of any size: a group spreads over as many tasks as it needs.

Rows go once by ranges of (group, order).  A row's place in its group is its place in its range, and the rows of the group in the ranges before; of these only the
totals are summed, one row for each group and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.tables import written


def _ranged(rows: DataFrame, keys: list[str], order: list, weight: Column) -> tuple[DataFrame, DataFrame]:
    """(rows with the _range that they went to; keys, _range, _n, _before: weights in each range and before it)."""
    cut = written(rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = cut.groupBy(*keys, "_range").agg(F.sum(weight).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    return cut, totals.withColumn("_before", before)


def positions(rows: DataFrame, keys: list[str], order: list, name: str = "position", few: bool = False) -> DataFrame:
    """The rows with their place from 0 in the order of their group; equal rows may stand in either order.  Order columns rise, nulls first.
    few: the groups are so few that a row for each of them and each range can go to all tasks."""
    # equal rows are spread over ranges too; a range is numbered as it is sorted, the low bits of the number are a row's place in it
    marked = rows.withColumn("_turn", F.monotonically_increasing_id())
    ranges = marked.repartitionByRange(*keys, *order, "_turn").sortWithinPartitions(*keys, *order, "_turn").drop("_turn")
    cut = written(ranges.withColumn("_range", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    ends = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    ends = ends.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, "_range"]], (before - F.col("_first")).alias("_less"))
    joined = cut.join(F.broadcast(ends) if few else ends, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_range"]])
    return joined.withColumn(name, (F.col("_at") + F.col("_less")).cast("long")).select(*rows.columns, name)


def order_statistics(values: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """keys, place, value: the value at each wanted place (keys, place from 0) of the groups' sorted values.

    Equal values count together before they go anywhere, so a value that makes up most of a group is one row.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_w"))
    cut, totals = _ranged(counts, keys, [value], F.col("_w"))
    there = wanted.join(totals, keys).where((F.col("place") >= F.col("_before")) & (F.col("place") < F.col("_before") + F.col("_n")))
    there = written(there.select(*keys, "_range", "place", "_before"), "places")
    # only ranges that hold a wanted place are sorted
    some = cut.join(there.select(*keys, "_range").distinct(), [*keys, "_range"], "left_semi")
    so_far = F.sum("_w").over(Window.partitionBy(*keys, "_range").orderBy(value))
    summed = some.withColumn("_stop", so_far).withColumn("_start", F.col("_stop") - F.col("_w"))
    found = summed.join(there, [*keys, "_range"]).where((F.col("place") - F.col("_before") >= F.col("_start")) & (F.col("place") - F.col("_before") < F.col("_stop")))
    return found.select(*keys, "place", value)


def quantiles(values: DataFrame, keys: list[str], value: str, shares: dict[str, float], linear: bool = False) -> DataFrame:
    """keys and a column for each share: exact quantiles of each group's values, null where it has none.

    Nearest rank, place ceil(share n) - 1, or linear between the two places around share (n - 1).  Values: numbers without NaN; nulls do not count.
    """
    sizes = values.groupBy(*keys).agg(F.count(value).alias("_size"))
    asked = sizes.select(*keys, "_size", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in shares.items()])).alias("q"))
    at = F.col("q.p") * (F.col("_size") - 1) if linear else F.greatest(F.ceil(F.round(F.col("q.p") * F.col("_size"), 9)) - 1, F.lit(0)).cast("double")
    asked = asked.where("_size > 0").select(*keys, "_size", "q.name", at.alias("at")).withColumn("low", F.floor("at")).withColumn("part", F.col("at") - F.col("low"))
    ends = asked.select(*keys, "name", F.explode(F.array(F.struct(F.col("low").alias("place"), (1 - F.col("part")).alias("w")), F.struct(F.least(F.col("low") + 1, F.col("_size") - 1).alias("place"), F.col("part").alias("w")))).alias("e"))
    ends = written(ends.where("e.w > 0").select(*keys, "name", "e.place", "e.w"), "quantile-places")
    found = order_statistics(values, keys, value, ends.select(*keys, "place").distinct())
    each = ends.join(found, [*keys, "place"]).groupBy(*keys, "name").agg(F.sum(F.col("w") * F.col(value)).alias("v"))
    wide = each.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in shares])
    return sizes.drop("_size").join(wide, keys, "left")


def ordered_hashes(rows: DataFrame, keys: list[str], order: list, text: Column, fan: int = 1024, name: str = "hash") -> DataFrame:
    """keys, n, hash: SHA-256 over each group's texts in order, joined by line ends.

    A group of more than `fan` rows is hashed as an ordered tree: blocks of `fan` rows in a row, then blocks of `fan` of their hashes, until one is left.  So a group of up to `fan`
    rows has the hash of its plain list, and no task and no row holds more than a block.  Without keys all rows are one group, and no rows give no hash.
    """
    few = not keys
    if few:
        rows, keys = rows.withColumn("_all", F.lit(0)), ["_all"]
    level = positions(rows.select(*keys, *order, text.alias("_text")), keys, order, few=few).select(*keys, "position", "_text", F.lit(1).cast("long").alias("_n"))
    whole = None
    while True:
        block = level.groupBy(*keys, F.floor(F.col("position") / fan).alias("block"))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "_text"))), lambda x: x["_text"]), "\n")
        level = written(block.agg(F.sha2(joined, 256).alias("_text"), F.sum("_n").alias("_n")).withColumnRenamed("block", "position"), "hash-blocks")
        several = level.where("position > 0").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        done = level.join(several, same, "left_anti")
        whole = done if whole is None else whole.unionByName(done)
        if several.isEmpty():
            return whole.select(*([] if few else keys), F.col("_n").alias("n"), F.col("_text").alias(name))
        level = level.join(several, same, "left_semi")
