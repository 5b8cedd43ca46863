"""Schedules of generated requests: every shuffle comes from a hash, so it is the same on any cluster and in any SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Roles of a generated request, what they are for, and the part families that may stand at each.
ROLES = [
    ("role_00", "central multi-port connector", "hub", ["hub", "shaft", "plate", "block"]),
    ("role_01", "axial rotating member", "shaft", ["shaft", "ring", "plate", "bracket"]),
    ("role_02", "planar mounting member", "plate", ["plate", "block", "shaft", "ring"]),
    ("role_03", "guided pin member", "pin", ["pin", "plate", "ring", "bracket"]),
]
LARGE_FAMILIES = [
    ["hub", "shaft", "plate", "block", "ring", "bracket", "pin", "ring"],
    ["shaft", "ring", "plate", "bracket", "pin", "hub", "block", "pin"],
    ["plate", "block", "shaft", "ring", "bracket", "hub", "pin", "block"],
    ["pin", "plate", "ring", "bracket", "shaft", "block", "hub", "shaft"],
]


def schedule(queries: DataFrame, seed: int, large: bool = False) -> DataFrame:
    """query, seed, role, description, target_family, place, family of the requests (query: a number).

    A request's seed is the first 16 hex digits of SHA-256(`seed:query:number`).  Its families at a role are dealt by SHA-256(`request's seed:role:slot`), slot being the place in the
    role's list, so a family listed twice stands twice.  A permutation of the list for every request and role.
    """
    listed = [(r, d, t, large_ if large else small) for (r, d, t, small), large_ in zip(ROLES, LARGE_FAMILIES, strict=True)]
    slots = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(d).alias("description"), F.lit(t).alias("target_family"), F.lit(i).alias("slot"), F.lit(f).alias("family")) for r, d, t, families in listed for i, f in enumerate(families)])
    own = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.lit("query"), F.col("query").cast("string")), 256), 1, 16)
    rows = queries.select("query", own.alias("seed"), F.explode(slots).alias("s")).select("query", "seed", "s.*")
    dealt = rows.withColumn("draw", F.sha2(F.concat_ws(":", "seed", "role", "slot"), 256))
    place = F.row_number().over(Window.partitionBy("query", "role").orderBy("draw", "slot")) - 1
    return dealt.select("query", "seed", "role", "description", "target_family", place.alias("place"), "family")


def schedule_ids(rows: DataFrame) -> DataFrame:
    """query, seed, roles (array of role and its families in their places), query_id: proc_ and 20 hex digits over the seed and all families."""
    families = rows.groupBy("query", "seed", "role").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "family"))), lambda x: x["family"]).alias("families"))
    roles = families.groupBy("query", "seed").agg(F.array_sort(F.collect_list(F.struct("role", "families"))).alias("roles"))
    text = F.concat_ws("|", "seed", F.array_join(F.transform("roles", lambda r: F.concat(r["role"], F.lit("="), F.array_join(r["families"], ","))), ";"))
    return roles.select("query", "seed", "roles", F.concat(F.lit("proc_"), F.substring(F.sha2(text, 256), 1, 20)).alias("query_id"))
