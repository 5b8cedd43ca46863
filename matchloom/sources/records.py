"""Content-hash identity of files and rows, and the checks that sets of keys must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.functions.text import is_sha256


def read_files(spark, path: str) -> DataFrame:
    """path and content of every file under a folder of any store that Spark reads."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def verified(files: DataFrame) -> DataFrame:
    """Files (path, content, declared) with sha and status: ok, or path, declaration, hash; no file is dropped."""
    sha = F.sha2("content", 256)
    status = (
        F.when(F.col("path").isNull() | F.col("path").rlike(r"(^|/)\.\.(/|$)"), "path").when(F.col("declared").isNull() | ~is_sha256(F.col("declared")), "declaration")
        .when(sha != F.col("declared"), "hash").otherwise("ok")
    )
    return files.withColumn("sha", sha).withColumn("status", F.coalesce(status, F.lit("hash")))


def distinct_files(files: DataFrame) -> DataFrame:
    """One row for each content, with the least path."""
    return files.groupBy("sha").agg(F.min("path").alias("path"), F.count("*").alias("n"))


def pending(files: DataFrame, done: DataFrame, excluded: DataFrame) -> DataFrame:
    """Contents that are neither done nor excluded."""
    return distinct_files(files).join(done.select("sha").unionByName(excluded.select("sha")), "sha", "left_anti")


def accounting(candidates: DataFrame, entries: DataFrame, excluded: DataFrame) -> DataFrame:
    """One row: candidates must be entries and exclusions together; what is both counts as an entry."""
    state = candidates.select("sha", F.lit(0).alias("rank")).unionByName(excluded.select("sha", F.lit(1).alias("rank"))).unionByName(entries.select("sha", F.lit(2).alias("rank")))
    each = state.groupBy("sha").agg(F.max("rank").alias("rank"))
    return each.agg(
        F.count("*").alias("candidates"), F.count_if(F.col("rank") == 2).alias("entries"), F.count_if(F.col("rank") == 1).alias("excluded"),
        F.count_if(F.col("rank") == 0).alias("left_over"), (F.count_if(F.col("rank") == 0) == 0).alias("complete"),
    )


def domain_differences(want: DataFrame, got: DataFrame) -> DataFrame:
    """side (missing, extra) and the keys on which two sets differ; empty if they are equal."""
    return want.exceptAll(got).distinct().select(F.lit("missing").alias("side"), "*").unionByName(got.subtract(want).select(F.lit("extra").alias("side"), "*"))


def leakage(rows: DataFrame, key: str) -> DataFrame:
    """One row: how many keys stand in more than one split."""
    spread = rows.groupBy(key).agg(F.min("split").alias("low"), F.max("split").alias("high"))
    return spread.agg(F.count_if(F.col("low") < F.col("high")).alias("shared"), (F.count_if(F.col("low") < F.col("high")) == 0).alias("clean"))


def edge_match(want: DataFrame, got: DataFrame) -> DataFrame:
    """query, shared, missing, extra of unordered edges (query, lo, hi)."""
    both = want.withColumn("w", F.lit(1)).join(got.withColumn("g", F.lit(1)), ["query", "lo", "hi"], "full_outer")
    return both.groupBy("query").agg(
        F.count_if(F.col("w").isNotNull() & F.col("g").isNotNull()).alias("shared"), F.count_if(F.col("g").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("extra")
    )


def catalog(rows: DataFrame) -> DataFrame:
    """idx, id, descriptor of the distinct descriptors in the order of their hash; a catalog is small by its rules (512 entries at most)."""
    distinct = rows.select("descriptor").distinct().withColumn("hash", F.sha2("descriptor", 256))
    return distinct.select((F.row_number().over(Window.orderBy("hash")) - 1).alias("idx"), F.substring("hash", 1, 16).alias("id"), "descriptor")


def looked_up(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows with the idx of their descriptor; what a catalog lacks is kept as out_of_vocabulary."""
    return rows.join(known.select("descriptor", "idx"), "descriptor", "left").withColumn("status", F.when(F.col("idx").isNull(), "out_of_vocabulary").otherwise("found"))


def fingerprint(hashes: DataFrame) -> DataFrame:
    """One hash of a table's row hashes whatever their order, by buckets of their first four digits."""
    buckets = hashes.groupBy(F.substring("hash", 1, 4).alias("bucket")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("hash")), ""), 256).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("bucket", "part")))
    return buckets.agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["part"]), ""), 256).alias("fingerprint"), F.count("*").alias("buckets"))


def write_json_lines(rows: DataFrame, folder: str) -> DataFrame:
    """Rows as JSON lines with sorted keys under folder/data, then one manifest row under folder/manifest: rows, columns and sha256 of their sorted hashes' tree.

    The manifest is written when the data is in place, so a folder with one is whole.  Rows are hashed into 4096 buckets, each bucket's sorted hashes into
    one, and these into the manifest's: no task and no row holds them all.
    """
    spark = rows.sparkSession
    columns = sorted(rows.columns)
    rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value")).write.text(f"{folder}/data")
    lines = spark.read.text(f"{folder}/data")
    tree_hash(lines, F.sha2("value", 256)).withColumn("columns", F.lit(",".join(columns))).write.json(f"{folder}/manifest")
    return spark.read.schema("rows bigint, sha256 string, columns string").json(f"{folder}/manifest")


def tree_hash(rows: DataFrame, digest) -> DataFrame:
    """rows, sha256: a hash of all rows' digests, whatever their order, by 4096 buckets of their first three hex digits."""
    buckets = rows.select(digest.alias("h")).groupBy(F.substring("h", 1, 3).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"])
    return buckets.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(ordered, ""), 256).alias("sha256"))


REQUEST = (
    "query bigint, roles array<string>, candidate_sets map<string, array<bigint>>, "
    "functional_edges array<struct<edge: int, role_a: string, role_b: string, status: string>>"
)


def load_protocol(spark: SparkSession, folder: str, schema: str = REQUEST) -> dict[str, DataFrame]:
    """Nested request documents (JSON, one a line) -> four flat tables: query (query, n_roles), role (query, pos, role), candidate (query, role, pos, candidate), edge (query, pos, edge, role_a, role_b, status).

    Candidate sets are a map whose keys differ from request to request, so it is read with an explicit schema.  A document that does not fit it has null fields and no rows but its own.
    """
    documents = spark.read.schema(schema).json(folder)
    edges = documents.select("query", F.posexplode("functional_edges").alias("pos", "e")).select("query", "pos", "e.*")
    sets = documents.select("query", F.explode("candidate_sets").alias("role", "ids"))
    return {
        "query": documents.select("query", F.coalesce(F.size("roles"), F.lit(0)).alias("n_roles")),
        "role": documents.select("query", F.posexplode("roles").alias("pos", "role")),
        "candidate": sets.select("query", "role", F.posexplode("ids").alias("pos", "candidate")),
        "edge": edges,
    }
