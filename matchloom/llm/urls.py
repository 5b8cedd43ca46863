"""URL verdicts: host and path rules first, boosted trees on lexical features for the rest.

Everything is column expressions, joins and Spark's own tree learner; no Python runs on
the executors.  The labelled URLs are those that a rule decides.

Suffix statistics count sites (the last two labels of a host), not pages: how often the labelled sites under a host's
last label are blocked, without the page's own site, so that one large site, or the rule that
names it, does not speak for all others under its ending.  A suffix or a site may hold a third of all pages: where it holds
more than a 256th of what is joined, its rows are dealt to salts.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import written

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "dash_ratio", "entropy", "parameters", "values", "secure", "suffix_rate", "suffix_sites"]

Rule = tuple[str, str, str]
SHARE, SALTS = 256, 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first :// up to /, ? or #, with A-Z lowered, and what follows that up to ? or #; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring({0}, {1})".format("_url", "instr(_url, '://') + 3"))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of _host and _path, null where none fits; rules are (verdict, host, path), the longest wins."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((F.col("_host") == host) | F.col("_host").endswith("." + host)) & F.col("_path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    marks = F.split(text, "")
    return F.aggregate(
        F.array_distinct(marks), F.lit(0.0),
        lambda a, c: a - (F.size(F.filter(marks, lambda x: x == c)) / F.size(marks)) * F.log2(F.size(F.filter(marks, lambda x: x == c)) / F.size(marks)),
    )


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical_features(pages: DataFrame) -> DataFrame:
    """_url, _host and _path with the features of the URL's text; a null URL counts as empty."""
    url = F.coalesce("_url", F.lit(""))
    size = F.greatest(F.length(url), F.lit(1))
    return pages.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length("_host").cast("double"), "path_length": F.length("_path").cast("double"),
        "depth": _count(F.col("_path"), "/"), "labels": _count(F.col("_host"), "[.]"), "digit_ratio": _count(url, "[0-9]") / size,
        "dash_ratio": _count(url, "[-_]") / size, "entropy": _entropy(url), "parameters": _count(url, "[?&]"), "values": _count(url, "="),
        "secure": F.lower(url).startswith("https").cast("double"), "suffix": F.substring_index("_host", ".", -1), "site": F.substring_index("_host", ".", -2),
    })


def met(rows: DataFrame, table: DataFrame, keys: list[str], size: str, spread: Column) -> DataFrame:
    """rows joined to the one row of table that has their keys; `size` says how many of the rows it has, `spread` is a hash that tells the rows apart.

    Keys with more than a SHARE-th of all rows, of which there are fewer than SHARE, are known to every task; their rows go to SALTS salts,
    and the table's row to each of them.
    """
    total = table.agg(F.sum(size)).first()[0] or 0
    heavy = F.col(size) > total / SHARE
    names = [f"_heavy_{c}" for c in keys]
    known = F.broadcast(table.where(heavy).select(*[F.col(c).alias(n) for c, n in zip(keys, names, strict=True)], F.lit(SALTS).alias("_salts")))
    same = [F.col(c) == F.col(n) for c, n in zip(keys, names, strict=True)]
    dealt = rows.join(known, same, "left").withColumn("_salt", F.pmod(spread, F.coalesce("_salts", F.lit(1))).cast("int")).drop(*names, "_salts")
    copied = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.when(heavy, SALTS - 1).otherwise(0))))
    return dealt.join(copied, [*keys, "_salt"]).drop("_salt")


def suffix_statistics(rows: DataFrame, lean: float = 10.0) -> DataFrame:
    """Rows (suffix, site, block: 1, 0 or null) with suffix_rate and suffix_sites.

    suffix_rate: the mean over the other labelled sites under the suffix of how often they are blocked, with `lean` sites at the
    mean of all labelled sites added; suffix_sites: the log of how many sites are under the suffix.
    """
    sites = written(rows.groupBy("suffix", "site").agg(F.avg("block").alias("own"), F.count("*").alias("pages")), "sites")
    mean = sites.agg(F.avg("own")).first()[0] or 0.0
    suffixes = sites.groupBy("suffix").agg(F.coalesce(F.sum("own"), F.lit(0.0)).alias("blocked"), F.count("own").alias("labelled"), F.count("*").alias("sites"))
    of_sites = met(sites, suffixes, ["suffix"], "sites", F.xxhash64("site"))
    known = met(rows, of_sites, ["suffix", "site"], "pages", F.xxhash64(*rows.columns))
    others = F.col("labelled") - F.when(F.col("own").isNull(), 0).otherwise(1)
    rate = (F.col("blocked") - F.coalesce("own", F.lit(0.0)) + lean * mean) / (others + lean)
    return known.withColumns({"suffix_rate": rate, "suffix_sites": F.log("sites").cast("double")}).drop("blocked", "sites", "labelled", "own", "pages")


def url_verdicts(pages: DataFrame, rules: list[Rule], trees: int = 10, depth: int = 4, seed: int = 1) -> DataFrame:
    """Pages -> page_id, host, path, rule, verdict, block_score.

    verdict is the fitting rule's, else block where the trees' prediction is.  If the rules
    decide no URL, or all alike, there is nothing to learn and the rest is allowed, or
    gets that one verdict.  block_score is null where no trees are grown.

    A null URL, or one without ://, has an empty host and path.  Rows repeated under one page_id are
    each judged; null page_ids stay; other columns are not read; an empty table gives no rows.  Long URLs are taken whole; the
    entropy's time grows with their length times their distinct characters.  Rules that fit alike are told apart by length, then by
    the later in order of their text.
    """
    named = pages.select("page_id", F.col("url").cast("string").alias("_url"))
    host, path = host_and_path(F.col("_url"))
    split = named.withColumns({"_host": host, "_path": path})
    rule, verdict = rule_columns(rules)
    ruled = split.withColumns({"rule": rule, "given": verdict})
    rows = written(lexical_features(ruled).withColumn("block", F.when(F.col("given").isNotNull(), (F.col("given") == "block").cast("double"))), "urls")
    totals = rows.agg(F.count("block"), F.sum("block")).first()
    n, blocked = totals[0], totals[1] or 0.0
    if n == 0 or blocked in (0.0, float(n)):
        rest = "block" if n and blocked else "allow"
        return rows.select("page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", F.coalesce("given", F.lit(rest)).alias("verdict"), F.lit(None).cast("double").alias("block_score"))
    full = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(suffix_statistics(rows))
    # both verdicts weigh alike: how many pages the rules happen to fit says nothing about the others
    full = full.withColumn("weight", F.when(F.col("block") > 0, n / (2 * blocked)).otherwise(n / (2 * (n - blocked))))
    learner = GBTClassifier(featuresCol="features", labelCol="block", weightCol="weight", maxIter=trees, maxDepth=depth, seed=seed, stepSize=0.3, maxBins=32)
    model = learner.fit(full.where("block is not null"))
    score = F.element_at(_as_array("probability"), 2)
    return model.transform(full).select(
        "page_id", F.col("_host").alias("host"), F.col("_path").alias("path"), "rule",
        F.coalesce("given", F.when(F.col("prediction") > 0, "block").otherwise("allow")).alias("verdict"), score.alias("block_score"),
    )


def _as_array(column: str) -> Column:
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(F.col(column))
