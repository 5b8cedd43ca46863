"""MinHash near-duplicates by a signature-coordinate inverted join.

Every distinct shingle set gets a signature of k minima.  A set is posted under its
(coordinate, minimum) tokens.  Two sets are candidates if at least `match` of the k
coordinates collide.  The counting uses

* prefixes: tokens are ordered from rare to common; two signatures with `match`
  tokens in common share one of their k - match + 1 rarest, so only these are merged;
* skips: tokens that one set alone has are dropped (a set with fewer than `match`
  shared tokens has no partner at all), and the common tokens behind the prefix are
  never merged but looked up in the two signatures once a pair is known.

Pairs with enough collisions are confirmed on the full shingle sets.  At similarity
0.85 a pair misses 40 of 64 collisions with probability about 1e-6.

Copies are one class from the start.  Inside a posting list not all pairs are made:
first each list's members are compared with its most central member.  Pairs inside one
component cannot change the result.  What members of different components differ in from
their common centre then tells which of them may still be linked (_difference_posts): again with the nearest of each list first, then
between the components that are left (_differing_alike).
So nothing is lost, and a large group of near copies does not make all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .tables import ids_and_texts, one_row_per_id, schema, written
from .text import Words, grams, lists, mix, slices

_SIGNATURES = "doc_id long, n_shingles long, key1 long, key2 long, sig array<long>"
_SETS = "doc_id long, shingles array<long>"


def _sets(batch: pa.RecordBatch, width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    words = Words(batch.column("text"), lower=True)
    found, first = grams(words.names, width), words.first
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= width:
            out.append(np.unique(found[a : b - width + 1]))
        else:
            out.append(grams(words.names[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _signatures(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    seeds = mix(np.arange(1, 2 * k + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
    flips, factors = seeds[:k], seeds[k:] | np.uint64(1)
    for batch in slices(batches, "text", 1 << 19):
        sets = _sets(batch, width)
        sizes = np.array([len(s) for s in sets], np.int64)
        full = np.flatnonzero(sizes)
        sig = np.zeros((len(sets), k), np.int64)
        keys = np.zeros((2, len(sets)), np.int64)
        if len(full):
            every = np.concatenate(sets)
            starts = (np.cumsum(sizes) - sizes)[full]
            for j in range(k):
                least = np.minimum.reduceat(((every ^ flips[j]) * factors[j]) >> np.uint64(32), starts)
                sig[full, j] = least.astype(np.int64) | (j << 32)
            for j in (0, 1):
                keys[j, full] = np.add.reduceat(mix(every ^ seeds[j]), starts).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes), pa.array(keys[0]), pa.array(keys[1]), lists(sig.ravel(), np.arange(len(sets) + 1) * k, pa.int64())],
            names=["doc_id", "n_shingles", "key1", "key2", "sig"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = _sets(batch, width)
        sizes = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), lists(np.concatenate(sets).view(np.int64), sizes, pa.int64())], names=["doc_id", "shingles"]
        )


def _confirmed(pairs: DataFrame, reps: DataFrame, sets: DataFrame, match: int, percent: int) -> DataFrame:
    """Pairs (a, b) with enough collisions whose full sets reach the similarity."""
    side = lambda name, t, c: t.select(F.col("rep" if "rep" in t.columns else "doc_id").alias(name), F.col(c).alias(f"{c}_{name}"))
    collided = (
        pairs.join(side("a", reps, "sig"), "a").join(side("b", reps, "sig"), "b")
        .where(F.size(F.array_intersect("sig_a", "sig_b")) >= match).select("a", "b")
    )
    both = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return (
        collided.join(side("a", sets, "shingles"), "a").join(side("b", sets, "shingles"), "b")
        .select("a", "b", (F.size("shingles_a") + F.size("shingles_b")).alias("total"), both.alias("both"))
        .where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * percent).select("a", "b")
    )


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("rep", "a").alias("a"), F.greatest("rep", "a").alias("b")).distinct()


def _still_apart(posts: DataFrame, label: DataFrame) -> DataFrame:
    """Posts with the label of their component, of the tokens that hold more than one."""
    known = label.select(F.col("id").alias("rep"), "component")
    labelled = posts.join(known, "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component")
    mixed = labelled.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token")
    return labelled.join(mixed, "token", "left_semi")


def _usable(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """rep, n_shingles, usable: how many shingles of each set also stand in a set of another component.

    Any link still to be found has that many shingles in common at most.
    """
    who = apart.select("rep", "n_shingles", "label").distinct()
    each = who.join(sets.withColumnRenamed("doc_id", "rep"), "rep").select("rep", "n_shingles", "label", F.explode("shingles").alias("shingle"))
    mixed = each.groupBy("shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("shingle")
    return each.join(mixed, "shingle", "left_semi").groupBy("rep", "n_shingles").agg(F.count("*").alias("usable"))


def _apart(members: DataFrame, sets: DataFrame, block: int = 64) -> DataFrame:
    """Members with apart: the shingles in which the sets of rep and of the centre a differ.

    A centre's members are dealt into blocks of about `block`, each with its copy of the centre's set, so a large group is many tasks' work.
    """
    blocks = members.groupBy("a").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = members.join(blocks, "a").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks")).drop("blocks")
    centres = blocks.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("y")), "a").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    whole = dealt.join(sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("x")), "rep").join(centres.drop("blocks"), ["a", "block"])
    return whole.select("a", "rep", "label", "n_shingles", F.concat(F.array_except("x", "y"), F.array_except("y", "x")).alias("apart"))


def _need(n: Column, apart: Column, percent: int) -> Column:
    """How many differences from their centre two sets of n shingles together, which differ from it in `apart` together, must share to be linked; one at least."""
    p, q = 100 + percent, 100 - percent
    return F.greatest(F.lit(1), F.ceil((apart * p - q * n) / (2 * p)))


def _difference_posts(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members (a: the centre, rep, label, n_shingles) posted under the differences from their centre that members of other components share.

    Let A and B be what two members x and y differ in from one centre.  x and y differ in |A| + |B| - 2 |A & B| shingles,
    and are linked if that is at most q / (100 + p) of |x| + |y|, for p percent and q = 100 - p.  If A and B have nothing in
    common, then both are linked with the centre and are one component by now.  So links between components show in common differences: at least
    half of |A| + |B| - q / (100 + p) * (|x| + |y|), and one.

    Differences are in one order, rare ones first.  At the first that two members share, no more than what is `behind` it can be shared.  A member is posted under a difference
    only if what is behind it there is enough for some partner in that list: the bound takes the list's least difference and its largest set.  So what all members of
    a family differ in alike from their centre, its own words above all, is posted by none of them as long as it alone does not link them.
    """
    # written, as an array that is exploded beside its size would be made anew for each of its elements
    each = written(_apart(members, sets), "differences").select("a", "rep", "label", "n_shingles", F.size("apart").alias("n_apart"), F.explode("apart").alias("shingle"))
    found = each.groupBy("a", "shingle").agg(
        F.count("*").alias("df"), F.min("label").alias("x"), F.max("label").alias("y"), F.min("n_apart").alias("low"), F.max("n_shingles").alias("high")
    ).where("x < y").drop("x", "y")
    shared = each.join(found, ["a", "shingle"])
    of_member = Window.partitionBy("a", "rep")
    behind = F.count("*").over(of_member) - F.row_number().over(of_member.orderBy("df", "shingle")) + 1
    largest = F.least(F.col("high").cast("double"), F.col("n_shingles") * 100 / percent)
    enough = F.col("behind") >= _need(F.col("n_shingles") + largest, F.col("n_apart") + F.col("low"), percent)
    return written(shared.withColumn("behind", behind).where(enough).select("a", "shingle", "rep", "label", "n_shingles", "n_apart", "behind"), "shared")


def _relabelled(posts: DataFrame, label: DataFrame) -> DataFrame:
    """Posts with the labels of new components, of the lists that hold more than one."""
    known = label.select(F.col("id").alias("rep"), "component")
    rows = posts.join(known, "rep", "left").withColumn("label", F.coalesce("component", "label")).drop("component")
    mixed = rows.groupBy("a", "shingle").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("a", "shingle")
    return rows.join(mixed, ["a", "shingle"], "left_semi")


def _near(n: str, m: str, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _with_nearest(posts: DataFrame, percent: int) -> DataFrame:
    """rep, a: the members of a list beside the one of it that is nearest to their centre, where their components differ."""
    heads = posts.groupBy("a", "shingle").agg(F.min(F.struct("n_apart", "rep", "label", "n_shingles")).alias("h"))
    rows = posts.join(heads, ["a", "shingle"]).withColumn("n_head", F.col("h.n_shingles"))
    enough = F.col("behind") >= _need(F.col("n_shingles") + F.col("n_head"), F.col("n_apart") + F.col("h.n_apart"), percent)
    return rows.where((F.col("label") != F.col("h.label")) & enough & _near("n_shingles", "n_head", percent)).select("rep", F.col("h.rep").alias("a"))


def _differing_alike(posts: DataFrame, percent: int) -> DataFrame:
    """Posts of differences -> rep, a: members of different components that may be linked.

    A list's members are first held against each other by classes of like numbers of differences: only classes of which some members could share enough are joined.
    Among the members of a list, the component with the most of them is met by the others alone: its own members are not
    paired with each other.
    """
    by_label = posts.groupBy("a", "shingle", "label").agg(F.count("*").alias("n"))
    leads = by_label.groupBy("a", "shingle").agg(F.max_by("label", F.struct("n", "label")).alias("lead"))
    rows = posts.join(leads, ["a", "shingle"]).withColumn("leads", F.col("label") == F.col("lead")).drop("lead")
    # a quarter of an octave each
    rows = written(rows.withColumn("kind", F.floor(4 * F.log2(F.greatest("n_apart", F.lit(1)))).cast("int")), "differing")
    kinds = rows.groupBy("a", "shingle", "kind").agg(F.min("n_apart").alias("low"), F.max("n_shingles").alias("high"), F.max("behind").alias("behind"), F.min("label").alias("x"), F.max("label").alias("y"))
    other_kinds = kinds.select("a", "shingle", *[F.col(c).alias(f"{c}_b") for c in ("kind", "low", "high", "behind", "x", "y")])
    able = F.least("behind", "behind_b") >= _need(F.col("high") + F.col("high_b"), F.col("low") + F.col("low_b"), percent)
    both = kinds.join(other_kinds, ["a", "shingle"]).where(able & ((F.col("x") != F.col("y_b")) | (F.col("y") != F.col("x_b")))).select("a", "shingle", "kind", "kind_b")
    other = rows.where("not leads").select("a", "shingle", *[F.col(c).alias(f"{c}_b") for c in ("kind", "rep", "label", "n_shingles", "n_apart", "behind")])
    enough = F.least("behind", "behind_b") >= _need(F.col("n_shingles") + F.col("n_shingles_b"), F.col("n_apart") + F.col("n_apart_b"), percent)
    once = F.col("leads") | (F.col("label") < F.col("label_b"))
    met = rows.join(both, ["a", "shingle", "kind"]).join(other, ["a", "shingle", "kind_b"])
    return met.where((F.col("label") != F.col("label_b")) & once & _near("n_shingles", "n_shingles_b", percent) & enough).select("rep", F.col("rep_b").alias("a"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = 64, match: int | None = None) -> DataFrame:
    """Documents -> doc_id, n_shingles, component_id, kept.

    Words are runs outside 0x20 and 0x09-0x0D with A-Z lowered; the set has all runs of
    `width` words, or the whole text as one if it has fewer.  Two documents are linked if
    their sets' similarity is at least percent / 100.  component_id is the least doc_id
    reachable; kept marks it.

    A null or empty text has the empty set, is linked with nothing and is kept.  Copies share a
    component.  Of rows repeated under one doc_id the one with the least text counts, so a doc_id
    gives one row.  An empty table gives no rows.
    Rows with a null doc_id are left out, other columns are not read.  Long texts are
    taken whole: a text longer than a slice of 1 MB makes a slice of its own.
    """
    match = match or int(k * percent / 100 - 5 * (k * percent / 100 * (1 - percent / 100)) ** 0.5)
    source = one_row_per_id(ids_and_texts(docs))
    signed = written(source.mapInArrow(partial(_signatures, width=width, k=k), schema(_SIGNATURES)), "signatures")
    full = signed.where("n_shingles > 0")
    reps = written(full.groupBy("key1", "key2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig")), "classes")

    tokens = reps.select("rep", "n_shingles", F.explode("sig").alias("token"))
    shared = tokens.join(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "token")
    of_rep = Window.partitionBy("rep")
    posts = written(
        shared.withColumn("n_shared", F.count("*").over(of_rep))
        .where(F.col("n_shared") >= match)
        .withColumn("weight", F.sum("df").over(of_rep))
        .withColumn("place", F.row_number().over(of_rep.orderBy("df", "token")))
        .where(F.col("place") <= (k - match + 1) - (k - F.col("n_shared")))
        .select("token", "rep", "n_shingles", "weight"),
        "postings",
    )
    wanted = posts.select(F.col("rep").alias("doc_id")).distinct()
    texts = source.join(wanted, "doc_id", "left_semi")
    sets = written(texts.mapInArrow(partial(_full_sets, width=width), schema(_SETS)), "sets")

    lead = F.struct(F.col("weight").alias("w"), (-F.col("rep")).alias("r"), F.col("n_shingles").alias("n"))
    near = F.least("n_shingles", "n_a") * 100 >= F.greatest("n_shingles", "n_a") * percent
    heads = posts.groupBy("token").agg(F.max(lead).alias("lead")).select("token", (-F.col("lead.r")).alias("a"), F.col("lead.n").alias("n_a"))
    pairs = _pairs(posts.join(heads, "token").where((F.col("rep") != F.col("a")) & near))
    label = written(components(_confirmed(pairs, reps, sets, match, percent)), "components")

    apart = _still_apart(posts, label)
    usable = written(_usable(apart, sets), "usable").where(F.col("usable") * 100 >= F.col("n_shingles") * percent)
    left = _still_apart(posts.join(usable.select("rep"), "rep", "left_semi"), label)
    members = left.join(heads.select("token", "a"), "token").where("rep <> a").select("a", "rep", "label", "n_shingles").distinct()
    alike = _difference_posts(members, sets, percent)
    for pairing in (_with_nearest, _differing_alike):
        alike = _relabelled(alike, label)
        known = label.select(F.col("id").alias("a"), F.col("component").alias("b"))
        label = written(components(known.unionByName(_confirmed(_pairs(pairing(alike, percent)), reps, sets, match, percent))), "components")

    # every row finds its class by the key of its set, and the class its component
    of_class = reps.join(label, reps.rep == label.id, "left").select("key1", "key2", "n_shingles", F.coalesce("component", "rep").alias("found"))
    least = full.join(of_class, ["key1", "key2", "n_shingles"]).select("doc_id", "n_shingles", F.col("found").alias("component_id"))
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return least.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """The documents that near_duplicates keeps, with their columns; of rows repeated under one doc_id the least stays."""
    docs = one_row_per_id(docs)
    return docs.join(near_duplicates(docs, **settings).where("kept").select("doc_id"), "doc_id", "left_semi")
