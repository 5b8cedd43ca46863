"""Attributed graphs of primitives and faces: neighbours, groups, refinement, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.tables import written


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (step, a, b, feature) in both directions."""
    return edges.select("step", "a", "b", "feature").unionByName(edges.select("step", F.col("b").alias("a"), F.col("a").alias("b"), "feature"))


# steps of up to so many nodes and edges are walked as arrays of one row
ROW_NODES, ROW_EDGES = 64, 256


def _gathered(rows: DataFrame, value: Column, most: int, name: str) -> DataFrame:
    """step, `name`: its sorted values, and n_`name`, their number; a step of more than `most` has none of them."""
    counted = rows.withColumn("_n", F.count("*").over(Window.partitionBy("step")))
    return counted.groupBy("step").agg(F.max("_n").alias(f"n_{name}"), F.array_sort(F.collect_list(F.when(F.col("_n") <= most, value))).alias(name))


def _let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def _packed(nodes: DataFrame, edges: DataFrame, data: Column) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(step, nodes: array of ordinal and data in order, near: for each node an array of feature and place of its neighbours), and the nodes and edges of steps
    that are too large for a row, or None."""
    kind = dict(edges.dtypes)
    a = _gathered(nodes, F.struct("ordinal", data.alias("data")), ROW_NODES, "nodes")
    b = _gathered(edges, F.struct("a", "b", "feature"), ROW_EDGES, "edges")
    both = a.join(b, "step", "left")
    small = (F.col("n_nodes") <= ROW_NODES) & (F.coalesce("n_edges", F.lit(0)) <= ROW_EDGES)
    links = F.coalesce("edges", F.array().cast(f"array<struct<a:{kind['a']},b:{kind['b']},feature:{kind['feature']}>>"))
    place = lambda of: F.array_position(F.transform("nodes", lambda x: x["ordinal"]), of).cast("int") - 1
    way = lambda x, y: F.transform(links, lambda e: F.struct(place(e[x]).alias("of"), e["feature"].alias("feature"), place(e[y]).alias("at")))
    ways = F.concat(way("a", "b"), way("b", "a"))
    near = lambda ws: F.transform("nodes", lambda n, i: F.transform(F.filter(ws, lambda w: (w["of"] == i) & (w["at"] >= 0)), lambda w: F.struct(w["feature"].alias("feature"), w["at"].alias("at"))))
    # near is written too: a projection of it would be worked out again wherever a body names it
    both = written(both.select("step", small.alias("small"), "nodes", F.when(small, _let(ways, near)).alias("near")), "packed")
    rows = both.where("small").select("step", "nodes", "near")
    large = both.where("not small").select("step")
    if large.isEmpty():
        return rows, None, None
    return rows, nodes.join(large, "step", "left_semi"), edges.join(large, "step", "left_semi")


def neighbour_shares(nodes: DataFrame, edges: DataFrame, types: list[str], least: float = 0.24) -> DataFrame:
    """step, ordinal, shares by type among the neighbours, adjacent: the first two types, in order, with a share of at least `least`."""
    near = both_ways(edges).select("step", F.col("a").alias("ordinal"), F.col("b")).join(nodes.select("step", F.col("ordinal").alias("b"), "geometry_type"), ["step", "b"])
    counts = near.groupBy("step", "ordinal").agg(F.count("*").alias("n"), *[F.count_if(F.col("geometry_type") == t).alias(f"n_{t}") for t in types])
    share = lambda t: F.coalesce(F.col(f"n_{t}"), F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    found = nodes.select("step", "ordinal").join(counts, ["step", "ordinal"], "left").select("step", "ordinal", *[share(t).alias(t) for t in types])
    often = F.filter(F.array(*[F.when(F.col(t) >= least, F.lit(t)) for t in types]), lambda x: x.isNotNull())
    return found.withColumn("adjacent", F.slice(often, 1, 2))


def neighbour_mean(nodes: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """step, ordinal, mean of the neighbours' values; a node without neighbours has 0."""
    near = both_ways(edges).select("step", F.col("a").alias("ordinal"), "b").join(nodes.select("step", F.col("ordinal").alias("b"), F.col(value).alias("v")), ["step", "b"])
    mean = near.groupBy("step", "ordinal").agg(F.avg("v").alias("mean"))
    return nodes.select("step", "ordinal").join(mean, ["step", "ordinal"], "left").withColumn("mean", F.coalesce("mean", F.lit(0.0)))


def orbits(nodes: DataFrame, signature: list[str]) -> DataFrame:
    """step, orbit, members: nodes of equal signature, groups in the order of their first member."""
    groups = nodes.groupBy("step", *signature).agg(F.sort_array(F.collect_list("ordinal")).alias("members"))
    order = Window.partitionBy("step").orderBy(F.col("members")[0])
    return groups.select("step", (F.row_number().over(order) - 1).alias("orbit"), "members")


def two_owner_edges(owners: DataFrame) -> DataFrame:
    """a, b of edges (edge, face) that exactly two distinct faces own."""
    each = owners.distinct().groupBy("edge").agg(F.count("*").alias("n"), F.min("face").alias("a"), F.max("face").alias("b"))
    return each.where("n = 2").select("edge", "a", "b")


def refined(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """step, ordinal, colour after rounds of colour refinement over (edge feature, neighbour colour).

    Steps that fit a row are refined as arrays, so their rows move once; those of larger ones meet by joins.
    """
    rows, more_nodes, more_edges = _packed(nodes, edges, F.sha2("label", 256))

    def step(colours, _):
        seen = lambda ns: F.array_join(F.array_sort(F.transform(ns, lambda x: F.concat_ws(":", x["feature"], F.get(colours, x["at"])))), ",")
        return F.transform(colours, lambda c, i: F.sha2(F.concat_ws("|", c, seen(F.get("near", i))), 256))

    colours = F.transform("nodes", lambda x: x["data"])
    if rounds:
        colours = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), colours, step)
    each = F.arrays_zip(F.transform("nodes", lambda x: x["ordinal"]).alias("ordinal"), colours.alias("colour"))
    out = rows.select("step", F.inline(each))
    return out if more_nodes is None else out.unionByName(_refined_by_joins(more_nodes, more_edges, rounds))


def _refined_by_joins(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    colour = nodes.select("step", "ordinal", F.sha2("label", 256).alias("colour"))
    links = both_ways(edges)
    for _ in range(rounds):
        near = links.join(colour.select("step", F.col("ordinal").alias("b"), F.col("colour").alias("c")), ["step", "b"])
        seen = near.groupBy("step", F.col("a").alias("ordinal")).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "feature", "c"))), ",").alias("seen"))
        colour = colour.join(seen, ["step", "ordinal"], "left").select("step", "ordinal", F.sha2(F.concat_ws("|", "colour", F.coalesce("seen", F.lit(""))), 256).alias("colour"))
    return colour


def commitments(nodes: DataFrame, signature) -> DataFrame:
    """step, nodes, commitment: a hash of the sorted signatures of a part's nodes."""
    each = nodes.select("step", signature.alias("s")).groupBy("step")
    return each.agg(F.count("*").alias("nodes"), F.sha2(F.array_join(F.sort_array(F.collect_list("s")), "\n"), 256).alias("commitment"))


def frames(faces: DataFrame) -> DataFrame:
    """part, lo, hi, diagonal and area-weighted centroid of faces (part, center, half, area); sides are 1e-6 at least."""
    lo = [F.min(F.col("center")[i] - F.col("half")[i]).alias(f"lo{i}") for i in range(3)]
    hi = [F.max(F.col("center")[i] + F.col("half")[i]).alias(f"hi{i}") for i in range(3)]
    mid = [F.try_divide(F.sum(F.col("area") * F.col("center")[i]), F.sum("area")).alias(f"c{i}") for i in range(3)]
    out = faces.groupBy("part").agg(*lo, *hi, *mid, F.sum("area").alias("area"))
    side = lambda i: F.greatest(F.col(f"hi{i}") - F.col(f"lo{i}"), F.lit(1e-6))
    return out.withColumn("diagonal", F.sqrt(side(0) * side(0) + side(1) * side(1) + side(2) * side(2)))


def complexity(faces: DataFrame) -> DataFrame:
    """part, score: faces, and 10 for each helical, 4 for each spline, 0.15 for the most edges of one."""
    return faces.groupBy("part").agg(
        (F.count("*") + 10 * F.count_if("helical") + 4 * F.count_if(F.col("surface_type") == "spline") + 0.15 * F.max("edge_count")).alias("score")
    )


def pooled(members: DataFrame) -> DataFrame:
    """part, group, mean of value weighted by the softmax of logit in its group."""
    top = F.max("logit").over(Window.partitionBy("part", "group"))
    weighted = members.withColumn("w", F.exp(F.col("logit") - top))
    return weighted.groupBy("part", "group").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("mean"))


def kept_faces(faces: DataFrame, share: float, least_radius: float) -> DataFrame:
    """Faces whose area is at least `share` of the largest of their type in the part, cylinders of at least a radius, and nothing
    helical, of splines or marked as not mating."""
    largest = F.max("area").over(Window.partitionBy("part", "surface_type"))
    wide = faces.withColumn("largest", largest)
    return wide.where(
        (F.col("area") >= F.col("largest") * share) & ((F.col("surface_type") != "cylinder") | (F.col("radius") >= least_radius)) & ~F.col("helical") & (F.col("surface_type") != "spline") & ~F.col("non_mating")
    ).drop("largest")


def cylinder_kind(concavity, helical, thread_hint, radius, edge_count, largest_threaded: float):
    """threaded_hole, hole or pin, as a column."""
    threaded = thread_hint | helical | ((concavity < 0) & (radius <= largest_threaded) & (edge_count >= 8))
    return F.when((concavity < 0) & F.coalesce(threaded, F.lit(False)), "threaded_hole").when(concavity < 0, "hole").otherwise("pin")


def named_sockets(sockets: DataFrame) -> DataFrame:
    """Sockets (part, face, kind, score) with names kind_00, kind_01, ... from the best score down."""
    order = Window.partitionBy("part", "kind").orderBy(F.desc("score"), "face")
    return sockets.withColumn("name", F.concat_ws("_", "kind", F.lpad((F.row_number().over(order) - 1).cast("string"), 2, "0")))


def intrinsic_graph(faces: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, face, area_fraction, perimeter, mean_curvature, gaussian_curvature, wires, edges, curvature_known) and (part, source, target, length, cosine, sine), free of scale.

    faces (part, face, area, perimeter, mean_curvature, gaussian_curvature, wires, edges), edges (part, a, b, length, cosine): of these, those between two of the faces.
    Lengths are in square roots of the part's area, curvatures in its inverse; a part without area has null features.
    """
    total = F.sum("area").over(Window.partitionBy("part"))
    rows = faces.withColumn("total", F.when(total > 0, total)).withColumn("scale", F.sqrt("total"))
    nodes = rows.select(
        "part", "face", F.try_divide(F.col("area"), F.col("total")).alias("area_fraction"), F.try_divide(F.col("perimeter"), F.col("scale")).alias("perimeter"),
        (F.col("mean_curvature") * F.col("scale")).alias("mean_curvature"), (F.col("gaussian_curvature") * F.col("total")).alias("gaussian_curvature"), "wires", "edges",
        (F.col("mean_curvature").isNotNull() & F.col("gaussian_curvature").isNotNull()).alias("curvature_known"),
    )
    ends = rows.select("part", F.col("face").alias("a"), "scale")
    inside = edges.join(ends, ["part", "a"]).join(ends.select("part", F.col("a").alias("b")), ["part", "b"])
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cosine")))
    out = inside.select("part", F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), F.try_divide(F.col("length"), F.col("scale")).alias("length"), cosine.alias("cosine"))
    return nodes, out.withColumn("sine", F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("cosine") * F.col("cosine"))))


def face_order(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """step, ordinal, colour, place: nodes in the order of their refined colours, ties by ordinal.

    Colours are ranks of the key, then of the key with the sorted (feature, colour) of the neighbours, until a round changes none, or
    after as many rounds as a step has nodes, as ranks may go on to change places.  Steps that fit a row are ordered as arrays, so their
    rows move once; those of larger ones meet by joins.
    """
    rows, more_nodes, more_edges = _packed(nodes, edges.where("a <> b"), F.struct(*key))

    def ranks(values):
        return _let(values, lambda vs: _let(F.array_sort(F.array_distinct(vs)), lambda order: F.transform(vs, lambda v: F.array_position(order, v).cast("int") - 1)))

    def step(state, _):
        seen = lambda ns: F.array_sort(F.transform(ns, lambda x: F.struct(x["feature"].alias("feature"), F.get(state["c"], x["at"]).alias("c"))))
        new = ranks(F.transform("nodes", lambda n, i: F.struct(n["data"].alias("key"), seen(F.get("near", i)).alias("seen"))))
        return F.when(state["done"], state).otherwise(_let(new, lambda c: F.struct(c.alias("c"), (c == state["c"]).alias("done"))))

    start = F.struct(ranks(F.transform("nodes", lambda n: n["data"])).alias("c"), F.lit(False).alias("done"))
    colours = F.aggregate(F.sequence(F.lit(1), F.size("nodes")), start, step)["c"]
    turns = F.transform("colours", lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    places = _let(turns, lambda ts: _let(F.array_sort(ts), lambda order: F.transform(ts, lambda t: F.array_position(order, t).cast("int") - 1)))
    each = F.arrays_zip(F.transform("nodes", lambda n: n["ordinal"]).alias("ordinal"), F.col("colours").alias("colour"), places.alias("place"))
    out = rows.withColumn("colours", colours).select("step", F.inline(each))
    return out if more_nodes is None else out.unionByName(_face_order_by_joins(more_nodes, more_edges, key))


def _face_order_by_joins(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    of_step = Window.partitionBy("step")
    colour = written(nodes.select("step", "ordinal", *key, (F.dense_rank().over(of_step.orderBy(*key)) - 1).alias("colour"), F.count("*").over(of_step).alias("n")), "colours")
    links = both_ways(edges.where("a <> b"))
    none = F.array().cast(f"array<struct<feature:{dict(edges.dtypes)['feature']},c:int>>")
    for i in range(colour.agg(F.max("n")).first()[0] or 0):
        near = links.join(colour.select("step", F.col("ordinal").alias("b"), F.col("colour").alias("c")), ["step", "b"])
        seen = near.groupBy("step", F.col("a").alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct("feature", "c"))).alias("seen"))
        keyed = colour.join(seen, ["step", "ordinal"], "left").withColumn("seen", F.coalesce("seen", none))
        new = F.when(F.col("n") > i, F.dense_rank().over(of_step.orderBy(*key, "seen")) - 1).otherwise(F.col("colour"))
        ranked = written(keyed.withColumn("new", new).select("step", "ordinal", *key, "colour", "new", "n"), "colours")
        colour = ranked.drop("colour").withColumnRenamed("new", "colour")
        if ranked.where("colour <> new").isEmpty():
            break
    place = F.row_number().over(of_step.orderBy("colour", "ordinal")) - 1
    return colour.select("step", "ordinal", "colour", place.alias("place"))


def hops(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """step, ordinal, hop: the least number of edges from a centre (step, ordinal) to each node that can be reached."""
    links = both_ways(edges).select("step", "a", "b")
    found = written(centres.select("step", "ordinal", F.lit(0).alias("hop")).distinct(), "hops")
    frontier, hop = found, 0
    while True:
        hop += 1
        step = frontier.select("step", F.col("ordinal").alias("a")).join(links, ["step", "a"]).select("step", F.col("b").alias("ordinal")).distinct()
        frontier = written(step.join(found, ["step", "ordinal"], "left_anti").withColumn("hop", F.lit(hop)), "hops")
        if frontier.isEmpty():
            return found
        found = written(found.unionByName(frontier), "hops")


def _shells(edges: DataFrame, centres: DataFrame) -> DataFrame:
    """step, hop, f, e: the nodes at each number of hops from a step's centres, and the edges between them and nodes as near or nearer; a step that fits a row is walked as
    arrays, the hops of larger ones meet by joins."""
    kind = dict(edges.dtypes)
    b = _gathered(edges, F.struct("a", "b"), ROW_EDGES, "edges")
    a = _gathered(centres.select("step", "ordinal").distinct(), F.col("ordinal"), ROW_NODES, "centres")
    both = written(a.join(b, "step", "left").withColumn("edges", F.coalesce("edges", F.array().cast(f"array<struct<a:{kind['a']},b:{kind['b']}>>"))), "packed")
    small = (F.col("n_centres") <= ROW_NODES) & (F.coalesce("n_edges", F.lit(0)) <= ROW_EDGES)

    def step(state, _):
        ends = lambda last, x, y: F.transform(F.filter("edges", lambda e: F.array_contains(last, e[x])), lambda e: e[y])
        grown = lambda last: F.when(F.size(last) == 0, state).otherwise(F.concat(state, F.array(F.array_except(F.concat(ends(last, "a", "b"), ends(last, "b", "a")), F.flatten(state)))))
        return _let(F.element_at(state, -1), grown)

    shells = F.filter(F.aggregate(F.sequence(F.lit(0), F.size("edges")), F.array("centres"), step), lambda s: F.size(s) > 0)

    def row(shell, hop):
        inside = lambda so_far: F.size(F.filter("edges", lambda e: (e["a"] != e["b"]) & (F.array_contains(shell, e["a"]) | F.array_contains(shell, e["b"])) & F.array_contains(so_far, e["a"]) & F.array_contains(so_far, e["b"])))
        return F.struct(hop.alias("hop"), F.size(shell).cast("long").alias("f"), _let(F.flatten(F.slice("shells", 1, hop + 1)), inside).cast("long").alias("e"))

    out = both.where(small).select("step", "edges", shells.alias("shells")).select("step", F.inline(F.transform("shells", row)))
    large = both.where(~small).select("step")
    if large.isEmpty():
        return out
    return out.unionByName(_shells_by_joins(edges.join(large, "step", "left_semi"), centres.join(large, "step", "left_semi")))


def _shells_by_joins(edges: DataFrame, centres: DataFrame) -> DataFrame:
    at = written(hops(edges, centres), "hops")
    end = lambda c: at.select("step", F.col("ordinal").alias(c), F.col("hop").alias(f"hop_{c}"))
    inner = edges.where("a <> b").join(end("a"), ["step", "a"]).join(end("b"), ["step", "b"]).groupBy("step", F.greatest("hop_a", "hop_b").alias("hop")).agg(F.count("*").alias("e"))
    return at.groupBy("step", "hop").agg(F.count("*").alias("f")).join(inner, ["step", "hop"], "left").withColumn("e", F.coalesce("e", F.lit(0)))


def endpoint_shells(edges: DataFrame, centres: DataFrame, most_hops: int = 4, most_faces: int = 1024, most_edges: int = 4096) -> DataFrame:
    """One ledger row of each step: how much of what its centres reach is taken, shell by whole shell, while hops, faces and edges keep to the bounds.

    step, faces, edges (of the component), taken_faces, taken_edges, radius, complete, reason, omitted_frontier, omitted_faces.  reason: none, max_hop_radius,
    face_or_edge_budget, or one_hop_budget where even the first hop does not fit, and nothing is taken.
    """
    shells = _shells(edges, centres)
    so_far = Window.partitionBy("step").orderBy("hop").rowsBetween(Window.unboundedPreceding, 0)
    shells = shells.withColumn("cf", F.sum("f").over(so_far)).withColumn("ce", F.sum("e").over(so_far))
    small = (F.col("cf") <= most_faces) & (F.col("ce") <= most_edges)
    fails = F.min(F.when((F.col("hop") > most_hops) | ~small, F.col("hop"))).over(Window.partitionBy("step"))
    rows = shells.withColumn("stop", fails).withColumn("early", F.coalesce((F.col("stop") <= 1) & (F.col("stop") <= most_hops), F.lit(False)))
    taken = (F.col("stop").isNull() | (F.col("hop") < F.col("stop"))) & ~F.col("early")
    add = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    first = (F.col("hop") == F.col("stop")) & ~F.col("early")
    out = rows.groupBy("step").agg(
        F.sum("f").alias("faces"), F.sum("e").alias("edges"), add("f", taken).alias("taken_faces"), add("e", taken).alias("taken_edges"), F.max(F.when(taken, F.col("hop"))).alias("radius"),
        F.max("stop").alias("stop"), F.bool_or("early").alias("early"), add("f", first).alias("omitted_frontier"),
    )
    reason = F.when(F.col("early"), "one_hop_budget").when(F.col("stop").isNull(), "none").when(F.col("stop") > most_hops, "max_hop_radius").otherwise("face_or_edge_budget")
    return out.select(
        "step", "faces", "edges", "taken_faces", "taken_edges", F.coalesce("radius", F.lit(-1)).alias("radius"), (F.col("taken_faces") == F.col("faces")).alias("complete"), reason.alias("reason"),
        "omitted_frontier", (F.col("faces") - F.col("taken_faces")).alias("omitted_faces"),
    )


def model_views(nodes: DataFrame, edges: DataFrame | None, signature) -> DataFrame:
    """step, nodes, edges, view: a hash of a part's nodes by ordinal and of its edges, ends in order, sorted with their features; like edges stay apart.
    Without edges the nodes have `links`, an array of a, b and feature, and an edge stands at one of them: so the nodes are read once."""
    listed = [F.count("*").alias("nodes"), F.array_sort(F.collect_list(F.struct("ordinal", signature.alias("s")))).alias("n")]
    if edges is None:
        both = nodes.groupBy("step").agg(*listed, F.flatten(F.collect_list("links")).alias("e"))
        ends = F.transform("e", lambda x: F.struct(F.least(x["a"], x["b"]).alias("source"), F.greatest(x["a"], x["b"]).alias("target"), x["feature"].alias("feature")))
        both = both.select("step", "nodes", "n", F.size("e").cast("long").alias("edges"), F.array_sort(ends).alias("e"))
    else:
        rows = edges.select("step", F.least("a", "b").alias("source"), F.greatest("a", "b").alias("target"), "feature").groupBy("step").agg(F.count("*").alias("edges"), F.array_sort(F.collect_list(F.struct("source", "target", "feature"))).alias("e"))
        both = nodes.groupBy("step").agg(*listed).join(rows, "step", "left")
    text = lambda c, f: F.array_join(F.transform(c, f), ",")
    parts = F.concat_ws("|", text("n", lambda x: x["s"]), F.coalesce(text("e", lambda x: F.concat_ws("-", x["source"], x["target"], x["feature"])), F.lit("")))
    return both.select("step", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.sha2(parts, 256).alias("view"))
