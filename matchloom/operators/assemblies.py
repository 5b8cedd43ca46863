"""Assemblies: walks over request graphs, poses along them, the bounded pose search and its audit.

A request's graph is a few roles and edges, so it travels as arrays in one row per query; what may be many, poses and search
states, are rows of their own.  Any number of roles, and any edges between them, will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.vectors import inverse, multiplied, rotation_angle, total
from matchloom.sources.tables import written

_UNIT = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
_AXES = range(3)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def graph_walk(roles: DataFrame, edges: DataFrame) -> DataFrame:
    """query, roles, order, tree, closing, connected.

    roles (query, role) and edges (query, edge, role_a, role_b).  The walk starts at the least role and takes the roles in the order in
    which it meets them, neighbours by role, then edge.  tree: its steps (parent, child, edge); closing: the other
    edges in order.  A query without edges has an empty tree.
    """
    kind = dict(edges.dtypes)
    way = lambda a, b: edges.select("query", F.struct(F.col(a).alias("near"), F.col(b).alias("far"), "edge").alias("way"))
    ways = way("role_a", "role_b").unionByName(way("role_b", "role_a")).groupBy("query").agg(F.array_sort(F.collect_list("way")).alias("ways"))
    nodes = roles.groupBy("query").agg(F.array_sort(F.collect_set("role")).alias("roles"))
    whole = nodes.join(ways, "query", "left").withColumn("ways", F.coalesce("ways", F.array().cast(f"array<struct<near:{kind['role_a']},far:{kind['role_a']},edge:{kind['edge']}>>")))
    none = F.array().cast(f"array<struct<parent:{kind['role_a']},child:{kind['role_a']},edge:{kind['edge']}>>")

    def step(state, i):
        def grown(role):
            open_ = F.filter("ways", lambda w: (w["near"] == role) & ~F.array_contains(state["order"], w["far"]))
            # parallel edges: the first alone
            first = let(open_, lambda ws: F.filter(ws, lambda w, j: (j == 0) | (w["far"] != F.get(ws, j - 1)["far"])))
            return let(first, lambda ws: F.struct(
                F.concat(state["order"], F.transform(ws, lambda w: w["far"])).alias("order"),
                F.concat(state["tree"], F.transform(ws, lambda w: F.struct(role.alias("parent"), w["far"].alias("child"), w["edge"].alias("edge")))).alias("tree"),
            ))

        return F.when(i < F.size(state["order"]), let(F.get(state["order"], i), grown)).otherwise(state)

    start = F.struct(F.slice("roles", 1, 1).alias("order"), none.alias("tree"))
    walked = whole.withColumn("w", F.aggregate(F.sequence(F.lit(0), F.size("roles") - 1), start, step))
    closing = F.array_sort(F.array_distinct(F.transform(F.filter("ways", lambda w: ~F.exists("w.tree", lambda t: t["edge"] == w["edge"])), lambda w: w["edge"])))
    return walked.select("query", "roles", "w.order", "w.tree", closing.alias("closing"), (F.size("w.order") == F.size("roles")).alias("connected"))


def _oriented(parent: Column, child: Column, pose: Column, forward: Column) -> Column:
    """The child's world pose from its parent's and the edge's pose, which leads from role_a to role_b."""
    return let(F.struct(parent.alias("p"), pose.alias("r")), lambda s: F.when(forward, multiplied(s["p"], s["r"])).otherwise(let(inverse(s["r"]), lambda r: multiplied(s["p"], r))))


def composed(walk: DataFrame, poses: DataFrame) -> DataFrame:
    """query, role, world: poses of roles along the walk's tree; poses (query, edge, role_a, role_b, pose), the root stands at the origin."""
    of = poses.groupBy("query").agg(F.collect_list(F.struct("edge", "role_a", "pose")).alias("given"))
    rows = walk.join(of, "query", "left")
    root = F.array(F.struct(F.get("roles", F.lit(0)).alias("role"), F.array(*map(F.lit, _UNIT)).alias("world")))

    def step(state, t):
        parent = F.get(F.filter(state, lambda x: x["role"] == t["parent"]), 0)["world"]
        given = F.get(F.filter("given", lambda g: g["edge"] == t["edge"]), 0)
        world = let(given, lambda g: _oriented(parent, t["child"], g["pose"], g["role_a"] == t["parent"]))
        return F.concat(state, F.array(F.struct(t["child"].alias("role"), world.alias("world"))))

    return rows.select("query", F.explode(F.aggregate("tree", root, step)).alias("x")).select("query", "x.role", "x.world")


def closures(worlds: DataFrame, poses: DataFrame, shift: float = 1e-5, turn: float = 1e-6) -> DataFrame:
    """query, edge, shift_error, turn_error, within: how far each edge's pose is off the roles' world poses."""
    at = lambda side: worlds.select("query", F.col("role").alias(f"role_{side}"), F.col("world").alias(f"world_{side}"))
    both = poses.join(at("a"), ["query", "role_a"]).join(at("b"), ["query", "role_b"])
    wanted = both.withColumn("wanted", multiplied(F.col("world_a"), F.col("pose")))
    off = F.sqrt(sum(((F.col("wanted")[i] - F.col("world_b")[i]) ** 2 for i in (3, 7, 11)), F.lit(0.0)))
    out = wanted.select("query", "edge", off.alias("shift_error"), rotation_angle(F.col("wanted"), F.col("world_b")).alias("turn_error"))
    return out.withColumn("within", (F.col("shift_error") <= shift) & (F.col("turn_error") <= turn))


def aligned(predicted: DataFrame, reference: DataFrame) -> DataFrame:
    """query, role, world, reference, status: predicted poses (query, role, world) carried into the reference's frame by the least role's two poses.

    A query whose predicted roles are not the reference's keeps its rows with status role_domain and no poses; else aligned.
    """
    both = reference.withColumnRenamed("world", "reference").join(predicted.withColumnRenamed("world", "given"), ["query", "role"], "full_outer")
    whole = both.groupBy("query").agg(F.bool_and(F.col("given").isNotNull() & F.col("reference").isNotNull()).alias("whole"), F.min_by(F.struct("reference", "given"), "role").alias("anchor"))
    rows = both.join(whole, "query")
    gauge = let(F.struct(F.col("anchor.reference").alias("r"), F.col("anchor.given").alias("g"), F.col("given").alias("x")), lambda s: let(inverse(s["g"]), lambda i: let(multiplied(s["r"], i), lambda m: multiplied(m, s["x"]))))
    return rows.select("query", "role", F.when(F.col("whole"), gauge).alias("world"), F.when(F.col("whole"), F.col("reference")).alias("reference"), F.when(F.col("whole"), "aligned").otherwise("role_domain").alias("status"))


def accepted_options(edges: DataFrame, picks: DataFrame, execution: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, edges, accepted, status) and (query, edge, role_a, role_b, option, pose_rank, pose).

    execution (query, edge, hypothesis_rank, candidate_a, candidate_b, accepted, pose_rank, pose): of its accepted rows of hypothesis 0, an edge's
    poses in the order of their rank, equal ones (at 12 digits) once.  status: identity_differs if such a row's candidates are not the picks (query, role,
    candidate), duplicate if a pose rank comes twice, unknown_incomplete_pair_execution if an edge has none, else complete.
    """
    pick = lambda side: picks.select("query", F.col("role").alias(f"role_{side}"), F.col("candidate").alias(f"pick_{side}"))
    known = edges.select("query", "edge", "role_a", "role_b").join(pick("a"), ["query", "role_a"], "left").join(pick("b"), ["query", "role_b"], "left")
    rows = known.join(execution.where("accepted and hypothesis_rank = 0").drop("hypothesis_rank", "accepted"), ["query", "edge"], "left")
    given = F.col("pose").isNotNull()
    each = rows.groupBy("query", "edge").agg(
        F.bool_or(given & ~(F.col("candidate_a").eqNullSafe(F.col("pick_a")) & F.col("candidate_b").eqNullSafe(F.col("pick_b")))).alias("differs"),
        F.count(F.when(given, F.lit(1))).alias("n"), F.count_distinct(F.when(given, F.coalesce("pose_rank", F.lit(0)))).alias("ranks"),
    )
    status = F.when(F.bool_or("differs"), "identity_differs").when(F.bool_or(F.col("n") > F.col("ranks")), "duplicate")
    status = status.when(F.min("n") == 0, "unknown_incomplete_pair_execution").otherwise("complete")
    verdicts = each.groupBy("query").agg(F.count("*").alias("edges"), F.count_if(F.col("n") > 0).alias("accepted"), status.alias("status"))
    key = F.transform("pose", lambda x: F.round(x, 12) + 0.0)
    first = Window.partitionBy("query", "edge", "key").orderBy("pose_rank")
    distinct = rows.where(given).withColumn("key", key).withColumn("turn", F.row_number().over(first)).where("turn = 1")
    place = F.row_number().over(Window.partitionBy("query", "edge").orderBy("pose_rank")) - 1
    return verdicts, distinct.select("query", "edge", "role_a", "role_b", place.alias("option"), "pose_rank", "pose")


def world_box(world: Column, lo: Column, hi: Column) -> Column:
    """The box round a box (lo, hi) that stands at a world pose, as a struct of lo and hi."""
    def moved(s):
        mid = [(s["lo"][i] + s["hi"][i]) / 2 for i in _AXES]
        half = [(s["hi"][i] - s["lo"][i]) / 2 for i in _AXES]
        at = [sum((s["w"][4 * i + j] * mid[j] for j in _AXES), s["w"][4 * i + 3]) for i in _AXES]
        reach = [sum((F.abs(s["w"][4 * i + j]) * half[j] for j in _AXES), F.lit(0.0)) for i in _AXES]
        return F.struct(F.array(*[at[i] - reach[i] for i in _AXES]).alias("lo"), F.array(*[at[i] + reach[i] for i in _AXES]).alias("hi"))

    return let(F.struct(world.alias("w"), lo.alias("lo"), hi.alias("hi")), moved)


def shared_volume(a: Column, b: Column) -> Column:
    """What two boxes (structs of lo and hi) share; 0 if they only touch."""
    out = F.lit(1.0)
    for i in _AXES:
        out = out * F.greatest(F.lit(0.0), F.least(a["hi"][i], b["hi"][i]) - F.greatest(a["lo"][i], b["lo"][i]))
    return out


def pose_search(
    walk: DataFrame, options: DataFrame, boxes: DataFrame, budget: int = 512, volume: float = 1e-7, shift: float = 1e-5, turn: float = 1e-6
) -> tuple[DataFrame, DataFrame]:
    """(query, status, search_status, explored, collision_pruned, closure_pruned, truncated, closure_edges) and the found
    (query, worlds: array of role, world, lo, hi; chosen: array of edge, option, pose_rank).

    Step by step of the walk's tree every state is grown by each option of the step's edge.  A state whose new box (boxes: query, role, lo, hi)
    shares more than `volume` with one placed before is pruned; of the rest the `budget` least by their choices stay.  Then each
    closing edge must have an option that agrees with the world poses.  The least state left is the result.
    """
    steps, closes = walk.where("connected").agg(F.max(F.size("tree")), F.max(F.size("closing"))).first()
    box = boxes.select("query", F.col("role").alias("child"), "lo", "hi")
    unit = F.array(*map(F.lit, _UNIT))
    kind = dict(options.dtypes)
    none = F.array().cast(f"array<struct<edge:{kind['edge']},option:int,pose_rank:{kind['pose_rank']}>>")
    root = F.array(F.struct(F.col("child").alias("role"), unit.alias("world"), "lo", "hi"))
    states = walk.where("connected").withColumn("child", F.get("roles", F.lit(0))).join(box, ["query", "child"]).select("query", "tree", "closing", root.alias("worlds"), none.alias("chosen"))
    carried = ["query", "tree", "closing", "worlds", "chosen"]
    given = options.select("query", "edge", "role_a", "role_b", "option", "pose_rank", "pose")
    ledgers: list[DataFrame] = []
    of = lambda role: F.get(F.filter("worlds", lambda x: x["role"] == role), 0)
    picked = F.concat("chosen", F.array(F.struct("edge", F.col("option").cast("int").alias("option"), "pose_rank")))

    def kept(grown: DataFrame, idle: DataFrame, name: str) -> DataFrame:
        """The least states of each query; what was tried and pruned goes to the ledger."""
        order = Window.partitionBy("query").orderBy(F.transform("chosen", lambda c: c["option"]))
        rows = written(grown.withColumn("place", F.when(~F.col("bad"), F.row_number().over(order.partitionBy("query", "bad")))), name)
        ledgers.append(rows.groupBy("query").agg(
            F.count("*").alias("explored"), F.count_if(F.col("bad")).alias(name), F.greatest(F.max("place") - budget, F.lit(0)).alias("truncated")
        ))
        return idle.select(*carried).unionByName(rows.where(F.col("place") <= budget).select(*carried))

    for i in range(steps or 0):
        idle, busy = states.where(F.size("tree") <= i), states.where(F.size("tree") > i)
        t = F.get("tree", F.lit(i))
        grown = busy.select("*", t["parent"].alias("parent"), t["child"].alias("child"), t["edge"].alias("edge")).join(given, ["query", "edge"]).join(box, ["query", "child"])
        grown = grown.withColumn("world", _oriented(of(F.col("parent"))["world"], F.col("child"), F.col("pose"), F.col("role_a") == F.col("parent")))
        grown = grown.withColumn("at", world_box(F.col("world"), F.col("lo"), F.col("hi")))
        bad = F.exists("worlds", lambda w: shared_volume(w, F.col("at")) > volume)
        placed = F.concat("worlds", F.array(F.struct(F.col("child").alias("role"), "world", "at.lo", "at.hi")))
        states = kept(grown.select("query", "tree", "closing", bad.alias("bad"), placed.alias("worlds"), picked.alias("chosen")), idle, "collision_pruned")
    states = written(states, "placed")
    through = states.select("query").distinct().withColumn("through", F.lit(True))
    for i in range(closes or 0):
        idle, busy = states.where(F.size("closing") <= i), states.where(F.size("closing") > i)
        grown = busy.withColumn("edge", F.get("closing", F.lit(i))).join(given, ["query", "edge"])
        wanted = let(F.struct(of(F.col("role_a"))["world"].alias("p"), F.col("pose").alias("r")), lambda s: multiplied(s["p"], s["r"]))
        grown = grown.withColumn("wanted", wanted).withColumn("real", of(F.col("role_b"))["world"])
        off = F.sqrt(total(F.transform(F.array(*map(F.lit, (3, 7, 11))), lambda j: F.pow(F.get("wanted", j) - F.get("real", j), F.lit(2.0)))))
        bad = (off > shift) | (rotation_angle(F.col("wanted"), F.col("real")) > turn)
        states = kept(grown.select("query", "tree", "closing", bad.alias("bad"), "worlds", picked.alias("chosen")), idle, "closure_pruned")

    order = Window.partitionBy("query").orderBy(F.transform("chosen", lambda c: c["option"]))
    found = written(states.withColumn("t", F.row_number().over(order)).where("t = 1").select("query", "worlds", "chosen"), "found")
    out = walk.select("query", "connected", F.size("closing").alias("closure_edges"))
    sums = None
    for ledger in ledgers:
        for c in ("collision_pruned", "closure_pruned"):
            if c not in ledger.columns:
                ledger = ledger.withColumn(c, F.lit(0))
        sums = ledger if sums is None else sums.unionByName(ledger)
    names = ["explored", "collision_pruned", "closure_pruned", "truncated"]
    if sums is not None:
        out = out.join(sums.groupBy("query").agg(*[F.sum(c).alias(c) for c in names]), "query", "left")
    else:
        out = out.select("*", *[F.lit(None).cast("long").alias(c) for c in names])
    out = out.join(through, "query", "left").join(found.select("query", F.lit(True).alias("found")), "query", "left")
    late = F.col("through").isNotNull() & (F.col("closure_edges") > 0)
    failed = F.when(F.col("truncated") > 0, "unknown_bounded_no_global_pose").when(late, "rejected_no_cycle_consistent_global_pose").otherwise("rejected_no_collision_free_global_pose")
    status = F.when(~F.col("connected"), "unknown_pre_execution_error").when(F.col("found").isNotNull(), "accepted_global_assembly").otherwise(failed)
    search = F.when(~F.col("connected"), "pre_execution_error").when(F.col("found").isNotNull(), "collision_free_pose_found").when(late, "exhausted_during_cycle_closure").otherwise("exhausted_during_tree_placement")
    counts = [(F.coalesce(c, F.lit(0)) + (1 if c == "explored" else 0)).cast("long").alias(c) for c in names]
    return out.select("query", status.alias("status"), search.alias("search_status"), *counts, "closure_edges"), found


def pair_audit(placed: DataFrame, edges: DataFrame, volume: float = 1e-7) -> DataFrame:
    """query, role_a, role_b, functional, volume, collision_free of all pairs of an assembly's boxes; placed (query, role, lo, hi) in one frame."""
    side = lambda s: placed.select("query", F.col("role").alias(f"role_{s}"), F.struct("lo", "hi").alias(s))
    pairs = side("a").join(side("b"), "query").where("role_a < role_b")  # an assembly has few roles
    joined = edges.select("query", F.least("role_a", "role_b").alias("role_a"), F.greatest("role_a", "role_b").alias("role_b")).distinct().withColumn("functional", F.lit(True))
    found = pairs.join(joined, ["query", "role_a", "role_b"], "left").withColumn("volume", shared_volume(F.col("a"), F.col("b")))
    return found.select("query", "role_a", "role_b", F.coalesce("functional", F.lit(False)).alias("functional"), "volume", (F.col("volume") <= volume).alias("collision_free"))


def assembly_audit(walk: DataFrame, verdicts: DataFrame, options: DataFrame, edges: DataFrame, boxes: DataFrame, volume: float = 1e-7) -> DataFrame:
    """query, status, pairs, collisions, other_collisions of assemblies that stand by each edge's first pose.

    A query keeps its verdict unless that is complete; then unknown_disconnected_functional_graph, unknown_pose_graph_closure_failure,
    accepted_global_assembly or rejected_global_collision.  other_collisions are those between roles that no edge joins.
    """
    ready = walk.join(verdicts.where("status = 'complete'").select("query"), "query", "left_semi")
    first = options.where("option = 0")
    worlds = written(composed(ready.where("connected"), first), "worlds")
    closed = closures(worlds, first).groupBy("query").agg(F.bool_and("within").alias("closed"))
    at = worlds.join(boxes, ["query", "role"]).select("query", "role", world_box(F.col("world"), F.col("lo"), F.col("hi")).alias("at"))
    pairs = pair_audit(at.select("query", "role", "at.lo", "at.hi"), edges, volume)
    hits = pairs.groupBy("query").agg(F.count("*").alias("pairs"), F.count_if(~F.col("collision_free")).alias("collisions"), F.count_if(~F.col("collision_free") & ~F.col("functional")).alias("other_collisions"))
    every = verdicts.select("query", F.col("status").alias("given")).join(walk.select("query", "connected"), "query", "left").join(closed, "query", "left").join(hits, "query", "left")
    status = (
        F.when(F.col("given").isin("identity_differs", "duplicate"), "unknown_pre_execution_error").when(F.col("given") != "complete", F.col("given"))
        .when(~F.col("connected"), "unknown_disconnected_functional_graph").when(~F.col("closed"), "unknown_pose_graph_closure_failure")
        .when(F.coalesce("collisions", F.lit(0)) > 0, "rejected_global_collision").otherwise("accepted_global_assembly")
    )
    judged = F.col("status").isin("accepted_global_assembly", "rejected_global_collision")
    out = every.withColumn("status", status)
    return out.select("query", "status", *[F.when(judged, F.coalesce(c, F.lit(0))).alias(c) for c in ("pairs", "collisions", "other_collisions")])


def connection_evidence(edges: DataFrame, programs: DataFrame, options: DataFrame, chosen: DataFrame) -> DataFrame:
    """query, edge, role_a, role_b, mobility, support, primitive_a, primitive_b, pose_rank, pose, status: an edge's predicted program beside the pose
    that was chosen for it.

    programs (query, edge, mobility, support, primitive_a, primitive_b), chosen (query, edge, pose_rank).  status is complete if an edge has exactly one program,
    one choice and one pose of that rank, else it names what is missing or repeated first: program, choice, pose.
    """
    n = lambda df, name: df.groupBy("query", "edge").agg(F.count("*").alias(name))
    one = edges.select("query", "edge", "role_a", "role_b").join(n(programs, "programs"), ["query", "edge"], "left").join(n(chosen, "choices"), ["query", "edge"], "left")
    program = programs.groupBy("query", "edge").agg(*[F.min(c).alias(c) for c in ("mobility", "support", "primitive_a", "primitive_b")])
    pick = chosen.groupBy("query", "edge").agg(F.min("pose_rank").alias("pose_rank"))
    poses = options.groupBy("query", "edge", "pose_rank").agg(F.count("*").alias("poses"), F.first("pose").alias("pose"))
    rows = one.join(program, ["query", "edge"], "left").join(pick, ["query", "edge"], "left").join(poses, ["query", "edge", "pose_rank"], "left")
    single = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    status = F.when(~single("programs"), "program").when(~single("choices"), "choice").when(~single("poses"), "pose").otherwise("complete")
    return rows.select("query", "edge", "role_a", "role_b", "mobility", "support", "primitive_a", "primitive_b", "pose_rank", "pose", status.alias("status"))


def assembly_manifests(verdicts: DataFrame, found: DataFrame, picks: DataFrame, evidence: DataFrame) -> DataFrame:
    """query, status, anchor, components, connections, manifest, sha256.

    exported: an accepted assembly whose connections are all complete, its components (role, candidate, world) and connections in order as JSON text with its hash;
    incomplete_evidence: one with other connections; skipped: all others.
    """
    joins = evidence.groupBy("query").agg(
        F.bool_and(F.col("status") == "complete").alias("whole"),
        F.array_sort(F.collect_list(F.struct("edge", "role_a", "role_b", "mobility", "support", "primitive_a", "primitive_b", "pose_rank", "pose"))).alias("connections"),
    )
    places = found.select("query", F.explode("worlds").alias("w")).select("query", "w.role", "w.world").join(picks, ["query", "role"])
    parts = places.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("role", "candidate", "world"))).alias("components"))
    rows = verdicts.select("query", F.col("status").alias("verdict")).join(parts, "query", "left").join(joins, "query", "left")
    status = F.when(F.col("verdict") != "accepted_global_assembly", "skipped").when(F.coalesce("whole", F.lit(False)), "exported").otherwise("incomplete_evidence")
    rows = rows.withColumn("status", status).withColumn("anchor", F.get("components", F.lit(0))["role"])
    text = F.to_json(F.struct("query", "anchor", "components", "connections"))
    full = F.col("status") == "exported"
    rows = rows.withColumn("manifest", F.when(full, text))
    return rows.select(
        "query", "status", F.when(full, F.col("anchor")).alias("anchor"), F.when(full, F.size("components")).alias("components"),
        F.when(full, F.size("connections")).alias("connections"), "manifest", F.sha2("manifest", 256).alias("sha256"),
    )
