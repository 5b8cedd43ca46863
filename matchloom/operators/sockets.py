"""Sockets of parts: slots between parallel planes, stand-ins from the box, suppression of like ones, frames, and placing in the world.

Faces and sockets of a part are a bounded group, as a part's face count is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.vectors import canonical_direction, dot
from matchloom.sources.tables import written

from .assemblies import let
from .graphs import cylinder_kind

# Frame names by kind, and the sign of the end that each stands at.
END_FRAMES = [("end_plus", 1), ("end_minus", -1)]
HOLE_FRAMES = [
    ("entry_plus", 1), ("entry_minus", -1), ("seat_plus", 1), ("seat_minus", -1), ("through_plus", -1), ("through_minus", 1),
    ("through_stop_plus", -1), ("through_stop_minus", 1), ("hole_depth_stop_plus", -1), ("hole_depth_stop_minus", 1),
]
PIN_FRAMES = [
    ("tip_plus", 1), ("tip_minus", -1), ("stop_plus", -1), ("stop_minus", 1), ("shoulder_plus", -1), ("shoulder_minus", 1),
    ("pin_shoulder_plus", -1), ("pin_shoulder_minus", 1),
]
FLAT_KINDS, HOLE_KINDS, PIN_KINDS = ["plane", "flange_plane", "guide_slot"], ["hole", "threaded_hole"], ["pin", "axis"]


@dataclass(frozen=True)
class SlotRules:
    """What two planes must meet to hold a slot between them."""

    planes: int = 16
    area_share: float = 0.03
    parallel: float = 0.95
    gap: float = 0.2
    gap_share: float = 0.0015
    least_aspect: float = 3.0
    most_aspect: float = 40.0


@dataclass(frozen=True)
class Likeness:
    """How near two sockets must be to count as one."""

    origin: float = 0.2
    origin_share: float = 0.01
    coaxial: float = 0.96
    parallel: float = 0.95
    radius: float = 0.15
    radius_share: float = 0.06


@dataclass(frozen=True)
class ExtractionRules:
    """What a face must meet to make a socket, how candidates are clustered, and how many of a kind a part keeps."""

    area: float = 1e-3
    plane_share: float = 0.012
    cylinder_share: float = 0.001
    radius: float = 0.05
    radius_share: float = 0.0008
    plane_edges: int = 18
    threaded_radius: float = 30.0
    direction_step: float = 0.18
    cluster_share: float = 0.08
    flange_holes: int = 3
    flange_bonus: float = 0.35
    planes: int = 12
    holes: int = 18
    pins: int = 10
    threaded_holes: int = 8
    flange_planes: int = 4
    guide_slots: int = 6
    stand_ins: bool = True
    stand_in_sockets: int = 4
    stand_in_splines: float = 0.32
    stand_in_aspect: float = 1.55
    slots: SlotRules = SlotRules()
    likeness: Likeness = Likeness()

    def most(self) -> Column:
        """The cap of a row's kind."""
        caps = {"plane": self.planes, "hole": self.holes, "pin": self.pins, "threaded_hole": self.threaded_holes, "flange_plane": self.flange_planes, "guide_slot": self.guide_slots}
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col("kind"))


def guide_slots(planes: DataFrame, parts: DataFrame, rules: SlotRules = SlotRules()) -> DataFrame:
    """part, a, b, gap, aspect, origin, axis, score of the slots between a part's largest planes.

    planes (part, face, area, center, normal, extents), parts (part, diagonal).  a is the larger plane, of equal ones the first.  The axis
    is that of the largest extent, or if the normal runs along it, x or else y.
    """
    by_size = Window.partitionBy("part").orderBy(F.desc("area"), "face")
    largest = F.max("area").over(Window.partitionBy("part"))
    top = planes.withColumn("largest", largest).where(F.col("area") >= F.col("largest") * rules.area_share).withColumn("place", F.row_number().over(by_size)).where(F.col("place") <= rules.planes)
    side = lambda s: top.select("part", *[F.col(c).alias(f"{c}_{s}") for c in ("face", "place", "area", "center", "normal", "extents")])
    pairs = side("a").join(side("b"), "part").where("place_a < place_b").join(parts.select("part", "diagonal"), "part")
    pairs = pairs.where(F.abs(dot(F.col("normal_a"), F.col("normal_b"))) >= rules.parallel)
    least = F.greatest(F.lit(rules.gap), F.col("diagonal") * rules.gap_share)
    apart = F.zip_with("center_a", "center_b", lambda x, y: x - y)
    mean = F.zip_with("extents_a", "extents_b", lambda x, y: (x + y) / 2)
    rows = pairs.withColumns({"gap": F.abs(dot(apart, F.col("normal_a"))), "least": least, "mean": mean})
    rows = rows.where(F.col("gap") > F.col("least")).withColumn("sides", F.reverse(F.array_sort(F.filter("mean", lambda x: x > F.col("least") * 0.5)))).where(F.size("sides") >= 2)
    # null where there is none: the filters around may be worked out in any order
    short = F.get("sides", F.lit(1))
    rows = rows.withColumn("aspect", F.get("sides", F.lit(0)) / short).where(F.col("aspect").between(rules.least_aspect, rules.most_aspect) & (F.col("gap") <= short * 1.5))
    unit = lambda i: F.array(*[F.lit(1.0 if j == i else 0.0) for j in range(3)])
    along = lambda v: F.abs(dot(v, F.col("normal_a"))) > 0.9
    widest = F.array_position("mean", F.array_max("mean"))
    axis = F.when(widest == 1, unit(0)).when(widest == 2, unit(1)).otherwise(unit(2))
    axis = let(axis, lambda v: F.when(~along(v), v).when(~along(unit(0)), unit(0)).otherwise(unit(1)))
    score = F.log1p(F.col("area_a") + F.col("area_b")) + 0.7 * F.col("aspect") - 0.25 * F.col("gap") / F.greatest(short, F.lit(1e-8))
    origin = F.zip_with("center_a", "center_b", lambda x, y: (x + y) / 2)
    return rows.select("part", F.col("face_a").alias("a"), F.col("face_b").alias("b"), "gap", "aspect", origin.alias("origin"), axis.alias("axis"), score.alias("score"))


def proxy_sockets(parts: DataFrame, sockets: DataFrame, least_sockets: int = 4, spline_share: float = 0.5, least_aspect: float = 1.5) -> DataFrame:
    """part, name, kind, origin, axis, normal, quality: stand-ins of parts with few mating sockets or many splines.

    parts (part, lo, hi, faces, splines), sockets (part, name).  An axis through the box's middle along its longest side, if that is `least_aspect` times
    the next, and a plane at each end; names that the part has stay as they are.
    """
    have = sockets.groupBy("part").agg(F.count("*").alias("real"))
    rows = parts.join(have, "part", "left").where((F.coalesce("real", F.lit(0)) < least_sockets) | (F.col("splines") / F.greatest("faces", F.lit(1)) >= spline_share))
    sides = F.zip_with("hi", "lo", lambda x, y: x - y)
    rows = rows.withColumn("sides", sides).withColumn("long", F.array_position("sides", F.array_max("sides")).cast("int") - 1)
    rows = rows.withColumn("aspect", F.array_max("sides") / F.greatest(F.element_at(F.array_sort("sides"), 2), F.lit(1e-6)))
    mid = F.zip_with("lo", "hi", lambda x, y: (x + y) / 2)
    end = lambda at: F.transform(mid, lambda x, i: F.when(i == F.col("long"), F.get(at, F.col("long"))).otherwise(x))
    unit = lambda s: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == F.col("long"), float(s)).otherwise(0.0))
    none = F.lit(None).cast("array<double>")
    make = lambda name, kind, origin, axis, normal, quality: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind"), origin.alias("origin"), axis.alias("axis"), normal.alias("normal"), quality.alias("quality"))
    axis = make("axis_00", "axis", mid, unit(1), none, 2.25 + F.least(F.lit(2.0), 0.3 * F.col("aspect")))
    ends = [make("proxy_plane_00", "plane", end(F.col("lo")), none, unit(-1), F.lit(1.75)), make("proxy_plane_01", "plane", end(F.col("hi")), none, unit(1), F.lit(1.75))]
    every = F.concat(F.when(F.col("aspect") >= least_aspect, F.array(axis)).otherwise(F.array_except(F.array(axis), F.array(axis))), F.array(*ends))
    made = rows.select("part", F.explode(every).alias("s")).select("part", "s.name", "s.kind", "s.origin", "s.axis", "s.normal", "s.quality")
    return made.join(sockets.select("part", "name"), ["part", "name"], "left_anti")


def alike(a: Column, b: Column, reach: Column, rules: Likeness = Likeness()) -> Column:
    """Whether two sockets (structs of origin, axis, normal, radius) count as one; what either lacks is not compared."""
    apart = F.sqrt(dot(F.zip_with(a["origin"], b["origin"], lambda x, y: x - y), F.zip_with(a["origin"], b["origin"], lambda x, y: x - y)))
    turned = lambda c, least: F.coalesce(F.abs(dot(a[c], b[c])) < least, F.lit(False))
    wide = F.greatest(F.lit(rules.radius), F.greatest(F.abs(a["radius"]), F.abs(b["radius"])) * rules.radius_share)
    other = F.coalesce(F.abs(a["radius"] - b["radius"]) > wide, F.lit(False)) & a["radius"].isNotNull() & b["radius"].isNotNull()
    return (apart <= reach) & ~turned("axis", rules.coaxial) & ~turned("normal", rules.parallel) & ~other


def suppressed(sockets: DataFrame, parts: DataFrame, most: int | Column, rules: Likeness = Likeness()) -> DataFrame:
    """part, kind, id, place: of the sockets (part, kind, id, origin, axis, normal, radius, score) from the best score down those that are not alike one kept before,
    `most` (a number, or a column of part and kind) of each kind and part; parts (part, diagonal).  Ties go to the least id."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "origin", "axis", "normal", "radius")))
    groups = sockets.groupBy("part", "kind").agg(ordered.alias("all")).join(parts.select("part", "diagonal"), "part")
    reach = F.greatest(F.lit(rules.origin), F.col("diagonal") * rules.origin_share)
    keep = lambda kept, x: F.when((F.size(kept) < most) & ~F.exists(kept, lambda k: alike(k, x, reach, rules)), F.concat(kept, F.array(x))).otherwise(kept)
    kept = F.aggregate("all", F.slice("all", 1, 0), keep)
    return groups.select("part", "kind", F.posexplode(kept).alias("place", "s")).select("part", "kind", "s.id", "place")


def socket_length(area: Column, radius: Column, extents: Column) -> Column:
    """The length of a round socket by its lateral area, else its largest extent, else 0."""
    by_area = F.when((radius > 1e-6) & area.isNotNull(), F.greatest(F.lit(0.0), area) / F.greatest(2 * F.lit(3.141592653589793) * radius, F.lit(1e-6)))
    return F.when(by_area > 1e-4, by_area).otherwise(F.coalesce(F.array_max(F.transform(extents, F.abs)), F.lit(0.0)))


def frame_variants(sockets: DataFrame) -> DataFrame:
    """part, id, frame, origin, axis, normal of every frame of the sockets (part, id, kind, origin, axis, normal, radius, area, extents).

    primary is the socket's own; flat ones have a support without an axis, round ones their ends and what each kind calls them, half their length along the axis.
    """
    ends = lambda names: F.array(*[F.struct(F.lit(n).alias("frame"), F.lit(float(s)).alias("sign")) for n, s in names])
    half = 0.5 * socket_length(F.col("area"), F.col("radius"), F.col("extents"))
    none = F.slice(ends(END_FRAMES), 1, 0)
    round_ = F.col("axis").isNotNull() & (F.col("half") > 0.5e-4)
    more = (
        F.when(F.col("kind").isin(FLAT_KINDS) & F.col("normal").isNotNull(), ends([("support", 0)])).when(F.col("kind").isin(HOLE_KINDS) & round_, ends(END_FRAMES + HOLE_FRAMES))
        .when(F.col("kind").isin(PIN_KINDS) & round_, ends(END_FRAMES + PIN_FRAMES)).otherwise(none)
    )
    size = F.sqrt(dot(F.col("axis"), F.col("axis")))
    rows = sockets.withColumn("half", half).withColumn("unit", F.transform("axis", lambda x: F.try_divide(x, size)))
    rows = rows.select("*", F.explode(F.concat(ends([("primary", 0)]), more)).alias("f")).withColumn("sign", F.col("f.sign"))
    moved = F.when(F.col("sign") == 0, F.col("origin")).otherwise(F.zip_with("origin", "unit", lambda o, u: o + u * F.col("half") * F.col("sign")))
    turned = F.transform("unit", lambda u: u * F.col("sign"))
    axis = F.when(F.col("f.frame") == "primary", F.col("axis")).when(F.col("sign") != 0, turned)
    return rows.select("part", "id", F.col("f.frame").alias("frame"), moved.alias("origin"), axis.alias("axis"), F.when(F.col("sign") != 0, turned).otherwise(F.col("normal")).alias("normal"))


def world_sockets(sockets: DataFrame, instances: DataFrame) -> DataFrame:
    """instance, id, origin, axis, normal, radius of sockets under their instance's pose; instances (instance, part, pose, params: a map).

    A socket bound to a parameter (radius_param) has that value times radius_scale, 1 if null, as its radius, if the instance has it.
    """
    rows = instances.join(sockets, "part")
    turn = lambda v: F.array(*[sum((F.col("pose")[4 * i + j] * v[j] for j in range(1, 3)), F.col("pose")[4 * i] * v[0]) for i in range(3)])
    unit = lambda v: let(turn(v), lambda w: F.transform(w, lambda x: F.try_divide(x, F.sqrt(dot(w, w)))))
    origin = let(turn(F.col("origin")), lambda w: F.array(*[w[i] + F.col("pose")[4 * i + 3] for i in range(3)]))
    bound = F.try_element_at("params", F.col("radius_param")) * F.coalesce("radius_scale", F.lit(1.0))
    direction = lambda c: F.when(F.col(c).isNotNull(), unit(F.col(c))).alias(c)
    return rows.select("instance", "id", origin.alias("origin"), direction("axis"), direction("normal"), F.coalesce(bound, F.col("radius")).alias("radius"))


def model_frames(faces: DataFrame, intrinsic: bool = False) -> DataFrame:
    """part, middle, diagonal, lo, hi, faces, splines of faces (part, surface_type, center, extents, area).

    The middle and diagonal of the box around all faces, or, intrinsic, the centroid by area and the root of the area, which turn with the part; then a
    part without area is left out.  lo and hi are the box's in both.
    """
    at = lambda f: F.array(*[f(i) for i in range(3)])
    reach = lambda sign: lambda i: F.col("center")[i] + sign * 0.5 * F.coalesce(F.col("extents")[i], F.lit(0.0))
    splines = F.count_if(F.col("surface_type").rlike("spline|bezier|nurbs"))
    weight = F.when(F.col("area") > 0, F.col("area"))
    rows = faces.groupBy("part").agg(
        at(lambda i: F.min(reach(-1)(i))).alias("lo"), at(lambda i: F.max(reach(1)(i))).alias("hi"), F.count("*").alias("faces"), splines.alias("splines"),
        at(lambda i: F.try_divide(F.sum(weight * F.col("center")[i]), F.sum(weight))).alias("centroid"), F.sum(weight).alias("total"),
    )
    off = F.zip_with("hi", "lo", lambda x, y: x - y)
    middle = F.col("centroid") if intrinsic else F.zip_with("lo", "hi", lambda x, y: (x + y) / 2)
    size = F.sqrt("total") if intrinsic else F.sqrt(dot(off, off))
    rows = rows.where("total is not null") if intrinsic else rows
    return rows.select("part", middle.alias("middle"), F.greatest(size, F.lit(1e-6)).alias("diagonal"), "lo", "hi", "faces", "splines")


def mating(edges: int | None = None) -> Column:
    """Faces that are not helical, no splines, not marked as not mating, and with fewer edges than a bound."""
    fine = ~F.col("helical") & ~F.col("surface_type").rlike("spline|bezier|nurbs") & ~F.col("non_mating")
    return fine if edges is None else fine & (F.col("edge_count") < max(8, edges))


def centrality(axial: bool) -> Column:
    """1 at the model's middle, or with the axis through it, 0 from half a diagonal on."""
    off = F.zip_with("center", "middle", lambda x, y: x - y)
    if axial:
        off = let(F.struct(off.alias("off"), dot(off, F.col("axis")).alias("along")), lambda s: F.zip_with(s["off"], "axis", lambda x, a: x - s["along"] * a))
    return let(off, lambda v: F.greatest(F.lit(0.0), 1 - F.sqrt(dot(v, v)) / F.greatest(0.5 * F.col("diagonal"), F.lit(1e-6))))


def cluster_key(rules: ExtractionRules) -> Column:
    """Cells of a socket's axis, normal, place along the axis and off it, offset along the normal, and radius; zeros where it has none, radius -1."""
    cell = lambda x, step: F.bround(x / F.greatest(step, F.lit(1e-6))).cast("long")
    step = F.greatest(F.lit(rules.likeness.origin), F.col("diagonal") * rules.cluster_share)
    off = F.zip_with("origin", "middle", lambda x, y: x - y)
    turn = lambda c: F.transform(canonical_direction(F.col(c)), lambda x: cell(x, F.lit(rules.direction_step)))
    along = lambda c: dot(off, canonical_direction(F.col(c)))
    rest = let(F.struct(along("axis").alias("a"), canonical_direction(F.col("axis")).alias("u")), lambda s: let(F.zip_with(off, s["u"], lambda x, u: x - s["a"] * u), lambda v: F.sqrt(dot(v, v))))
    zeros, none = F.array(*[F.lit(0).cast("long")] * 3), F.lit(0).cast("long")
    width = F.greatest(F.lit(rules.likeness.radius), F.abs("radius") * rules.likeness.radius_share)
    return F.struct(
        F.coalesce(turn("axis"), zeros).alias("axis"), F.coalesce(turn("normal"), zeros).alias("normal"), F.coalesce(cell(along("axis"), step), none).alias("axial"),
        F.coalesce(cell(rest, step), none).alias("radial"), F.coalesce(cell(along("normal"), step), none).alias("offset"), F.coalesce(cell(F.col("radius"), width), F.lit(-1).cast("long")).alias("radius"),
    )


def cluster_best(sockets: DataFrame, rules: ExtractionRules = ExtractionRules()) -> DataFrame:
    """Of the sockets (part, kind, turn, origin, axis, normal, radius, score, middle, diagonal) in one cluster the best, the first of equals, with the cluster's first turn."""
    of = Window.partitionBy("part", "kind", "cluster")
    rows = sockets.withColumn("cluster", cluster_key(rules)).withColumn("best", F.row_number().over(of.orderBy(F.desc("score"), "turn")))
    return rows.withColumn("turn", F.min("turn").over(of)).where("best = 1").drop("best", "cluster")


def compacted(sockets: DataFrame, frames: DataFrame, rules: ExtractionRules, clustered: bool) -> DataFrame:
    """The sockets that stay, with their place within part and kind: clusters' best first if asked, then no two alike, up to the kind's cap."""
    rows = sockets.join(frames.select("part", "middle", "diagonal"), "part")
    rows = (cluster_best(rows, rules) if clustered else rows).drop("middle", "diagonal")
    rest = [c for c in rows.columns if c not in ("part", "kind", "turn")]
    shaped = rows.select("part", "kind", F.struct("turn", *rest).alias("id"), "origin", "axis", "normal", "radius", "score")
    return suppressed(shaped, frames, rules.most(), rules.likeness).select("part", "kind", "place", "id.*")


def extracted_sockets(faces: DataFrame, rules: ExtractionRules = ExtractionRules(), intrinsic: bool = False) -> tuple[DataFrame, DataFrame]:
    """Faces -> (part, name, kind, face, other, origin, axis, normal, radius, quality, mates of every socket; part, name, frame, origin, axis, normal of its frames).

    faces (part, face, surface_type, center, normal, axis, extents, area, radius, concavity, edge_count, helical, thread_hint, non_mating).  In turn: planes and cylinders that
    are large enough; their kinds and scores; of each kind the best, no two alike; base_plane, the best plane; planes that enough holes point along (flange_plane); slots between
    parallel planes (guide_slot, with their second face in `other`); stand-ins where few sockets mate or splines prevail; and the frames of all.

    intrinsic: the second frame protocol.  Middle and size of a part do not depend on how it lies, candidates are not clustered by cells, and there are no guide slots, whose axis
    would be one of the box's.  Threads mate only with a fastener, so they do not count as mating.  A part is a bounded group, as its face count is; null normals, axes, radii and extents are met.
    """
    frames = written(model_frames(faces, intrinsic), "model-frames")
    largest = lambda kind: F.max(F.when(kind, F.col("area"))).over(Window.partitionBy("part"))
    flat = (F.col("surface_type") == "plane") & F.col("normal").isNotNull() & (F.col("area") >= rules.area) & mating(rules.plane_edges)
    round_ = (F.col("surface_type") == "cylinder") & F.col("axis").isNotNull() & (F.col("area") >= rules.area)
    rows = faces.join(frames.select("part", "middle", "diagonal"), "part").withColumns({"flat": flat, "round": round_})
    rows = rows.withColumns({"top_plane": largest(F.col("flat")), "top_round": largest(F.col("round"))})
    planes = rows.where(F.col("flat") & (F.col("area") >= F.col("top_plane") * rules.plane_share))
    wide = F.coalesce(F.col("radius") >= F.greatest(F.lit(rules.radius), F.col("diagonal") * rules.radius_share), F.lit(True))
    cylinders = rows.where(F.col("round") & (F.col("area") >= F.col("top_round") * rules.cylinder_share) & wide)
    kind = cylinder_kind(*map(F.col, ["concavity", "helical", "thread_hint", "radius", "edge_count"]), rules.threaded_radius)
    sharp = (
        F.when(F.col("kind").isin(HOLE_KINDS), 0.65).otherwise(0.0) + F.when(F.col("kind") == "threaded_hole", 0.6).otherwise(0.0) + F.when(F.col("helical"), 0.35).otherwise(0.0)
        + F.when(F.col("edge_count").isin(2, 3, 4, 6, 8), 0.2).otherwise(0.0) + F.coalesce(0.2 * F.least(F.col("radius") / F.col("diagonal"), F.lit(1.0)), F.lit(0.0))
    )
    no_axis, no_radius, turn = F.lit(None).cast("array<double>"), F.lit(None).cast("double"), F.struct(F.col("face").alias("a"), F.lit(0).cast("long").alias("b"))
    shape = ["part", "kind", turn.alias("turn"), "face", F.lit(None).cast("long").alias("other"), F.col("center").alias("origin")]
    flat_rows = planes.withColumn("kind", F.lit("plane")).select(*shape, no_axis.alias("axis"), "normal", no_radius.alias("radius"), "area", "extents", (F.log1p("area") + 0.75 * centrality(False)).alias("score"))
    round_rows = cylinders.withColumn("kind", kind).select(*shape, "axis", no_axis.alias("normal"), "radius", "area", no_axis.alias("extents"), (F.log1p("area") + 2.1 * centrality(True) + sharp).alias("score"))
    chosen = written(compacted(flat_rows.unionByName(round_rows), frames, rules, not intrinsic), "chosen-sockets")
    found = chosen
    axes = chosen.where(F.col("kind").isin(HOLE_KINDS)).select("part", F.col("axis").alias("hole"))
    along = chosen.where("kind = 'plane'").join(axes, "part").where(F.abs(dot(F.col("normal"), F.col("hole"))) >= rules.likeness.coaxial)
    many = along.groupBy("part", "face").agg(F.count("*").alias("holes")).where(F.col("holes") >= rules.flange_holes)
    flanges = chosen.where("kind = 'plane'").drop("place").join(many, ["part", "face"]).withColumn("kind", F.lit("flange_plane"))
    flanges = flanges.withColumn("score", F.col("score") + rules.flange_bonus * F.col("holes")).select(*chosen.drop("place").columns)
    # in the order of the planes they come from
    first = chosen.where("kind = 'plane'").select("part", "face", F.struct(F.col("place").cast("long").alias("a"), F.lit(0).cast("long").alias("b")).alias("turn"))
    flanges = flanges.drop("turn").join(first, ["part", "face"])
    found = found.unionByName(compacted(flanges, frames, rules, not intrinsic))
    if not intrinsic:
        slots = guide_slots(planes.where("extents is not null").select("part", "face", "area", "center", "normal", "extents"), frames, rules.slots)
        normals = planes.select("part", F.col("face").alias("a"), "normal")
        by_size = planes.select("part", "face", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("area"), "face")).cast("long").alias("n"))
        slots = slots.join(normals, ["part", "a"]).join(by_size.select("part", F.col("face").alias("a"), F.col("n").alias("na")), ["part", "a"]).join(by_size.select("part", F.col("face").alias("b"), F.col("n").alias("nb")), ["part", "b"])
        slots = slots.select(
            "part", F.lit("guide_slot").alias("kind"), F.struct(F.col("na").alias("a"), F.col("nb").alias("b")).alias("turn"), F.col("a").alias("face"), F.col("b").alias("other"), "origin", "axis", "normal",
            no_radius.alias("radius"), no_radius.alias("area"), no_axis.alias("extents"), "score",
        )
        found = found.unionByName(compacted(slots, frames, rules, True))
    number = F.when(F.col("kind") == "plane", F.col("place") - 1).otherwise(F.col("place"))
    name = F.when((F.col("kind") == "plane") & (F.col("place") == 0), "base_plane").otherwise(F.concat_ws("_", "kind", F.format_string("%02d", number)))
    columns = ["part", "name", "kind", "face", "other", "origin", "axis", "normal", "radius", "area", "extents", "quality", "mates"]
    found = written(found.withColumns({"name": name, "quality": F.col("score"), "mates": F.col("kind") != "threaded_hole"}).select(*columns), "sockets")
    if rules.stand_ins:
        extra = proxy_sockets(frames, found.where("mates"), rules.stand_in_sockets, rules.stand_in_splines, rules.stand_in_aspect).withColumn("mates", F.lit(True))
        found = written(found.unionByName(extra, allowMissingColumns=True), "sockets")
    views = frame_variants(found.withColumn("id", F.col("name"))).withColumnRenamed("id", "name")
    return found.drop("area", "extents"), views


def flange_planes(planes: DataFrame, holes: DataFrame, least: float = 0.96, holes_least: int = 3, bonus: float = 0.35) -> DataFrame:
    """part, face, holes, score of the planes (part, face, normal, score) that at least so many holes (part, axis) of their part point along: |cosine| of `least` or more,
    and for each hole `bonus` to the score.

    Directions count once with their number of holes, and meet only in neighbouring cells of the sphere, as wide as the angle asks for, each under both signs.
    """
    reach = (2 - 2 * least) ** 0.5 + 1e-9
    unit = lambda v: let(F.struct(v.alias("v"), F.sqrt(dot(v, v)).alias("s")), lambda x: F.transform(x["v"], lambda y: F.try_divide(y, x["s"])))
    cell = lambda v: F.transform(v, lambda x: F.floor(x / reach))
    axes = holes.select("part", unit(F.col("axis")).alias("a")).groupBy("part", "a").agg(F.count("*").alias("n"))
    both = axes.select("part", "n", F.explode(F.array(F.col("a"), F.transform("a", lambda x: -x))).alias("a")).select("part", "n", "a", cell(F.col("a")).alias("c"))
    normals = planes.select("part", unit(F.col("normal")).alias("n0")).distinct()
    steps = F.array(*[F.array(*[F.lit(x).cast("long") for x in (i, j, k)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)])
    posted = normals.select("part", "n0", F.explode(F.transform(steps, lambda s: F.zip_with(cell(F.col("n0")), s, lambda x, y: x + y))).alias("c"))
    met = posted.join(both, ["part", "c"]).where(dot(F.col("n0"), F.col("a")) >= least)
    many = met.groupBy("part", "n0").agg(F.sum("n").alias("holes")).where(F.col("holes") >= holes_least)
    found = planes.withColumn("n0", unit(F.col("normal"))).join(many, ["part", "n0"])
    return found.select("part", "face", "holes", (F.col("score") + bonus * F.col("holes")).alias("score"))
