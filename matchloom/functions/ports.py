"""Column expressions on primitives and port contracts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and orders that decide results.
PRIMITIVE_KINDS = ["face", "edge"]
SIZE_CLASSES = ["only", "smallest", "small", "medium", "large", "largest"]
SYMMETRY_CLASSES = ["single", "repeated"]
CONTRACT_FIELDS = ["primitive_kind", "geometry_type", "size_class", "adjacent_surface_types", "symmetry_class"]
ROUND_TYPES = ["circle", "cylinder", "cone", "sphere", "torus"]
AXIS_TYPES = ["circle", "cylinder", "cone", "line"]
AXIAL_SHAPES = [
    "Arc3DCurveType", "Circle3DCurveType", "ConeSurfaceType", "CylinderSurfaceType", "Ellipse3DCurveType",
    "EllipticalConeSurfaceType", "EllipticalCylinderSurfaceType", "TorusSurfaceType",
]
MOBILITY_BY_JOINT = [
    ("RigidJointType", "fixed", 0, 0), ("RevoluteJointType", "revolute", 1, 0), ("SliderJointType", "prismatic", 0, 1),
    ("CylindricalJointType", "cylindrical", 1, 1), ("PlanarJointType", "planar", 1, 2), ("BallJointType", "ball", 3, 0), ("PinSlotJointType", "pin_slot", 1, 1),
]
MOBILITIES = [name for _, name, _, _ in MOBILITY_BY_JOINT]
DOMINANT_MOBILITIES = ["fixed", "revolute", "prismatic", "cylindrical"]
SIZE_TOLERANCE = 1e-7


def port_measure(geometry: Column, size: Column, radius: Column) -> Column:
    """The radius of a round primitive that has one, else its size."""
    return F.when(geometry.isin(ROUND_TYPES) & (radius > 0), radius).otherwise(size)


def size_class(peers: Column, smaller: Column, larger: Column) -> Column:
    """The size class of a primitive from how many peers it has (itself too), and how many of them are smaller and larger."""
    # twice the mid rank, in thirds of the peers
    rank = 3 * (peers + smaller - larger)
    return (
        F.when(peers == 1, "only").when((smaller == 0) & (larger > 0), "smallest").when((larger == 0) & (smaller > 0), "largest")
        .when(rank < 2 * peers, "small").when(rank > 4 * peers, "large").otherwise("medium")
    )


def symmetry_class(members: Column) -> Column:
    return F.when(members > 1, "repeated").otherwise("single")


def adjacent_key(types: Column) -> Column:
    """The adjacent surface types of a contract as one text; none if there are none."""
    return F.when(F.size(types) > 0, F.array_join(types, "+")).otherwise("none")


def contract_key(*fields: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("?")) for f in fields])


def port_phrase(kind: Column, geometry: Column, size: Column, adjacent: Column, symmetry: Column) -> Column:
    """A contract in words; a null field is one that the contract leaves open."""
    noun = F.concat_ws(" ", F.when(size != "only", size), geometry, kind)
    near = F.when(F.size(adjacent) > 0, F.concat(F.lit(" adjacent to "), F.array_join(adjacent, " and ")))
    return F.concat(noun, F.coalesce(near, F.lit("")), F.when(symmetry == "repeated", " in a repeated symmetric set").otherwise(""))


def primitive_support(a: Column, b: Column) -> Column:
    """The support family of two primitive types."""
    on_axis = lambda x: x.isin(AXIS_TYPES)
    return (
        F.when((a == "line") & (b == "line"), "linear_support").when(on_axis(a) & on_axis(b), "axial_support")
        .when((a == "plane") & (b == "plane"), "planar_support")
        .when(((a == "plane") & on_axis(b)) | ((b == "plane") & on_axis(a)), "axis_plane_support").otherwise("other")
    )


def shape_support(a: Column, b: Column) -> Column:
    """The support family of two source shapes."""
    axial = lambda x: x.isin(AXIAL_SHAPES)
    flat = lambda x: x == "PlaneSurfaceType"
    ball = lambda x: x == "SphereSurfaceType"
    line = lambda x: x == "Line3DCurveType"
    both = lambda f: f(a) & f(b)
    either = lambda f: f(a) | f(b)
    return (
        F.when(both(flat), "planar_support").when(both(axial), "axial_support").when(both(ball), "spherical_support")
        .when(both(line), "linear_support").when(either(ball), "point_frame_support")
        .when(either(axial) & either(flat), "axis_plane_support").otherwise("general_frame_support")
    )


def decoded_support(a: Column, b: Column, learned: Column) -> Column:
    """The primitive rule where it names a family, else the learned one."""
    found = primitive_support(a, b)
    return F.when(found == "other", learned).otherwise(F.coalesce(found, learned))


def other_mobilities(name: Column) -> Column:
    """The mobilities that a prompt is set against: the dominant ones for a dominant name, else all others."""
    every = lambda names: F.array(*map(F.lit, names))
    return F.when(name.isin(DOMINANT_MOBILITIES), F.array_except(every(DOMINANT_MOBILITIES), F.array(name))).otherwise(
        F.array_except(every(MOBILITIES), F.array(name))
    )
