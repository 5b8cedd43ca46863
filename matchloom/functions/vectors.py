"""Column expressions on numeric arrays and poses (16 numbers, row by row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def finite(values: Column) -> Column:
    """An array that is not empty and holds finite numbers alone."""
    return (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def signed_log(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def clean(x: Column) -> Column:
    """0 for NaN, and 30 or -30 for an infinity."""
    return F.when(F.isnan(x), 0.0).when(x == float("inf"), 30.0).when(x == float("-inf"), -30.0).otherwise(x)


def node_features(v: Column) -> Column:
    """The six features of a face node, long tails bounded."""
    at = lambda i: v[i]
    up = lambda x: F.log1p(F.greatest(x, F.lit(0.0)))
    return F.array(*map(clean, [at(0), up(at(1)), signed_log(at(2)), signed_log(at(3)), up(at(4)), up(at(5))]))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def canonical_direction(v: Column) -> Column:
    """A direction of length 1 whose largest component, the first of equals, is positive."""
    size = F.sqrt(dot(v, v))
    unit = F.transform(v, lambda x: F.try_divide(x, size))
    sizes = F.transform(v, F.abs)
    lead = F.element_at(v, F.array_position(sizes, F.array_max(sizes)).cast("int"))
    return F.transform(unit, lambda x: F.when(lead < 0, -x).otherwise(x))


def quantised(x: Column, step: float) -> Column:
    """The nearest multiple of a step, halves to even."""
    return F.bround(x / max(abs(step), 1e-6)).cast("long")


def pose(angle_degrees: Column, x: Column, y: Column, z: Column) -> Column:
    """A turn about z and a translation."""
    a = F.radians(angle_degrees)
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(F.cos(a), -F.sin(a), zero, x, F.sin(a), F.cos(a), zero, y, zero, zero, one, z, zero, zero, zero, one)


def multiplied(a: Column, b: Column) -> Column:
    return F.array(*[sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)])


def inverse(p: Column) -> Column:
    """The inverse of a rigid pose."""
    shift = [-(p[i] * p[3] + p[4 + i] * p[7] + p[8 + i] * p[11]) for i in range(3)]
    rows = [[p[i], p[4 + i], p[8 + i], shift[i]] for i in range(3)]
    return F.array(*[x for row in rows for x in row], *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])


def rotation_angle(a: Column, b: Column) -> Column:
    """The angle between two poses' rotations, in radians."""
    trace = sum((a[4 * k + i] * b[4 * k + i] for i in range(3) for k in range(3)), F.lit(0.0))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1.0) * 0.5)))


def pose_status(p: Column, tolerance: float = 1e-6) -> Column:
    """valid, or the first rule that a pose breaks."""
    row = lambda i: [p[4 * i + j] for j in range(3)]
    inner = lambda i, j: sum((x * y for x, y in zip(row(i), row(j), strict=True)), F.lit(0.0))
    (a, b, c), (d, e, f), (g, h, i) = row(0), row(1), row(2)
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    square = [F.abs(inner(x, y) - (1.0 if x == y else 0.0)) > tolerance for x in range(3) for y in range(x, 3)]
    bent = square[0]
    for s in square[1:]:
        bent = bent | s
    last = (p[12] != 0) | (p[13] != 0) | (p[14] != 0) | (p[15] != 1)
    return (
        F.when(p.isNull() | (F.size(p) != 16), "shape").when(~finite(p), "not_finite").when(last, "last_row").when(bent, "not_orthonormal")
        .when(F.abs(det - 1.0) > tolerance, "mirrored").otherwise("valid")
    )


def rounded(x: Column, digits: int) -> Column:
    """A number of 0 or more, rounded half up; up to a million by arithmetic, as F.round writes each number out in decimals, which takes longer than finding it."""
    scale = float(10**digits)
    return F.when(x < 1e6, F.floor(x * scale + 0.5) / scale).otherwise(F.round(x, digits) + 0.0)
