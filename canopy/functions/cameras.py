"""Camera models as Columns.

The canonical parameters are the eight of the OPENCV model, in this order: fx,
fy, cx, cy, k1, k2, p1, p2.  RADIAL has f, cx, cy, k1, k2; SIMPLE_RADIAL has f,
cx, cy, k.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopy.functions.vectors import Vec, dot, matrix_apply, plus

MODELS = ("OPENCV", "RADIAL", "SIMPLE_RADIAL")
OPENCV_NAMES = ("fx", "fy", "cx", "cy", "k1", "k2", "p1", "p2")


def _pick(model: Column, opencv: Column, radial: Column, simple: Column) -> Column:
    m = F.upper(model)
    return F.when(m == "OPENCV", opencv).when(m == "RADIAL", radial).when(m == "SIMPLE_RADIAL", simple)


def to_opencv(model: Column, p: Column) -> Column:
    """The eight canonical parameters; the single distortion of SIMPLE_RADIAL counts for both k1 and k2.  Null for an unknown model."""
    z = F.lit(0.0)
    return _pick(model, F.slice(p, 1, 8), F.array(p[0], p[0], p[1], p[2], p[3], p[4], z, z), F.array(p[0], p[0], p[1], p[2], p[3], p[3], z, z))


def intrinsics(model: Column, p: Column) -> Column:
    """fx, fy, cx, cy of any model."""
    return F.slice(to_opencv(model, p), 1, 4)


def simplest_model(p: Column) -> Column:
    """The plainest model that eight canonical parameters fit."""
    plain = (p[0] == p[1]) & (p[6] == 0) & (p[7] == 0)
    return F.when(plain & (p[4] == p[5]), "SIMPLE_RADIAL").when(plain, "RADIAL").otherwise("OPENCV")


def named(p: Column) -> Column:
    """Canonical parameters as a struct."""
    return F.struct(*[p[i].alias(n) for i, n in enumerate(OPENCV_NAMES)])


def csv(p: Column) -> Column:
    """Canonical parameters as eight comma-separated numbers."""
    return F.concat_ws(",", *[p[i].cast("string") for i in range(8)])


def pretty(x: Column) -> Column:
    """Two decimals, or scientific notation below 0.1."""
    return F.when(F.abs(x) < 0.1, F.format_string("%.2e", x)).otherwise(F.format_string("%.2f", x))


def camera_matrix(p: Column) -> Column:
    z, one = F.lit(0.0).cast("float"), F.lit(1.0).cast("float")
    f = lambda i: p[i].cast("float")
    return F.array(F.array(f(0), z, f(2)), F.array(z, f(1), f(3)), F.array(z, z, one))


def distortion(p: Column) -> Column:
    return F.array(*[p[i].cast("float") for i in range(4, 8)])


def to_camera(rot: list[Vec], tvec: Vec, point: Vec) -> Vec:
    """A point of the world in the camera's frame: R p + t."""
    return plus(matrix_apply(rot, point), tvec)


def pixel(fx: Column, fy: Column, cx: Column, cy: Column, at: Vec) -> tuple[Column, Column]:
    """Perspective projection of a point in the camera's frame.  Null at depth zero."""
    depth = F.nullif(at[2], F.lit(0.0))
    return fx * at[0] / depth + cx, fy * at[1] / depth + cy


def centre(rot: list[Vec], tvec: Vec) -> Vec:
    """Where the camera stands: minus the transposed rotation times the translation."""
    return tuple(-dot((rot[0][i], rot[1][i], rot[2][i]), tvec) for i in range(3))  # type: ignore[return-value]


def distorted(x: Column, y: Column, k1: Column, k2: Column, p1: Column, p2: Column) -> tuple[Column, Column]:
    """Radial and tangential distortion of a normalised image point."""
    r2 = x * x + y * y
    radial = 1 + k1 * r2 + k2 * r2 * r2
    return x * radial + 2 * p1 * x * y + p2 * (r2 + 2 * x * x), y * radial + p1 * (r2 + 2 * y * y) + 2 * p2 * x * y
