"""Between space and lattice: p = origin + voxel_size * index, rounding half to even."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("x", "y", "z")
CELLS = ("i", "j", "k")


def to_point(index: Column, origin: Column | float, size: Column | float) -> Column:
    return index * size + origin


def to_index(value: Column, origin: Column | float, size: Column | float) -> Column:
    return F.rint((value - origin) / size).cast("long")


def flat_index(i: Column, j: Column, k: Column, nj: Column | int, nk: Column | int) -> Column:
    """Row-major position of a cell."""
    return (i * nj + j) * nk + k


def cell_of(flat: Column, nj: int, nk: int) -> tuple[Column, Column, Column]:
    return F.floor(flat / (nj * nk)), F.floor(flat / nk) % nj, flat % nk


def voxel_histogram(points: DataFrame, size: float, padding: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """Points per lattice cell of each cloud.  The origin is the cloud's minimum less the padding, and the padding is added to the index again."""
    low = points.groupBy(*by).agg(*[F.min(a).alias(f"o{a}") for a in AXES])
    joined = points.join(low, list(by)) if by else points.join(F.broadcast(low))
    cells = [(to_index(F.col(a), F.col(f"o{a}") - padding * size, size) + padding).alias(c) for a, c in zip(AXES, CELLS, strict=True)]
    return joined.select(*by, *cells).groupBy(*by, *CELLS).agg(F.count(F.lit(1)).alias("n"))


def crop(points: DataFrame, box: dict[str, tuple[float, float]]) -> DataFrame:
    """The points strictly inside a box whose bounds may come in any order; all columns stay."""
    inside = F.lit(True)
    for axis, bounds in box.items():
        inside = inside & (F.col(axis) > min(bounds)) & (F.col(axis) < max(bounds))
    return points.where(inside)


def bounding_box(points: DataFrame, by: Sequence[str] = (), margin: float = 0.05) -> DataFrame:
    """Whole-number bounds with a margin on either side."""
    out = []
    for a in AXES:
        span = (F.max(a) - F.min(a)) * margin
        out += [F.floor(F.min(a) - span).alias(f"{a}_min"), F.ceil(F.max(a) + span).alias(f"{a}_max")]
    return points.groupBy(*by).agg(*out)


def downsample(points: DataFrame, most: int, by: Sequence[str] = ()) -> DataFrame:
    """The mean of the points in each cell, where a cloud of n points has cells of the size n // most + 1; smaller clouds stay."""
    sizes = points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    sized = points.join(sizes, list(by)) if by else points.join(F.broadcast(sizes))
    size = F.floor(F.col("n") / most) + 1
    keys = [F.when(F.col("n") >= most, F.floor(F.col(a) / size)).otherwise(F.col("pid")).alias(c) for a, c in zip(AXES, CELLS, strict=True)]
    return sized.select(*by, *keys, *AXES).groupBy(*by, *CELLS).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(a) for a in AXES])
