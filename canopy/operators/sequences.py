"""Ordered traits: lags, path sums, runs, flips and divergence angles, as window functions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.vectors import cross, det3, distance, dot, minus, vec


def lag_difference(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("difference", F.col(value) - F.lag(value).over(w))


def path_length(df: DataFrame, by: Sequence[str], order: str, step: str) -> DataFrame:
    """``path``: the sum of steps up to each row."""
    return df.withColumn("path", F.sum(step).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def within_path(df: DataFrame, by: Sequence[str], order: str, step: str, most: float) -> DataFrame:
    """The rows whose path is at most ``most``."""
    return path_length(df, by, order, step).where(F.col("path") <= most)


def around_anchor(df: DataFrame, by: Sequence[str], order: str, step: str, anchor: str, most: float) -> DataFrame:
    """The rows within a path of ``most`` before or after each group's anchor row (``anchor`` true); ``step`` is the way from the row before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    at = df.withColumn("__path", F.sum(step).over(w))
    mark = F.max(F.when(F.col(anchor), F.col("__path"))).over(Window.partitionBy(*by))
    return at.withColumn("offset", F.col("__path") - mark).where(F.abs("offset") <= most).drop("__path")


def median_flip(df: DataFrame, by: Sequence[str], angle: str = "angle", half: float = 180.0) -> DataFrame:
    """Angles replaced by their complement to a full turn in the groups whose median is over half a turn."""
    over = F.median(angle).over(Window.partitionBy(*by)) > half
    return df.withColumn(angle, F.when(over, 2 * half - F.col(angle)).otherwise(F.col(angle)))


def runs(df: DataFrame, by: Sequence[str], order: str, flag: str) -> DataFrame:
    """Runs of rows with the flag set: start, end, n.  ``order`` counts without gaps within a group."""
    island = F.col(order) - F.row_number().over(Window.partitionBy(*by).orderBy(order))
    marked = df.where(F.col(flag)).withColumn("island", island)
    return marked.groupBy(*by, "island").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count(F.lit(1)).alias("n")).drop("island")


def blind_angles(df: DataFrame, by: Sequence[str], order: str, flag: str) -> DataFrame:
    """Per group: the longest run of flagged rows as an angle of a full circle of rows; 0 without any."""
    size = df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"))
    longest = runs(df, by, order, flag).groupBy(*by).agg(F.max("n").alias("longest"))
    return size.join(longest, list(by), "left").select(*by, F.coalesce("longest", F.lit(0)).alias("longest"), (F.coalesce("longest", F.lit(0)) * 360.0 / F.col("total")).alias("blind_angle"))


def radians(a: Column) -> Column:
    """Aggregate: true if all angles are under a full turn in radians."""
    return F.every(a < 2 * math.pi)


def divergence(df: DataFrame, by: Sequence[str], order: str, by_step: bool = False) -> DataFrame:
    """angle (degrees) and internode from each organ's predecessor.

    Columns fx, fy, fz and sx, sy, sz are the organ's and the stem's directions,
    bx, by_, bz the branching point.  The angle is between the normals organ x
    stem, which aren't made unit vectors, and is completed to a full turn where
    det[previous organ, organ, previous stem] is negative; with ``by_step`` the
    step between the branching points takes the stem's place.  Outside of the
    domain of the arc cosine it is NaN.
    """
    w = Window.partitionBy(*by).orderBy(order)
    names = [f"{p}{x}" for p in "fsb" for x in "xyz"]
    d = df.withColumns({"p" + n: F.lag(n).over(w) for n in names}).where("pfx IS NOT NULL")
    f, s, b, pf, ps, pb = (vec(*(p + x for x in "xyz")) for p in ("f", "s", "b", "pf", "ps", "pb"))
    turn = F.acos(dot(cross(pf, ps), cross(f, s)))
    angle = F.when(det3(pf, f, minus(b, pb) if by_step else ps) < 0, 2 * math.pi - turn).otherwise(turn)
    return d.select(*by, order, F.degrees(angle).alias("angle"), distance(b, pb).alias("internode"))
