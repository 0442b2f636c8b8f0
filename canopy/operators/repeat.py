"""Repeatability: replicates compared with each other, with a reference and with their medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopy.functions.vectors import distance, vec


def replicate_pairs(df: DataFrame, key: str, on: Sequence[str] = ()) -> DataFrame:
    """Rows of two replicates side by side, a before b: a_* and b_* columns and ``on``."""
    a = df.select(*on, *[F.col(c).alias("a_" + c) for c in df.columns if c not in on])
    b = df.select(*on, *[F.col(c).alias("b_" + c) for c in df.columns if c not in on])
    return (a.join(b, list(on)) if on else a.join(b)).where(F.col(f"a_{key}") < F.col(f"b_{key}"))


def spread(df: DataFrame, value: Column, by: Sequence[str]) -> DataFrame:
    """mean, median, population deviation and n of a value, over all rows, and by each of ``by`` alone, in one pass of grouping sets."""
    sets = ", ".join(["()"] + [f"({b})" for b in by])
    rows = df.withColumn("__value", value)
    return rows.sparkSession.sql(
        f"SELECT {', '.join(by)}, avg(__value) AS mean, percentile(__value, 0.5) AS median, stddev_pop(__value) AS std, count(__value) AS n FROM {{rows}} GROUP BY GROUPING SETS ({sets})", rows=rows
    )


def median_pose(poses: DataFrame, by: Sequence[str]) -> DataFrame:
    return poses.groupBy(*by).agg(*[F.median(a).alias("m" + a) for a in "xyz"])


def pose_errors(reference: DataFrame, predicted: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distances in space, in the plane and in height between the poses that both sides have."""
    r = reference.select(*on, *[F.col(a).alias("r" + a) for a in "xyz"]).where("rx IS NOT NULL AND ry IS NOT NULL AND rz IS NOT NULL")
    p = predicted.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL").join(r, list(on))
    flat = distance((F.col("x"), F.col("y"), F.lit(0.0)), (F.col("rx"), F.col("ry"), F.lit(0.0)))
    return p.withColumns({"error": distance(vec("x", "y", "z"), vec("rx", "ry", "rz")), "error_xy": flat, "error_z": F.abs(F.col("z") - F.col("rz"))})


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once: the product and the sum with their errors (Dekker, Knuth), for numbers far from the limits."""
    split = lambda v: 134217729.0 * v - (134217729.0 * v - v)  # noqa: E731  the upper 26 bits
    ah, bh = split(a), split(b)
    p = a * b
    low = ((ah * bh - p) + ah * (b - bh) + (a - ah) * bh) + (a - ah) * (b - bh)
    s = p + c
    z = s - p
    return s + (((p - (s - z)) + (c - z)) + low)


def quantiles(df: DataFrame, value: str, by: Sequence[str], shares: dict[str, float]) -> DataFrame:
    """``df`` with a column for each share: the group's interpolated quantile, lo * (1 - d) + hi * d with the first product and the sum rounded once, as DuckDB does.  Nulls don't count."""
    every = Window.partitionBy(*by)
    ranked = df.withColumns({"__n": F.count(value).over(every), "__rank": F.row_number().over(every.orderBy(F.col(value).asc_nulls_last())) - 1})
    ends = {}
    for name, share in shares.items():
        at = (F.col("__n") - 1) * share
        for end, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            ends[f"__{name}_{end}"] = F.max(F.when(F.col("__rank") == place, F.col(value))).over(every)
    found = ranked.withColumns(ends)
    for name, share in shares.items():
        at, lo, hi = (F.col("__n") - 1) * share, F.col(f"__{name}_lo"), F.col(f"__{name}_hi")
        d = at - F.floor(at)
        found = found.withColumn(name, F.when(d == 0, lo).otherwise(fused(lo, 1.0 - d, hi * d)))
    return found.drop("__n", "__rank", *ends)


def upper_fliers(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Rows over the third quartile by more than one and a half times the range of quartiles; quartiles are interpolated."""
    out = quantiles(df, value, by, {"q1": 0.25, "q3": 0.75})
    return out.where(F.col(value) > F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))


def far_from_median(df: DataFrame, value: str, by: Sequence[str], low: float = 0.5, high: float = 1.5) -> DataFrame:
    """Rows that aren't strictly between ``low`` and ``high`` times their group's median."""
    m = df.groupBy(*by).agg(F.median(value).alias("median"))
    return df.join(m, list(by)).where(~((F.col(value) > low * F.col("median")) & (F.col(value) < high * F.col("median"))))


def mean_deviation(df: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean absolute difference to the group's mean, for each value."""
    m = df.groupBy(*by).agg(*[F.avg(v).alias("m_" + v) for v in values])
    return df.join(m, list(by)).groupBy(*by).agg(*[F.avg(F.abs(F.col("m_" + v) - F.col(v))).alias(v) for v in values])


def count_statistics(counts: DataFrame, n: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """least, most, mean and the most common count, the one seen first (by ``order``) on a tie."""
    each = counts.groupBy(*by, n).agg(F.count(F.lit(1)).alias("times"), F.min(order).alias("first"))
    mode = each.groupBy(*by).agg(F.max_by(n, F.struct("times", -F.col("first"))).alias("common"), F.max("times").alias("times"))
    stats = counts.groupBy(*by).agg(F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"))
    return stats.join(mode, list(by)) if by else stats.join(F.broadcast(mode))


def heatmap(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Pairs as cells (row, column, value) of a symmetric matrix with a diagonal of zeros."""
    cells = pairs.select(F.col(a).alias("row"), F.col(b).alias("column"), F.col(value).alias("value"))
    names = cells.select(F.col("row").alias("n")).union(cells.select("column")).distinct()
    return cells.union(cells.select("column", "row", "value")).union(names.select("n", "n", F.lit(0.0)))


def same_files(left: DataFrame, right: DataFrame) -> DataFrame:
    """The share (in percent) of files that both sides have, by name, whose content is equal; 0 without any.  Columns name, digest."""
    j = left.select("name", F.col("digest").alias("l")).join(right.select("name", F.col("digest").alias("r")), "name")
    return j.agg(F.coalesce(100.0 * F.count_if(F.col("l") == F.col("r")) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("similarity"))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Items (key, value) that only one side has."""
    return a.exceptAll(b).union(b.exceptAll(a)).distinct()
