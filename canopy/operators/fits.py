"""Fits of circles, planes, directions and cylinders to groups of points.

Sums are made by Spark: a group's covariance is nine aggregates whatever its
size, and only its 3 x 3 matrix is decomposed in a function.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.session import ship_code

PAIRS = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]


def covariance(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, the means and the sample covariances cxx ... czz of each group."""
    return points.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias("m" + a) for a in "xyz"], *[F.covar_samp(a, b).alias(f"c{a}{b}") for a, b in PAIRS])


def _matrix(row) -> np.ndarray:
    return np.array([[getattr(row, "c" + "".join(sorted((a, b)))) for b in "xyz"] for a in "xyz"], dtype=float)


def axes(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Principal axes of each group: variances e0 >= e1 >= e2 and unit vectors u, v (the plane) and w (its normal), signed so that the largest part is positive."""
    names = list(by)
    c = covariance(points, by).where("n > 2")
    kinds = dict(c.dtypes)
    ship_code(points.sparkSession)
    columns = ["e0", "e1", "e2", *[f"{p}{x}" for p in "uvw" for x in "xyz"]]

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                values, vectors = np.linalg.eigh(_matrix(r))
                vectors = vectors[:, ::-1]
                vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(3)])
                rows.append([*[getattr(r, n) for n in names], *values[::-1], *vectors.T.ravel()])
            yield pd.DataFrame(rows, columns=[*names, *columns])

    return c.mapInPandas(run, ", ".join([f"{n} {kinds[n]}" for n in names] + [f"{x} double" for x in columns]))


def cylinder_radius(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group: the mean distance from the axis, which is the principal axis whose variance is apart from the two that are closest to each other."""
    a = axes(points, by)
    low = F.abs(F.col("e1") - F.col("e2")) < F.abs(F.col("e0") - F.col("e1"))
    flat = a.select(*by, *[F.when(low, F.col(f"v{x}")).otherwise(F.col(f"u{x}")).alias("p" + x) for x in "xyz"], *[F.when(low, F.col(f"w{x}")).otherwise(F.col(f"v{x}")).alias("q" + x) for x in "xyz"])
    means = points.groupBy(*by).agg(*[F.avg(x).alias("m" + x) for x in "xyz"])
    j = points.join(means.join(flat, list(by)), list(by))
    part = lambda p: sum(((F.col(x) - F.col("m" + x)) * F.col(p + x) for x in "yz"), (F.col("x") - F.col("mx")) * F.col(p + "x"))
    return j.groupBy(*by).agg(F.avg(F.sqrt(part("p") * part("p") + part("q") * part("q"))).alias("radius"))


def fit_circle(x: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float, float, float]:
    """Centre, radius and residual of the circle with the least squares of distance less mean distance, by Gauss-Newton from the mean."""
    c = np.array([x.mean(), y.mean()])
    for _ in range(rounds):
        dx, dy = x - c[0], y - c[1]
        r = np.hypot(dx, dy)
        safe = np.where(r > 0, r, 1)
        f = r - r.mean()
        j = np.stack([-dx / safe, -dy / safe], axis=1)
        j = j - j.mean(axis=0)
        step = np.linalg.lstsq(j, f, rcond=None)[0]
        c = c - step
        if np.abs(step).max() < 1e-12:
            break
    r = np.hypot(x - c[0], y - c[1])
    return float(c[0]), float(c[1]), float(r.mean()), float(((r - r.mean()) ** 2).sum())


def circles(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """``fit_circle`` of each group's x and y.  A group is the poses of one scan, which a task holds whole."""
    names = list(by)
    kinds = dict(points.dtypes)
    ship_code(points.sparkSession)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*[pdf[n].iloc[0] for n in names], *fit_circle(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float))]], columns=[*names, "cx", "cy", "radius", "residual"])

    return points.select(*names, "x", "y").groupBy(*names).applyInPandas(run, ", ".join([f"{n} {kinds[n]}" for n in names] + ["cx double", "cy double", "radius double", "residual double"]))


def plane_ransac(points: DataFrame, by: Sequence[str], inliers: float = 0.8, rounds: int = 20, seed: int = 1) -> DataFrame:
    """The normal of the plane with the least spread among ``rounds`` samples of about ``inliers`` of a group's points, drawn by a hash of round and pid."""
    drawn = points.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    drawn = drawn.where(F.pmod(F.xxhash64("pid", "round", F.lit(seed)), F.lit(1000)) < int(1000 * inliers))
    found = axes(drawn, [*by, "round"])
    best = found.groupBy(*by).agg(F.min_by(F.struct("wx", "wy", "wz", "e2"), F.struct("e2", "round")).alias("w"))
    return best.select(*by, F.col("w.wx").alias("nx"), F.col("w.wy").alias("ny"), F.col("w.wz").alias("nz"), F.col("w.e2").alias("spread"))


def cylinder(spark, radius: float, height: float, n: int = 10_000, seed: int = 1) -> DataFrame:
    """Points on a cylinder's side: pid, x, y, z; drawn by hashes."""
    u = lambda k: F.pmod(F.xxhash64("id", F.lit(seed + k)), F.lit(1 << 30)) / float(1 << 30)
    turn = u(0) * 2 * np.pi
    return spark.range(n).select(F.col("id").alias("pid"), (radius * F.cos(turn)).alias("x"), (radius * F.sin(turn)).alias("y"), (height * u(1)).alias("z"))


def closest_values(values: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The two successive values of each group that are closest, the lesser pair on a tie."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(value)
    gaps = values.withColumn("before", F.lag(value).over(w)).where("before IS NOT NULL").withColumn("gap", F.col(value) - F.col("before"))
    return gaps.groupBy(*by).agg(F.min_by(F.struct("before", F.col(value).alias("after"), "gap"), F.struct("gap", "before")).alias("s")).select(*by, "s.before", "s.after", "s.gap")
