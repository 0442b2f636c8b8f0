"""Sparse volumes (label, i, j, k, value): class choice, scores, gradients and surfaces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["i", "j", "k"]


def best_class(volumes: DataFrame, background: str | None = None, prior: float = 1.0) -> DataFrame:
    """Per cell: the class with the greatest value (by name on a tie), that value, and the greatest of the others (0 if none)."""
    value = F.when(F.col("label") == background, F.col("value") * prior).otherwise(F.col("value")) if background else F.col("value")
    order = Window.partitionBy(*CELL).orderBy(F.desc("v"), "label")
    r = volumes.withColumn("v", value).withColumn("rank", F.row_number().over(order))
    return r.groupBy(*CELL).agg(
        F.max(F.when(F.col("rank") == 1, F.col("label"))).alias("label"), F.max(F.when(F.col("rank") == 1, F.col("v"))).alias("value"), F.coalesce(F.max(F.when(F.col("rank") == 2, F.col("v"))), F.lit(0.0)).alias("next")
    )


def assigned(volumes: DataFrame, min_contrast: float = 10.0, min_score: float = 0.2, background: str = "background", prior: float = 1.0, raw: bool = False) -> DataFrame:
    """The cells that go to their best class.

    The class's score in the tests is 1, since being chosen is what is tested:
    contrast asks 1 > min_contrast * next (where min_contrast is over 1), and the
    score asks 1 > min_score.  With ``raw`` the value itself is tested.
    """
    best = best_class(volumes, background, prior).where(F.col("label") != background)
    score = F.col("value") if raw else F.lit(1.0)
    keep = score > min_score
    if min_contrast > 1:
        keep = keep & (score > min_contrast * F.col("next"))
    return best.where(keep)


def background_of(volumes: DataFrame) -> DataFrame:
    """1 less the greatest class value of each cell."""
    return volumes.groupBy(*CELL).agg((1 - F.max("value")).alias("value"))


def log_ratio(count: Column, n_views: int, recall: Column, specificity: Column) -> Column:
    """log-likelihood ratio of ``count`` positive views."""
    absent = (n_views - count) * F.ln(specificity) + count * F.ln(1 - specificity)
    present = (n_views - count) * F.ln(1 - recall) + count * F.ln(recall)
    return present - absent


def with_prior(volumes: DataFrame, n_views: int, recall: Mapping[str, float], specificity: Mapping[str, float]) -> DataFrame:
    """Volumes of the labels that have both a recall and a specificity, scored by ``log_ratio``."""
    labels = [x for x in recall if x in specificity]
    pick = lambda m: F.create_map(*[F.lit(x) for k in labels for x in (k, float(m[k]))])[F.col("label")]
    return volumes.where(F.col("label").isin(labels)).withColumn("value", log_ratio(F.col("value"), n_views, pick(recall), pick(specificity)))


def evaluate(prediction: DataFrame, truth: DataFrame, contrast: float = 10.0) -> DataFrame:
    """tp, fn, fp, tn per label on the truth's cells, over and under 0.5; a truth of 0.5 counts for neither."""
    best = best_class(prediction).select(*CELL, F.col("label").alias("best"), (F.col("value") > contrast * F.col("next")).alias("clear"))
    j = truth.where("label <> 'background'").join(best, CELL, "left")
    p = F.coalesce((F.col("best") == F.col("label")) & F.col("clear"), F.lit(False))
    over, under = F.col("value") > 0.5, F.col("value") < 0.5
    return j.groupBy("label").agg(F.count_if(over & p).alias("tp"), F.count_if(over & ~p).alias("fn"), F.count_if(under & p).alias("fp"), F.count_if(under & ~p).alias("tn"))


def pair_difference(a: DataFrame, b: DataFrame, cells: int) -> DataFrame:
    """Per label: the sum of squared differences, and their mean absolute value over a lattice of ``cells``, both cut to whole numbers.  Missing cells are 0."""
    l, r = a.select("label", *CELL, F.col("value").alias("va")), b.select("label", *CELL, F.col("value").alias("vb"))
    d = F.coalesce("va", F.lit(0.0)) - F.coalesce("vb", F.lit(0.0))
    return l.join(r, ["label", *CELL], "full").groupBy("label").agg(F.sum(d * d).cast("long").alias("squared"), (F.sum(F.abs(d)) / cells).cast("long").alias("mean_abs"))


def gradient(volume: DataFrame, axis: str = "i", value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """Central differences along an axis of a dense volume, one-sided at its ends; a line of one cell has 0."""
    rest = [c for c in CELL if c != axis]
    w = Window.partitionBy(*by, *rest).orderBy(axis)
    before, after, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    slope = F.when(before.isNotNull() & after.isNotNull(), (after - before) / 2).when(after.isNotNull(), after - own).when(before.isNotNull(), own - before).otherwise(0.0)
    return volume.withColumn(f"d{axis}", slope)


def _distances(inside: np.ndarray) -> np.ndarray:
    """Euclidean distance of each set cell to the nearest unset cell, by parabola envelopes along each axis."""
    far = float(sum(n * n for n in inside.shape)) + 1
    d = np.where(inside, far, 0.0)
    for axis in range(d.ndim):
        n = d.shape[axis]
        x = np.arange(n)
        lines = np.moveaxis(d, axis, -1)
        best = np.full(lines.shape, np.inf)
        for q in range(n):
            np.minimum(best, lines[..., q : q + 1] + (x - q) ** 2, out=best)
        d = np.moveaxis(best, -1, axis)
    return np.sqrt(np.minimum(d, far))


def _smoothed(a: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = int(4 * sigma + 0.5)
    x = np.arange(-reach, reach + 1)
    weights = np.exp(-0.5 * (x / sigma) ** 2)
    weights /= weights.sum()
    for axis in range(a.ndim):
        pad = [(reach, reach) if k == axis else (0, 0) for k in range(a.ndim)]
        line = np.pad(a, pad, mode="symmetric")
        a = sum(w * np.take(line, range(i, i + a.shape[axis]), axis=axis) for i, w in enumerate(weights))
    return a


def surface_points(volume: np.ndarray, origin: Sequence[float], size: float, level: float = 0.0) -> np.ndarray:
    """Points and normals on the level set of a dense volume's signed distance: rows x, y, z, nx, ny, nz."""
    solid = volume > 0.5
    if not solid.any() or solid.all():
        return np.empty((0, 6))
    signed = np.where(solid, _distances(solid) - 0.5, -_distances(~solid) + 0.5)
    slopes = [_smoothed(g) for g in np.gradient(signed)]
    on = (signed > -level) & (signed <= -level + np.sqrt(3))
    at = np.argwhere(on)
    g = np.stack([s[on] for s in slopes], axis=1)
    length = np.linalg.norm(g, axis=1, keepdims=True)
    g = np.divide(g, length, out=np.zeros_like(g), where=length > 0)
    shifted = at - g * (signed[on] + level - np.sqrt(3) / 2)[:, None]
    return np.hstack([np.asarray(origin) + size * shifted, -g])


def volume_to_cloud(volumes: DataFrame, by: Sequence[str], size: float, origin: Sequence[float] = (0.0, 0.0, 0.0), level: float = 0.0) -> DataFrame:
    """``surface_points`` of each group's sparse volume; a group is one volume, made dense within its own bounds and a margin of two cells."""
    names = list(by)
    fields = {f.name: f.dataType.simpleString() for f in volumes.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf[CELL].to_numpy(dtype=np.int64)
        low = c.min(axis=0) - 2
        dense = np.zeros(c.max(axis=0) - low + 3)
        dense[tuple((c - low).T)] = pdf["value"].to_numpy(dtype=float)
        rows = surface_points(dense, np.asarray(origin) + size * low, size, level)
        out = pd.DataFrame(rows, columns=["x", "y", "z", "nx", "ny", "nz"])
        for n in reversed(names):
            out.insert(0, n, pdf[n].iloc[0])
        return out

    schema = ", ".join([f"{n} {fields[n]}" for n in names] + [f"{c} double" for c in ("x", "y", "z", "nx", "ny", "nz")])
    return volumes.groupBy(*names).applyInPandas(run, schema)


def geodesic(dense: np.ndarray, seeds: Sequence[tuple[int, int, int]], rounds: int = 10_000, tolerance: float = 1e-9) -> np.ndarray:
    """Least travel times from the seeds through positive speeds, by upwind relaxation of the eikonal equation."""
    time = np.full(dense.shape, np.inf)
    for s in seeds:
        time[s] = 0.0
    cost = np.divide(1.0, dense, out=np.full(dense.shape, np.inf), where=dense > 0)
    for _ in range(rounds):
        near = []
        for axis in range(3):
            pad = [(1, 1) if k == axis else (0, 0) for k in range(3)]
            line = np.pad(time, pad, constant_values=np.inf)
            near.append(np.minimum(np.take(line, range(0, time.shape[axis]), axis=axis), np.take(line, range(2, time.shape[axis] + 2), axis=axis)))
        a, b, c = np.sort(np.stack(near), axis=0)
        with np.errstate(invalid="ignore"):
            t = a + cost
            two = (a + b + np.sqrt(np.maximum(2 * cost**2 - (a - b) ** 2, 0))) / 2
            t = np.where(np.isfinite(b) & (t > b), two, t)
            s, q = a + b + c, a * a + b * b + c * c
            three = (s + np.sqrt(np.maximum(s * s - 3 * (q - cost**2), 0))) / 3
            t = np.where(np.isfinite(c) & (t > c), three, t)
        new = np.fmin(time, t)
        with np.errstate(invalid="ignore"):
            change = np.nan_to_num(np.where(np.isfinite(new) & ~np.isfinite(time), 1.0, time - new), nan=0.0, posinf=1.0).max()
        time = new
        if change <= tolerance:
            break
    return time


def geodesic_times(speeds: DataFrame, by: Sequence[str], seed: tuple[int, int, int]) -> DataFrame:
    """``geodesic`` for each group's volume: by, i, j, k, time for the cells reached.  A group is one volume."""
    names = list(by)
    fields = {f.name: f.dataType.simpleString() for f in speeds.schema}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = pdf[CELL].to_numpy(dtype=np.int64)
        dense = np.zeros(np.maximum(c.max(axis=0), seed) + 1)
        dense[tuple(c.T)] = pdf["value"].to_numpy(dtype=float)
        t = geodesic(dense, [seed])
        at = np.argwhere(np.isfinite(t))
        out = pd.DataFrame(at, columns=CELL)
        out["time"] = t[tuple(at.T)]
        for n in reversed(names):
            out.insert(0, n, pdf[n].iloc[0])
        return out

    return speeds.groupBy(*names).applyInPandas(run, ", ".join([f"{n} {fields[n]}" for n in names] + ["i long", "j long", "k long", "time double"]))


def path_votes(times: np.ndarray, tips: Sequence[tuple[float, float, float]], step: float = 1.0, most: int = 10_000) -> dict[tuple[int, int, int], int]:
    """How often the downhill walks from the tips enter each cell.  A walk ends within a step of the seed or where the time stops falling."""
    flow = np.gradient(np.where(np.isfinite(times), times, times[np.isfinite(times)].max() + 1))
    votes: dict[tuple[int, int, int], int] = {}
    limit = np.array(times.shape) - 1
    for tip in tips:
        p, last = np.array(tip, dtype=float), np.inf
        for _ in range(most):
            c = tuple(int(v) for v in np.clip(np.rint(p), 0, limit))
            now = times[c]
            if not now < last or now < step:
                break
            votes[c] = votes.get(c, 0) + 1
            last = now
            g = np.array([f[c] for f in flow])
            n = np.linalg.norm(g)
            if n == 0:
                break
            p = np.clip(p - step * g / n, 0, limit)
    return votes
