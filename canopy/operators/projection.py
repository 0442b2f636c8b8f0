"""Projecting points and voxels into views, and aggregating what the views show.

The views are a small table (cameras of a scan) that is broadcast after a count;
pixels are joined by (view, u, v).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.cameras import centre, pixel, to_camera
from canopy.functions.vectors import dot, minus, plus, scale, vec

#: A table of views is broadcast if it has at most so many rows.
BROADCAST_VIEWS = 10_000
LOG_FLOOR = 1e-10


def rotation():
    return [vec(f"r{i}0", f"r{i}1", f"r{i}2") for i in range(3)]


def translation():
    return vec("tx", "ty", "tz")


def in_picture(u, v, width: int, height: int):
    return (u >= 0) & (u < width) & (v >= 0) & (v < height)


def project(points: DataFrame, views: DataFrame, focal: float, cx: float, cy: float) -> DataFrame:
    """Each point in each view: px, py and depth; no test of the depth's sign."""
    views = F.broadcast(views) if views.count() <= BROADCAST_VIEWS else views
    at = to_camera(rotation(), translation(), vec("x", "y", "z"))
    px, py = pixel(F.lit(focal), F.lit(focal), F.lit(cx), F.lit(cy), at)
    return points.join(views).withColumns({"px": px, "py": py, "depth": at[2]})


def seen_pixels(points: DataFrame, views: DataFrame, focal: float, cx: float, cy: float, width: int, height: int) -> DataFrame:
    """The points in front of a view and within its picture, with whole pixels u, v.  Truncation goes towards zero, so (-1, 0) counts as 0."""
    p = project(points, views, focal, cx, cy).where("depth >= 0")
    p = p.withColumns({"u": F.col("px").cast("long"), "v": F.col("py").cast("long")})
    return p.where(in_picture(F.col("u"), F.col("v"), width, height))


def carve(cells: DataFrame, seen: DataFrame, masks: DataFrame, by: Sequence[str]) -> DataFrame:
    """state of each cell: -1 if any view shows it on background, 1 if it was seen otherwise, 0 if never."""
    hit = seen.join(masks.select("view", "u", "v", "value"), ["view", "u", "v"]).groupBy(*by).agg(F.min("value").alias("least"))
    state = F.when(F.col("least") == 0, -1).when(F.col("least").isNotNull(), 1).otherwise(0)
    return cells.join(hit, list(by), "left").select(*by, state.alias("state"))


def average(cells: DataFrame, seen: DataFrame, masks: DataFrame, by: Sequence[str], log: bool = True) -> DataFrame:
    """Sum over views of the mask as a share of 255; with ``log`` the sum of its logarithms, and ``value`` the product, at most 1."""
    share = F.col("value") / 255
    one = F.ln(F.lit(LOG_FLOOR) + share) if log else share
    hit = seen.join(masks.select("view", "u", "v", "value"), ["view", "u", "v"]).groupBy(*by).agg(F.sum(one).alias("total"))
    out = cells.join(hit, list(by), "left").withColumn("total", F.coalesce("total", F.lit(0.0)))
    return out.select(*by, "total", (F.least(F.exp("total"), F.lit(1.0)) if log else F.col("total")).alias("value"))


def vote(points: DataFrame, seen: DataFrame, masks: DataFrame, labels: Sequence[str]) -> DataFrame:
    """The label with the highest sum of mask values over views, ties and unseen points to the first label.  ``masks`` has label, view, u, v, value."""
    got = seen.select("pid", "view", "u", "v").join(masks, ["view", "u", "v"]).groupBy("pid", "label").agg(F.sum("value").alias("score"))
    rank = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    best = got.where("score > 0").groupBy("pid").agg(F.min_by("label", F.struct(-F.col("score"), rank)).alias("best"))
    return points.select("pid").join(best, "pid", "left").select("pid", F.coalesce("best", F.lit(labels[0])).alias("label"))


def camera_centres(views: DataFrame) -> DataFrame:
    c = centre(rotation(), translation())
    return views.select("view", *[x.alias(n) for x, n in zip(c, "xyz", strict=True)])


def plane_corners(views: DataFrame, focal: float, cx: float, cy: float, width: int, height: int, origin, normal) -> DataFrame:
    """Where the rays through a picture's four corners meet a plane: view, corner, x, y, z; null for a ray along the plane."""
    corners = [(0.0, 0.0), (float(width), 0.0), (float(width), float(height)), (0.0, float(height))]
    at = F.array(*[F.struct(F.lit(i).alias("corner"), F.lit((u - cx) / focal).alias("a"), F.lit((v - cy) / focal).alias("b")) for i, (u, v) in enumerate(corners)])
    rows = views.withColumn("c", F.explode(at)).select("*", "c.corner", "c.a", "c.b")
    r = rotation()
    ray = tuple(r[0][i] * F.col("a") + r[1][i] * F.col("b") + r[2][i] for i in range(3))
    stand = centre(r, translation())
    n = tuple(F.lit(float(x)) for x in normal)
    t = dot(n, minus(tuple(F.lit(float(x)) for x in origin), stand)) / F.nullif(dot(n, ray), F.lit(0.0))
    hit = plus(stand, scale(ray, t))
    return rows.select("view", F.col("corner").cast("long").alias("corner"), *[x.alias(c) for x, c in zip(hit, "xyz", strict=True)])
