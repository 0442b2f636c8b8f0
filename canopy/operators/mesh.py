"""Triangle meshes as two tables: vertices (mesh_id, vid, x, y, z) and triangles (mesh_id, tid, a, b, c)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.functions.vectors import cross, det3, minus, norm, vec
from canopy.operators.iterate import components


def corners(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles with the coordinates of their corners: ax ... cz."""
    out = triangles
    for p in "abc":
        out = out.join(vertices.select("mesh_id", F.col("vid").alias(p), *[F.col(x).alias(p + x) for x in "xyz"]), ["mesh_id", p])
    return out


def _area():
    a, b, c = (vec(*(p + x for x in "xyz")) for p in "abc")
    return norm(cross(minus(b, a), minus(c, a))) / 2


def undirected_edges(triangles: DataFrame) -> DataFrame:
    """(mesh_id, tid, src, dst) of each side, src < dst."""
    sides = F.array(*[F.struct(F.least(p, q).alias("src"), F.greatest(p, q).alias("dst")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    return triangles.select("mesh_id", "tid", F.explode(sides).alias("e")).select("mesh_id", "tid", "e.src", "e.dst")


def shape(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Per mesh: area, watertight (each side belongs to two triangles), and volume, which is 0 if it isn't watertight."""
    a, b, c = (vec(*(p + x for x in "xyz")) for p in "abc")
    sums = corners(triangles, vertices).groupBy("mesh_id").agg(F.sum(_area()).alias("area"), F.abs(F.sum(det3(a, b, c)) / 6).alias("signed"))
    closed = undirected_edges(triangles).groupBy("mesh_id", "src", "dst").agg(F.count(F.lit(1)).alias("n")).groupBy("mesh_id").agg(F.every(F.col("n") == 2).alias("watertight"))
    return sums.join(closed, "mesh_id").select("mesh_id", "area", "watertight", F.when(F.col("watertight"), F.col("signed")).otherwise(0.0).alias("volume"))


def shape_ratios(shapes: DataFrame, by: Sequence[str]) -> DataFrame:
    """For each pair of meshes (mesh_a < mesh_b) of a group of replicates: the lesser over the greater area, and volume (0 if either is 0)."""
    a, b = shapes.alias("a"), shapes.alias("b")
    same = [F.col(f"a.{g}") == F.col(f"b.{g}") for g in by]
    over = lambda c: F.coalesce(F.try_divide(F.least(f"a.{c}", f"b.{c}"), F.greatest(f"a.{c}", f"b.{c}")), F.lit(0.0)).alias(f"{c}_ratio")
    return a.join(b, [*same, F.col("a.mesh_id") < F.col("b.mesh_id")]).select(F.col("a.mesh_id").alias("mesh_a"), F.col("b.mesh_id").alias("mesh_b"), over("area"), over("volume"))


def triangle_clusters(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Connected groups of triangles (over shared sides): mesh_id, tid, cluster, which is the least tid of the group."""
    e = undirected_edges(triangles)
    other = e.select("mesh_id", F.col("tid").alias("tid2"), "src", "dst")
    joined = e.join(other, ["mesh_id", "src", "dst"]).where("tid < tid2").select("mesh_id", F.col("tid").alias("src"), F.col("tid2").alias("dst"))
    found = components(triangles.select("mesh_id", F.col("tid").alias("id")), joined, ["mesh_id"])
    return found.select("mesh_id", F.col("id").alias("tid"), F.col("component").alias("cluster"))


def cluster_stats(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Triangles and area of each cluster."""
    areas = corners(triangles, vertices).select("mesh_id", "tid", _area().alias("area"))
    return triangle_clusters(triangles, vertices).join(areas, ["mesh_id", "tid"]).groupBy("mesh_id", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"))


def largest_cluster(triangles: DataFrame, vertices: DataFrame, by: str = "n") -> DataFrame:
    """The triangles of each mesh's cluster with the most triangles (``n``) or the greatest ``area``; the least cluster on a tie."""
    clusters = triangle_clusters(triangles, vertices)
    stats = cluster_stats(triangles, vertices)
    best = stats.groupBy("mesh_id").agg(F.min_by("cluster", F.struct(-F.col(by), "cluster")).alias("cluster"))
    return triangles.join(clusters.join(best, ["mesh_id", "cluster"]).select("mesh_id", "tid"), ["mesh_id", "tid"], "left_semi")


def used_vertices(vertices: DataFrame, triangles: DataFrame) -> DataFrame:
    """The vertices that a triangle refers to."""
    used = triangles.select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid")).distinct()
    return vertices.join(used, ["mesh_id", "vid"], "left_semi")
