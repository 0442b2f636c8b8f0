"""Queries from labelled trees and organs to traits, and the remaining views of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.catalog import query
from canopy.functions.vectors import oriented, vec
from canopy.operators import graph, sequences, traits
from canopy.plans.bindings import points, table, tree_edges, using


def plant_nodes(spark, sf_dir) -> DataFrame:
    """A position for each node of the trees: levels of a binary tree go up, its places spread in a fan."""
    e = tree_edges(spark, sf_dir)
    ids = e.select("tree_id", F.col("child").alias("id")).union(e.select("tree_id", F.lit(1).cast("long")).distinct())
    level = F.floor(F.log2("id"))
    place = F.col("id") - F.pow(F.lit(2.0), level)
    return ids.select(
        F.col("tree_id").alias("graph"), "id", (place * F.cos(F.col("id") * 2.4)).alias("x"), (place * F.sin(F.col("id") * 2.4)).alias("y"), (level * 6.0).alias("z")
    )


def _labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    nodes = plant_nodes(spark, sf_dir)
    edges = tree_edges(spark, sf_dir).select(F.col("tree_id").alias("graph"), F.col("parent").alias("src"), F.col("child").alias("dst"))
    found = graph.tree_graphs(graph.weighted(nodes, edges, ["graph"]), ["graph"], root=1)
    return nodes.join(found, ["graph", "id"]), edges


@query("organ_directions")
def organ_directions(spark, sf_dir):
    """Directions of fruits and stem at every branching point."""
    nodes, edges = _labelled(spark, sf_dir)
    return traits.directions(nodes, edges, ["graph"], 20.0, 2.0)


@query("tree_traits")
def tree_traits(spark, sf_dir):
    """Angles (degrees) and internodes of every tree."""
    nodes, edges = _labelled(spark, sf_dir)
    return sequences.divergence(traits.directions(nodes, edges, ["graph"], 20.0, 2.0), ["graph"], "organ")


@query("plane_traits")
def plane_traits(spark, sf_dir):
    """Angles (degrees) and internodes by planes through numbers of nodes, flipped where the median is over half a turn."""
    nodes, edges = _labelled(spark, sf_dir)
    d = sequences.divergence(traits.directions(nodes, edges, ["graph"], planes=True), ["graph"], "organ", by_step=True)
    return sequences.median_flip(d.where(~F.isnan("angle")), ["graph"])


@query("path_votes")
def path_votes(spark, sf_dir):
    """How often downhill walks through the travel times of each class pass a cell; a class is one volume."""
    import numpy as np
    import pandas as pd

    from canopy.operators import volume
    from canopy.plans.bindings import volumes
    from canopy.session import ship_code

    ship_code(spark)
    speed = volumes(spark, sf_dir).withColumn("value", F.col("value") + 0.1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((8, 8, 8))
        dense[pdf["i"], pdf["j"], pdf["k"]] = pdf["value"]
        tips = [(7, 7, 7), (7, 0, 7), (0, 7, 7), (7, 7, 0)]
        votes = volume.path_votes(volume.geodesic(dense, [(0, 0, 0)]), tips, 0.5)
        return pd.DataFrame([(pdf["label"].iloc[0], *c, n) for c, n in votes.items()], columns=["label", "i", "j", "k", "votes"])

    return speed.groupBy("label").applyInPandas(run, "label string, i long, j long, k long, votes long")


@query("organ_traits")
def organ_traits(spark, sf_dir):
    """Angles (radians) and internodes of the organs of each scan's cloud; the first label is the stem, the others are organs."""
    p = points(spark, sf_dir).select("scan_id", F.when(F.col("label").isin("c0", "c1"), "stem").otherwise("fruit").alias("label"), F.substring("label", 2, 9).cast("int").alias("organ"), "x", "y", "z")
    return traits.organ_sequences(p, ["scan_id"], min_size=1.0, min_elongation=1.0, k=20)


@query("oriented_normals", using("points") + " SELECT pid, CASE WHEN x*nx + y*ny + z*nz < 0 THEN -nx ELSE nx END AS nx, CASE WHEN x*nx + y*ny + z*nz < 0 THEN -ny ELSE ny END AS ny, CASE WHEN x*nx + y*ny + z*nz < 0 THEN -nz ELSE nz END AS nz FROM points")
def oriented_normals(spark, sf_dir):
    """Normals turned away from the origin."""
    n = oriented(vec("x", "y", "z"), vec("nx", "ny", "nz"))
    return points(spark, sf_dir).select("pid", *[c.alias(a) for c, a in zip(n, ("nx", "ny", "nz"), strict=True)])


@query("long_organs", using("points") + ", o AS (SELECT scan_id, label, max(z) - min(z) AS length, max(x) - min(x) AS width FROM points GROUP BY ALL) SELECT scan_id, label, round(length, 6) AS length, round(width, 6) AS width FROM o WHERE length > 10 AND length / nullif(width, 0) > 1")
def long_organs(spark, sf_dir):
    o = points(spark, sf_dir).groupBy("scan_id", "label").agg((F.max("z") - F.min("z")).alias("length"), (F.max("x") - F.min("x")).alias("width"))
    return traits.long_organs(o, 10.0, 1.0).select("scan_id", "label", F.round("length", 6).alias("length"), F.round("width", 6).alias("width"))


@query("root_nodes", using("points") + " SELECT scan_id, min_by(pid, (z, pid)) AS lowest, min_by(pid, (-z, pid)) AS highest FROM points GROUP BY scan_id")
def root_nodes(spark, sf_dir):
    """The ends of each cloud along the stem's axis."""
    return points(spark, sf_dir).groupBy("scan_id").agg(F.min_by("pid", F.struct("z", "pid")).alias("lowest"), F.min_by("pid", F.struct(-F.col("z"), F.col("pid"))).alias("highest"))


@query("direction_segments", using("points") + " SELECT pid, k, round(x + k * 10 * nx, 6) AS x, round(y + k * 10 * ny, 6) AS y, round(z + k * 10 * nz, 6) AS z FROM points, (VALUES (0), (1)) t(k)")
def direction_segments(spark, sf_dir):
    """Two points for each direction: its origin and ten units along it."""
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    return points(spark, sf_dir).withColumn("k", k).select("pid", "k", *[F.round(F.col(a) + F.col("k") * 10 * F.col("n" + a), 6).alias(a) for a in "xyz"])


@query("skeleton_segments", "WITH n AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings) SELECT a.id AS src, b.id AS dst, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1 FROM n a JOIN n b ON b.id = a.id + 1")
def skeleton_segments(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    nodes = e.select(F.col("vec_id").alias("id"), *[e["embedding"][i].cast("double").alias(c) for i, c in enumerate("xyz")])
    return traits.ends_of_segments(e.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst")), nodes, [])


@query("global_range", using("points") + ", a AS (SELECT x, y, z FROM points UNION ALL SELECT nx, ny, nz FROM points) SELECT round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max FROM a")
def global_range(spark, sf_dir):
    """The range of all that is shown: two clouds together."""
    p = points(spark, sf_dir)
    both = p.select("x", "y", "z").union(p.select("nx", "ny", "nz"))
    return both.agg(*[f(a).alias(f"{a}_{n}") for a in "xyz" for f, n in ((lambda c: F.round(F.min(c), 6), "min"), (lambda c: F.round(F.max(c), 6), "max"))])


@query("display_sample", using("points") + " SELECT scan_id, least(count(*), 20) AS n FROM points GROUP BY scan_id")
def display_sample(spark, sf_dir):
    """How many points of each scan are shown if at most twenty are, drawn by a hash."""
    from pyspark.sql import Window

    order = Window.partitionBy("scan_id").orderBy(F.xxhash64("pid", F.lit(7)), "pid")
    p = points(spark, sf_dir).withColumn("n", F.row_number().over(order)).where("n <= 20")
    return p.groupBy("scan_id").agg(F.count(F.lit(1)).alias("n"))


@query("unique_stem_rows", "SELECT DISTINCT round(embedding[1]::DOUBLE, 1) + 0.0 AS x, round(embedding[2]::DOUBLE, 1) + 0.0 AS y FROM embeddings")
def unique_stem_rows(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(*[(F.round(e["embedding"][i].cast("double"), 1) + 0.0).alias(a) for i, a in enumerate("xy")]).distinct().orderBy("x", "y")


@query("ordered_by_value", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS pos FROM supplier")
def ordered_by_value(spark, sf_dir):
    """Positions of a small table's rows by value."""
    from pyspark.sql import Window

    return table(spark, sf_dir, "supplier").select("s_suppkey", F.row_number().over(Window.orderBy("s_acctbal", "s_suppkey")).cast("long").alias("pos"))


@query("knn_spanning_tree")
def knn_spanning_tree(spark, sf_dir):
    """The spanning tree of each scan's neighbour graph."""
    from canopy.operators.spatial import knn_graph

    return graph.spanning_trees(knn_graph(points(spark, sf_dir), 5, ["scan_id"]).where("src <> dst"), ["scan_id"])


@query("swapped_axes", using("points") + " SELECT pid, x, -z AS y, y AS z FROM points")
def swapped_axes(spark, sf_dir):
    from canopy.sources.meshes import swapped_axes as swap

    return points(spark, sf_dir).select("pid", *[c.alias(a) for c, a in zip(swap(*vec("x", "y", "z")), "xyz", strict=True)])
