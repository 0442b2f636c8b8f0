"""The phenotyping pipeline as tasks over tables: masks, volumes, clouds, organs, trees, traits and evaluations.

Inputs are tables in the store, named as in ``INPUTS``.  Stages that only
outside programs can do (structure from motion, meshing, mesh skeletons, image
segmentation by a network) are inputs here: their tables are the contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.operators import graph, projection, raster, sequences, setmetrics, spatial, traits, volume
from canopy.plans.tasks import Registry

#: Table: columns.
INPUTS = {
    "images": "shot_id, u, v, r, g, b",
    "views": "view, r00 ... r22, tx, ty, tz",
    "cells": "label, i, j, k, x, y, z (the lattice)",
    "label_pixels": "label, view, u, v, value",
    "points": "pid, x, y, z",
    "nodes": "graph, id, x, y, z",
    "edges": "graph, src, dst",
    "truth_points": "pid, x, y, z, label",
    "truth_volume": "label, i, j, k, value",
}


def registry(tables: dict[str, DataFrame]) -> Registry:
    """The tasks over these input tables.  A task whose input is missing fails when it is run, not before."""
    reg = Registry()
    t = tables.__getitem__

    @reg.task("Masks", type="linear", parameters=[0, 1, 0], threshold=0.3, dilation=0)
    def masks(spark, inputs, type, parameters, threshold, dilation):  # noqa: A002
        value = raster.mask(raster.image_filter(type, parameters), threshold)
        out = raster.rescaled(t("images"), ["shot_id"]).select("shot_id", "u", "v", value.alias("value"))
        return raster.dilate(out, raster.disk(dilation), ["shot_id"]) if dilation else out

    @reg.task("Segmentation2D", threshold=0.01, dilation=1, inverted_labels=["background"])
    def segmentation(spark, inputs, threshold, dilation, inverted_labels):
        """From a network's label scores to label masks."""
        p = t("label_pixels")
        turned = F.col("label").isin(*inverted_labels) if inverted_labels else F.lit(False)
        p = p.withColumn("value", raster.mask(F.when(turned, 1 - F.col("value")).otherwise(F.col("value")), threshold))
        p = raster.dilate(p, raster.disk(dilation), ["label", "view"])
        return p.withColumn("value", F.when(turned, raster.inverted(F.col("value"))).otherwise(F.col("value")))

    @reg.task("Voxels", ("Masks",), type="carving", focal=256.0, cx=32.0, cy=32.0, width=64, height=64)
    def voxels(spark, inputs, type, focal, cx, cy, width, height):  # noqa: A002
        cells = t("cells").select("label", "i", "j", "k", "x", "y", "z")
        seen = projection.seen_pixels(cells, t("views"), focal, cx, cy, width, height)
        m = inputs["Masks"].withColumnRenamed("shot_id", "view")
        key = ["label", "i", "j", "k"]
        if type == "carving":
            return projection.carve(cells, seen, m, key).select(*key, F.col("state").cast("double").alias("value"))
        return projection.average(cells, seen, m, key).select(*key, "value")

    @reg.task("VoxelsWithPrior", ("Voxels",), recall={}, specificity={}, n_views=1)
    def prior(spark, inputs, recall, specificity, n_views):
        return volume.with_prior(inputs["Voxels"], n_views, recall, specificity)

    @reg.task("PointCloud", ("Voxels",), level_set_value=0.0, background_prior=1.0, min_contrast=10.0, min_score=0.2, voxel_size=1.0)
    def point_cloud(spark, inputs, level_set_value, background_prior, min_contrast, min_score, voxel_size):
        v = inputs["Voxels"]
        if v.select("label").distinct().limit(2).count() > 1:
            v = volume.assigned(v, min_contrast, min_score, prior=background_prior).withColumn("value", F.lit(1.0))
        return volume.volume_to_cloud(v.where("value > 0.5"), ["label"], voxel_size, level=level_set_value)

    @reg.task("SegmentedPointCloud", ("Segmentation2D",), labels=[], focal=256.0, cx=32.0, cy=32.0, width=64, height=64)
    def segmented(spark, inputs, labels, focal, cx, cy, width, height):
        p = t("points")
        seen = projection.seen_pixels(p, t("views"), focal, cx, cy, width, height)
        names = sorted(labels) or sorted(r.label for r in inputs["Segmentation2D"].select("label").distinct().collect())
        return p.join(projection.vote(p, seen, inputs["Segmentation2D"], [n for n in names if n not in ("background", "rgb")]), "pid")

    @reg.task("OrganSegmentation", ("SegmentedPointCloud",), eps=2.0, min_points=5)
    def organs(spark, inputs, eps, min_points):
        p = inputs["SegmentedPointCloud"]
        found = graph.dbscan(p.where("label <> 'stem'"), eps, min_points, ["label"])
        clustered = p.join(found.select("pid", F.col("cluster").alias("organ")), "pid")
        return clustered.unionByName(p.where("label = 'stem'").withColumn("organ", F.lit(-1).cast("long")))

    @reg.task("TreeGraph", z_axis=2, stem_axis_inverted=False)
    def tree(spark, inputs, z_axis, stem_axis_inverted):
        """Labelled trees; the root is each skeleton's lowest point along the axis if that is inverted, else its highest."""
        nodes = t("nodes")
        axis = F.col("xyz"[z_axis])
        root = nodes.groupBy("graph").agg(F.min_by("id", F.struct(axis if stem_axis_inverted else -axis, "id")).alias("root"))
        edges = graph.weighted(nodes, t("edges"), ["graph"]).join(root, "graph")
        shift = lambda c: F.when(F.col(c) == F.col("root"), F.lit(-1)).otherwise(F.col(c)).alias(c)  # noqa: E731  the root becomes the least id
        found = graph.tree_graphs(edges.select("graph", shift("src"), shift("dst"), "weight"), ["graph"])
        found = found.join(root, "graph").withColumn("id", F.when(F.col("id") == -1, F.col("root")).otherwise(F.col("id"))).drop("root")
        return nodes.join(found, ["graph", "id"])

    @reg.task("AnglesAndInternodes", ("TreeGraph",), node_sampling_dist=10.0, min_fruit_size=6.0)
    def angles(spark, inputs, node_sampling_dist, min_fruit_size):
        d = traits.directions(inputs["TreeGraph"], t("edges"), ["graph"], node_sampling_dist, min_fruit_size)
        return sequences.divergence(d, ["graph"], "organ")

    @reg.task("OrganAngles", ("OrganSegmentation",), characteristic_length=1.0, stem_axis=2, stem_axis_inverted=False, min_elongation_ratio=2.0, min_fruit_size=6.0)
    def organ_angles(spark, inputs, characteristic_length, stem_axis, stem_axis_inverted, min_elongation_ratio, min_fruit_size):
        p = inputs["OrganSegmentation"].withColumn("scan", F.lit(0))
        return traits.organ_sequences(p, ["scan"], axis=stem_axis, step=characteristic_length, inverted=stem_axis_inverted, min_size=min_fruit_size, min_elongation=min_elongation_ratio)

    @reg.task("PointCloudEvaluation", ("SegmentedPointCloud",), max_distance=2.0)
    def cloud_evaluation(spark, inputs, max_distance):
        """Fitness and RMSE overall (label null) and per label."""
        p, g = inputs["SegmentedPointCloud"].select("pid", "x", "y", "z", "label"), t("truth_points")
        whole = spatial.registration(g.drop("label"), p.drop("label"), max_distance).select(F.lit(None).cast("string").alias("label"), "fitness", "rmse")
        return whole.unionByName(spatial.registration(g, p, max_distance, ["label"]))

    @reg.task("SegmentedPointCloudEvaluation", ("SegmentedPointCloud",))
    def label_evaluation(spark, inputs):
        return setmetrics.labelled_iou(t("truth_points"), inputs["SegmentedPointCloud"])

    @reg.task("VoxelsEvaluation", ("Voxels",), contrast=10.0)
    def voxel_evaluation(spark, inputs, contrast):
        return volume.evaluate(inputs["Voxels"], t("truth_volume"), contrast)

    return reg
