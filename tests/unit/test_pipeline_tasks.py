"""The pipeline's tasks on a small scene whose answers are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import traits
from canopy.plans import bindings
from canopy.plans.pipeline import registry


@pytest.fixture(scope="module")
def scene(spark):
    views = bindings.views(spark)
    disk = bindings.masks(spark).withColumn("set", (F.col("value") > 0).cast("double"))
    images = disk.select(F.col("view").alias("shot_id"), "u", "v", F.lit(0.0).alias("r"), F.col("set").alias("g"), F.lit(0.0).alias("b"))
    n = range(-12, 13, 3)
    cells = spark.createDataFrame([("plant", i, j, k, float(x), float(y), float(z)) for i, x in enumerate(n) for j, y in enumerate(n) for k, z in enumerate(n)], "label string, i long, j long, k long, x double, y double, z double")
    pixels = disk.select(F.lit("fruit").alias("label"), "view", "u", "v", F.col("set").alias("value")).union(disk.select(F.lit("stem"), "view", "u", "v", 1 - F.col("set")))
    rng = np.random.default_rng(0)
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(np.vstack([rng.uniform(-3, 3, (40, 3)), rng.uniform(20, 24, (40, 3))]))], "pid long, x double, y double, z double")
    truth = points.withColumn("label", F.when(F.col("pid") < 40, "fruit").otherwise("stem"))
    return {"views": views, "images": images, "cells": cells, "label_pixels": pixels, "points": points, "truth_points": truth}


def test_masks_to_cloud(spark, scene, tmp_path):
    reg = registry(scene)
    v = reg.run(spark, "Voxels", {"Masks": {"threshold": 0.5}})
    state = {(r.i, r.j, r.k): r.value for r in v.collect()}
    assert len(state) == 9**3 and state[4, 4, 4] in (1.0, -1.0) and state[0, 0, 0] == -1.0
    cloud = reg.run(spark, "PointCloud", {"PointCloud": {"voxel_size": 3.0}}, f"file://{tmp_path}")
    assert set(cloud.columns) == {"label", "x", "y", "z", "nx", "ny", "nz"}
    assert reg.order("PointCloud") == ["Masks", "Voxels", "PointCloud"]


def test_votes_and_evaluations(spark, scene):
    reg = registry(scene)
    config = {"Segmentation2D": {"dilation": 0, "inverted_labels": []}}
    got = {r.pid: r.label for r in reg.run(spark, "SegmentedPointCloud", config).collect()}
    assert sum(got[i] == "fruit" for i in range(40)) >= 30
    rows = {r.label: r for r in reg.run(spark, "PointCloudEvaluation", config).collect()}
    assert rows[None].fitness == 1.0 and rows[None].rmse == 0.0
    assert {r.label for r in reg.run(spark, "SegmentedPointCloudEvaluation", config).collect()} == {"fruit", "stem"}
    organs = reg.run(spark, "OrganSegmentation", config)
    assert set(organs.columns) >= {"pid", "label", "organ"}


def test_tree_to_traits(spark):
    """A straight stem with a fruit at every third node, each a quarter turn further."""
    nodes, edges, n = [], [], 0
    for k in range(13):
        nodes.append((0, k, 0.0, 0.0, 4.0 * k))
        edges += [(0, k - 1, k)] if k else []
    n = 13
    for turn, k in enumerate((3, 6, 9)):
        a = turn * np.pi / 2
        for step in range(1, 4):
            nodes.append((0, n, float(4 * step * np.cos(a)), float(4 * step * np.sin(a)), 4.0 * k))
            edges.append((0, k if step == 1 else n - 1, n))
            n += 1
    t = {"nodes": spark.createDataFrame(nodes, "graph int, id long, x double, y double, z double"), "edges": spark.createDataFrame(edges, "graph int, src long, dst long")}
    reg = registry(t)
    config = {"TreeGraph": {"stem_axis_inverted": True}, "AnglesAndInternodes": {"min_fruit_size": 5.0, "node_sampling_dist": 9.0}}
    found = sorted((r.organ, r.angle, r.internode) for r in reg.run(spark, "AnglesAndInternodes", config).collect())
    assert [round(i) for _, _, i in found] == [12, 12]
    assert all(min(abs(a - 90), abs(a - 270)) < 1 for _, a, _ in found)


def test_planes_to_traits(spark):
    """Organs in one plane with the stem, on either side in turn."""
    nodes, edges = [(0, k, 0.0, 0.0, 4.0 * k) for k in range(16)], [(0, k - 1, k) for k in range(1, 16)]
    n = 16
    for turn, k in enumerate((3, 6, 9, 12)):
        for step in range(1, 4):
            nodes.append((0, n, 4.0 * step * (-1) ** turn, 0.0, 4.0 * k))
            edges.append((0, k if step == 1 else n - 1, n))
            n += 1
    t = {"nodes": spark.createDataFrame(nodes, "graph int, id long, x double, y double, z double"), "edges": spark.createDataFrame(edges, "graph int, src long, dst long")}
    tree = registry(t).run(spark, "TreeGraph", {"TreeGraph": {"stem_axis_inverted": True}})
    d = traits.directions(tree, t["edges"], ["graph"], planes=True).toPandas().sort_values("organ")
    assert np.allclose(np.abs(d["fx"]), 1, atol=1e-6) and list(np.sign(d["fx"])) == [1, -1, 1]
    assert (d["sz"] > 0).all()


def test_organs_to_traits():
    rng = np.random.default_rng(1)
    stem = np.column_stack([rng.normal(0, 0.3, 3000), rng.normal(0, 0.3, 3000), rng.uniform(0, 60, 3000)])
    organs = []
    for k in range(4):
        a, along = k * np.pi / 2, rng.uniform(0, 12, 300)
        organs.append(np.column_stack([along * np.cos(a), along * np.sin(a), np.full(300, 10.0 + 12 * k)]) + rng.normal(0, 0.2, (300, 3)))
    found = traits.organ_sequence(stem, organs, k=60)
    assert len(found) == 3
    assert all(abs(a - np.pi / 2) < 0.2 and abs(d - 12) < 3 for a, d in found)
