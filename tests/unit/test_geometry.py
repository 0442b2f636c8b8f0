"""Points, neighbours, meshes, fits and graphs against closed forms and brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from canopy.operators import alignment, fits, graph, lattice, mesh, sequences, spatial, volume
from canopy.operators.iterate import components

POINT = "pid long, x double, y double, z double"


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], POINT)


def test_index_and_point(spark):
    d = spark.createDataFrame([(0,), (1,), (7,)], "i long").select("i", lattice.to_point(F.col("i"), -0.5, 0.5).alias("x"))
    assert [r.i == r.k for r in d.select("i", lattice.to_index(F.col("x"), -0.5, 0.5).alias("k")).collect()] == [True] * 3


def test_half_goes_to_even(spark):
    d = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double").select(lattice.to_index(F.col("x"), 0.0, 1.0).alias("i"))
    assert [r.i for r in d.collect()] == [0, 2, 2]


def test_crop_is_strict(spark):
    p = cloud(spark, [(0, 0, 0), (1, 1, 1), (2, 2, 2)])
    assert [r.pid for r in lattice.crop(p, {"x": (2, 0), "y": (0, 2), "z": (0, 2)}).collect()] == [1]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 5, (60, 3)), np.vstack([rng.normal(0, 5, (90, 3)), [[80, 80, 80]]])
    d2 = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    left, right = cloud(spark, a), cloud(spark, b)
    wanted = {(i, int(j)) for i in range(60) for j in np.argsort(d2[i], kind="stable")[:3]}
    direct = {(r.pid, r.t_pid) for r in spatial.knn_join(left, right, 3).collect()}
    grid = {(r.pid, r.t_pid) for r in spatial.knn_join(left, right, 3, broadcast_points=0).collect()}
    assert direct == grid == wanted
    near = {(r.pid, r.t_pid) for r in spatial.radius_join(left, right, 2.5).collect()}
    assert near == {(i, int(j)) for i, j in zip(*np.where(d2 <= 2.5**2), strict=True)}


def test_far_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(6)
    b = rng.normal(0, 5, (120, 3))
    a = np.vstack([rng.normal(0, 5, (20, 3)), rng.normal(0, 40, (20, 3)), [[900, 0, 0], [-3e4, 2e4, 7], [0, 0, 1e6]], rng.normal(300, 5, (20, 3))])
    d2 = ((a[:, None] - b[None]) ** 2).sum(axis=2)
    for k in (1, 3):
        wanted = {(i, int(j)) for i in range(len(a)) for j in np.argsort(d2[i], kind="stable")[:k]}
        for cell in (None, 0.5):
            assert {(r.pid, r.t_pid) for r in spatial.knn_join(cloud(spark, a), cloud(spark, b), k, cell=cell, broadcast_points=0).collect()} == wanted


def test_registration(spark):
    a, b = cloud(spark, [(0, 0, 0), (5, 0, 0)]), cloud(spark, [(1, 0, 0), (50, 0, 0)])
    r = spatial.registration(a, b, 2.0).first()
    assert (r.fitness, r.rmse) == (0.5, 1.0)
    r = spatial.registration(a, b, 0.1).first()
    assert (r.fitness, r.rmse) == (0.0, 0.0)


def test_unit_cube(spark):
    from canopy.plans.replicates import _CUBE, _FACES

    v = spark.sql(f"SELECT 0 AS mesh_id, vid, CAST(x AS DOUBLE) x, CAST(y AS DOUBLE) y, CAST(z AS DOUBLE) z FROM {_CUBE}")
    t = spark.sql(f"SELECT 0 AS mesh_id, * FROM {_FACES}")
    r = mesh.shape(t, v).first()
    assert (r.area, r.volume, r.watertight) == (pytest.approx(6), pytest.approx(1), True)
    part = t.where("tid IN (0, 1, 6)")
    stats = {(r.cluster, r.n): r.area for r in mesh.cluster_stats(part, v).collect()}
    assert stats == {(0, 3): pytest.approx(1.5)}
    assert mesh.used_vertices(v, t.where("tid = 0")).count() == 3
    assert mesh.largest_cluster(t.where("tid IN (0, 1, 2)"), v).count() == 2


def test_cylinder_radius(spark):
    c = fits.cylinder(spark, 12.5, 80.0, 10_000).withColumn("g", F.lit(0))
    assert fits.cylinder_radius(c, ["g"]).first().radius == pytest.approx(12.5, abs=0.1)


def test_circle_and_plane(spark):
    t = np.linspace(0, 4, 40)
    cx, cy, r, residual = fits.fit_circle(3 + 2 * np.cos(t), -1 + 2 * np.sin(t))
    assert (cx, cy, r) == pytest.approx((3, -1, 2)) and residual < 1e-12
    rng = np.random.default_rng(1)
    xy = rng.uniform(-5, 5, (200, 2))
    p = cloud(spark, np.column_stack([xy, 0.5 * xy[:, 0]])).withColumn("g", F.lit(0))
    w = fits.axes(p, ["g"]).first()
    n = np.array([w.wx, w.wy, w.wz])
    assert abs(n @ np.array([0.5, 0, -1]) / math.hypot(0.5, 1)) == pytest.approx(1)
    assert fits.plane_ransac(p, ["g"]).first().spread == pytest.approx(0, abs=1e-9)


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101)], "src long, dst long")
    n = e.select(F.col("src").alias("id")).union(e.select("dst")).union(spark.createDataFrame([(500,)], "id long"))
    found = {r.id: r.component for r in components(n, e).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 500: 500}


def test_stem_and_tree():
    rows = [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 5.0), (1, 4, 1.0), (4, 5, 1.0), (2, 6, 1.0)]
    g = graph.adjacency(rows)
    stem, branching = graph.main_stem(g, 0)
    assert stem == [3, 2, 1, 0] and branching == [2, 1]
    tree = graph.adjacency(graph.stem_tree(g, stem, branching))
    found = graph.label_tree(g, tree, stem, branching)
    assert [found[n]["main_stem_id"] for n in (0, 1, 2, 3)] == [0, 1, 2, 3]
    assert [(found[n]["labels"], found[n]["fruit_id"]) for n in (4, 5, 6)] == [(["fruit"], 0), (["fruit"], 0), (["fruit"], 1)]
    assert graph.hops(tree, 0, 2) == {1: 1, 2: 2, 4: 2}


def test_spanning_tree():
    assert graph.spanning_tree([(0, 1, 1.0), (1, 2, 2.0), (0, 2, 3.0), (5, 6, 0.5)]) == [(5, 6, 0.5), (0, 1, 1.0), (1, 2, 2.0)]


def test_dbscan(spark):
    p = cloud(spark, [(0, 0, 0), (1, 0, 0), (2, 0, 0), (10, 0, 0), (11, 0, 0), (12, 0, 0), (50, 0, 0), (3, 0, 0)])
    found = {r.pid: r.cluster for r in graph.dbscan(p, 1.0, 3).collect()}
    assert found == {0: 1, 1: 1, 2: 1, 7: 1, 3: 4, 4: 4, 5: 4}


def test_connected(spark):
    p = cloud(spark, [(0, 0, 0), (1, 0, 0), (5, 0, 0), (6, 0, 0)])
    e = spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "src long, dst long, weight double")
    assert {tuple(r) for r in graph.connected(p, e, 0).collect()} == {(0, 1, 1.0), (2, 3, 1.0), (1, 2, 4.0)}


def test_ball_surface():
    x = np.indices((40, 40, 40)) - 20
    ball = ((x**2).sum(axis=0) <= 12**2).astype(float)
    rows = volume.surface_points(ball, (-20, -20, -20), 1.0)
    r = np.linalg.norm(rows[:, :3], axis=1)
    assert len(rows) > 500 and abs(r.mean() - 12) < 1.0
    assert (np.einsum("ij,ij->i", rows[:, :3] / r[:, None], rows[:, 3:]) > 0.8).mean() > 0.95


def test_geodesic_and_votes():
    t = volume.geodesic(np.ones((9, 9, 3)), [(0, 0, 0)])
    assert t[0, 0, 0] == 0 and t[8, 0, 0] == pytest.approx(8)
    assert t[8, 8, 0] == pytest.approx(math.hypot(8, 8), rel=0.12)
    votes = volume.path_votes(t, [(8, 0, 0), (8, 0, 0)])
    assert votes[(8, 0, 0)] == 2 and votes[(4, 0, 0)] == 2


def test_alignment(spark):
    s = "array<struct<angle: double, internode: double>>"
    a, b = [(137.0, 10.0), (140.0, 12.0), (130.0, 9.0)], [(10.0, 50.0), (137.0, 10.0), (140.0, 12.0), (130.0, 9.0)]
    d = spark.createDataFrame([(0, a, a), (1, a, b), (2, [], a)], f"k long, a {s}, b {s}")
    found = {r.k: r for r in alignment.align(d, ["k"], free_ends=0.34).collect()}
    assert found[0].cost == pytest.approx(0) and found[0].matches == 3
    assert found[1].cost == pytest.approx(0) and (found[1].b0, found[1].b1) == (1, 0)
    assert found[2].cost is None


def test_angle_wraps():
    c = alignment.mixed_cost(np.array([[350.0, 1.0]]), np.array([[10.0, 1.0]]))
    assert c[0, 0] == pytest.approx(0.5 * 20 / 180)


def test_runs(spark):
    d = spark.createDataFrame([(0, i, f) for i, f in enumerate([1, 0, 1, 1, 1, 0, 1, 1], 1)], "s long, pos long, f int").withColumn("f", F.col("f") == 1)
    r = sequences.blind_angles(d, ["s"], "pos", "f").first()
    assert (r.longest, r.blind_angle) == (3, 135.0)


def test_right_angle_divergence(spark):
    row = lambda i, f: (0, i, *f, 0.0, 0.0, 1.0, 0.0, 0.0, 3.0 * i)
    names = ["s", "pos", *[p + x for p in "fsb" for x in "xyz"]]
    d = spark.createDataFrame([row(0, (1.0, 0.0, 0.0)), row(1, (0.0, 1.0, 0.0)), row(2, (1.0, 0.0, 0.0))], names)
    found = {r.pos: (r.angle, r.internode) for r in sequences.divergence(d, ["s"], "pos").collect()}
    assert found[1] == pytest.approx((90, 3)) and found[2] == pytest.approx((270, 3))


def test_free_ends_against_all_choices():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (4, 9), (11, 8), (10, 10)):
        a, b = (np.column_stack([rng.uniform(0, 360, k), rng.exponential(9, k)]) for k in (n, m))
        ways = []
        for p, q, r, s in np.ndindex(*[int(k * 0.3) + 1 for k in (n, n, m, m)]):
            if p + q < n and r + s < m:
                cost, path = alignment.warp(alignment.mixed_cost(a[p : n - q], b[r : m - s]))
                ways.append((cost, p + q + r + s, p, q, r, s, len(path)))
        best = min(ways)
        assert alignment.free_warp(a, b, 0.3, at_once=7) == (best[0], best[6], *best[2:6])


def test_whole_sequences_are_aligned(spark, sf):
    from canopy.plans.bindings import measures
    from canopy.plans.replicates import sequence_alignment

    size = {r.scan_id: r["count"] for r in measures(spark, sf).groupBy("scan_id").count().collect()}
    found = sequence_alignment(spark, sf).collect()
    assert found and all(r.matches >= max(size[r.scan_id] - r.a0 - r.a1, size[r.scan_id + 1] - r.b0 - r.b1) for r in found)
