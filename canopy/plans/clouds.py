"""Queries on point clouds: lattices, neighbours, labels, clusters and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.catalog import query
from canopy.functions.formats import pair_key
from canopy.operators import fits, graph, lattice, repeat, setmetrics, spatial
from canopy.plans.bindings import points, using

NEAREST = """nn AS (SELECT a.scan_id AS sa, b.scan_id AS sb, a.pid, min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d2
  FROM points a, points b WHERE a.scan_id <> b.scan_id GROUP BY ALL)"""


@query("voxel_histogram", using("points") + """, o AS (SELECT scan_id, min(x) AS ox, min(y) AS oy, min(z) AS oz FROM points GROUP BY scan_id)
SELECT p.scan_id, round_even((x - ox) / 5, 0)::BIGINT AS i, round_even((y - oy) / 5, 0)::BIGINT AS j, round_even((z - oz) / 5, 0)::BIGINT AS k, count(*) AS n
FROM points p JOIN o ON o.scan_id = p.scan_id GROUP BY ALL""")
def voxel_histogram(spark, sf_dir):
    return lattice.voxel_histogram(points(spark, sf_dir), 5.0, by=["scan_id"])


@query("voxel_histogram_padded", using("points") + """, o AS (SELECT min(x) - 10 AS ox, min(y) - 10 AS oy, min(z) - 10 AS oz FROM points)
SELECT round_even((x - ox) / 5, 0)::BIGINT + 2 AS i, round_even((y - oy) / 5, 0)::BIGINT + 2 AS j, round_even((z - oz) / 5, 0)::BIGINT + 2 AS k, count(*) AS n FROM points, o GROUP BY ALL""")
def voxel_histogram_padded(spark, sf_dir):
    return lattice.voxel_histogram(points(spark, sf_dir), 5.0, padding=2)


@query("index_roundtrip", using("points") + """, c AS (SELECT pid, round_even((x + 50) / 2, 0)::BIGINT AS i, round_even((y + 50) / 2, 0)::BIGINT AS j, round_even((z + 50) / 2, 0)::BIGINT AS k FROM points)
SELECT pid, i * 2.0::DOUBLE - 50 AS x, j * 2.0::DOUBLE - 50 AS y, k * 2.0::DOUBLE - 50 AS z, (i * 64 + j) * 64 + k AS flat FROM c""")
def index_roundtrip(spark, sf_dir):
    c = points(spark, sf_dir).select("pid", *[lattice.to_index(F.col(a), -50.0, 2.0).alias(n) for a, n in zip("xyz", "ijk", strict=True)])
    return c.select("pid", *[lattice.to_point(F.col(n), -50.0, 2.0).alias(a) for a, n in zip("xyz", "ijk", strict=True)], lattice.flat_index(F.col("i"), F.col("j"), F.col("k"), 64, 64).alias("flat"))


@query("crop_points", using("points") + " SELECT pid, x, y, z, nx, ny, nz, label FROM points WHERE x > -10 AND x < 10 AND y > -8 AND y < 12 AND z > -9 AND z < 9")
def crop_points(spark, sf_dir):
    return lattice.crop(points(spark, sf_dir), {"x": (10, -10), "y": (-8, 12), "z": (-9, 9)}).drop("scan_id")


@query("cloud_boxes", using("points") + """ SELECT label, floor(min(x) - 0.05 * (max(x) - min(x)))::BIGINT AS x_min, ceil(max(x) + 0.05 * (max(x) - min(x)))::BIGINT AS x_max,
floor(min(y) - 0.05 * (max(y) - min(y)))::BIGINT AS y_min, ceil(max(y) + 0.05 * (max(y) - min(y)))::BIGINT AS y_max,
floor(min(z) - 0.05 * (max(z) - min(z)))::BIGINT AS z_min, ceil(max(z) + 0.05 * (max(z) - min(z)))::BIGINT AS z_max FROM points GROUP BY label""")
def cloud_boxes(spark, sf_dir):
    return lattice.bounding_box(points(spark, sf_dir), ["label"])


@query("downsample", using("points") + """, s AS (SELECT scan_id, count(*) AS n FROM points GROUP BY 1),
c AS (SELECT p.*, n, n // 50 + 1 AS size FROM points p JOIN s ON s.scan_id = p.scan_id),
q AS (SELECT scan_id, CASE WHEN n >= 50 THEN floor(x / size)::BIGINT ELSE pid END AS i, CASE WHEN n >= 50 THEN floor(y / size)::BIGINT ELSE pid END AS j, CASE WHEN n >= 50 THEN floor(z / size)::BIGINT ELSE pid END AS k, x, y, z FROM c)
SELECT scan_id, i, j, k, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM q GROUP BY ALL""")
def downsample(spark, sf_dir):
    d = lattice.downsample(points(spark, sf_dir), 50, ["scan_id"])
    return d.select("scan_id", "i", "j", "k", "n", *[F.round(a, 6).alias(a) for a in "xyz"])


@query("label_clouds", using("points") + " SELECT label, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z FROM points WHERE label NOT IN ('c0') GROUP BY label")
def label_clouds(spark, sf_dir):
    """Clouds by label without a background label, put together again, with their centres."""
    p = points(spark, sf_dir)
    return p.where(~F.col("label").isin("c0")).groupBy("label").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(a), 6).alias(a) for a in "xyz"])


@query("nn_labels", using("points") + """ SELECT a.scan_id AS a, b.scan_id AS b, a.pid, min_by(b.label, (d.d2, b.pid)) AS nearest_label, round(min(d.d2), 6) AS d2 FROM points a, points b,
LATERAL (SELECT (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2) d WHERE a.scan_id < b.scan_id GROUP BY ALL""")
def nn_labels(spark, sf_dir):
    """The label of each point's nearest neighbour in every later scan."""
    near = spatial.knn_join(*_paired(points(spark, sf_dir)), 1, ["a", "b"])
    return near.select("a", "b", "pid", F.col("t_label").alias("nearest_label"), F.round("d2", 6).alias("d2"))


@query("nn_labels_grid", using("points") + """ SELECT a.scan_id AS a, b.scan_id AS b, a.pid, round(min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), 6) AS d2 FROM points a, points b WHERE a.scan_id < b.scan_id GROUP BY ALL""")
def nn_labels_grid(spark, sf_dir):
    """The nearest neighbours by growing cells, as used where the target is large."""
    near = spatial.knn_join(*_paired(points(spark, sf_dir)), 1, ["a", "b"], broadcast_points=0)
    return near.select("a", "b", "pid", F.round("d2", 6).alias("d2"))


@query("knn_graph", using("points") + """, r AS (SELECT a.scan_id, a.pid AS p, b.pid AS q, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM points a JOIN points b ON a.scan_id = b.scan_id),
k AS (SELECT *, row_number() OVER (PARTITION BY scan_id, p ORDER BY d2, q) AS n FROM r)
SELECT scan_id, least(p, q) AS src, greatest(p, q) AS dst, round(min(sqrt(d2)), 6) AS weight FROM k WHERE n <= 4 GROUP BY ALL""")
def knn_graph(spark, sf_dir):
    return spatial.knn_graph(points(spark, sf_dir), 4, ["scan_id"]).withColumn("weight", F.round("weight", 6))


@query("radius_graph", using("points") + """, e AS (SELECT a.scan_id, a.pid AS src, b.pid AS dst, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM points a JOIN points b ON a.scan_id = b.scan_id AND a.pid <= b.pid)
SELECT scan_id, src, dst, round(sqrt(d2), 6) AS weight FROM e WHERE d2 <= 36""")
def radius_graph(spark, sf_dir):
    return spatial.radius_graph(points(spark, sf_dir), 6.0, ["scan_id"]).withColumn("weight", F.round("weight", 6))


def _paired(p):
    """Every pair of scans: source points with the pair, and target points with it."""
    scans = p.select("scan_id").distinct()
    pairs = scans.select(F.col("scan_id").alias("a")).join(scans.select(F.col("scan_id").alias("b")), F.col("a") < F.col("b"))
    left = p.join(pairs, F.col("scan_id") == F.col("a")).drop("scan_id")
    right = p.join(pairs, F.col("scan_id") == F.col("b")).drop("scan_id")
    return left, right


@query("chamfer_pairs", using("points") + f""", {NEAREST}, m AS (SELECT sa, sb, avg(sqrt(d2)) AS d FROM nn GROUP BY ALL)
SELECT x.sa || ' - ' || x.sb AS pair, round(x.d + y.d, 6) AS chamfer FROM m x JOIN m y ON x.sa = y.sb AND x.sb = y.sa WHERE x.sa < x.sb""")
def chamfer_pairs(spark, sf_dir):
    """Mean nearest distances in both directions, summed, for each pair of replicates."""
    left, right = _paired(points(spark, sf_dir))
    there, back = spatial.mean_nearest(left, right, ["a", "b"]), spatial.mean_nearest(right, left, ["a", "b"])
    both = there.join(back.withColumnRenamed("mean_distance", "back"), ["a", "b"])
    return both.select(pair_key(F.col("a").cast("string"), F.col("b").cast("string")).alias("pair"), F.round(F.col("mean_distance") + F.col("back"), 6).alias("chamfer"))


@query("registration_fitness", using("points") + f""", {NEAREST}
SELECT sa AS a, sb AS b, round(count(*) FILTER (d2 <= 25) / count(*), 6) AS fitness, round(coalesce(sqrt(avg(d2) FILTER (d2 <= 25)), 0), 6) AS rmse FROM nn WHERE sa < sb GROUP BY ALL""")
def registration_fitness(spark, sf_dir):
    left, right = _paired(points(spark, sf_dir))
    r = spatial.registration(left, right, 5.0, ["a", "b"])
    return r.select("a", "b", F.round("fitness", 6).alias("fitness"), F.round("rmse", 6).alias("rmse"))


@query("registration_by_label", using("points") + """, nn AS (SELECT a.scan_id AS a, b.scan_id AS b, a.label, a.pid, min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d2
  FROM points a JOIN points b ON a.label = b.label WHERE a.scan_id < b.scan_id GROUP BY ALL)
SELECT a, b, label, round(count(*) FILTER (d2 <= 100) / count(*), 6) AS fitness, round(coalesce(sqrt(avg(d2) FILTER (d2 <= 100)), 0), 6) AS rmse FROM nn GROUP BY ALL""")
def registration_by_label(spark, sf_dir):
    r = spatial.registration(*_paired(points(spark, sf_dir)), 10.0, ["a", "b", "label"])
    return r.select("a", "b", "label", F.round("fitness", 6).alias("fitness"), F.round("rmse", 6).alias("rmse"))


_DIRECTION = """SELECT least(a.scan_id, b.scan_id) AS a, greatest(a.scan_id, b.scan_id) AS b, a.label AS own, min_by(b.label, ((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.pid)) AS other FROM points a, points b WHERE a.scan_id {0} b.scan_id GROUP BY a.scan_id, b.scan_id, a.pid, a.label"""


@query("labelled_iou", using("points") + f""", t AS ({_DIRECTION.format('<')}), b AS ({_DIRECTION.format('>')}), l AS (SELECT DISTINCT a, b, own AS label FROM t),
ct AS (SELECT a, b, label, count(*) FILTER (own = label AND other = label) AS tp, count(*) FILTER (own = label AND other <> label) AS fp, count(*) FILTER (own <> label AND other = label) AS fn, count(*) FILTER (own <> label AND other <> label) AS tn FROM l JOIN t USING (a, b) GROUP BY a, b, label),
cb AS (SELECT a, b, label, count(*) FILTER (own = label AND other = label) AS tp, count(*) FILTER (own = label AND other <> label) AS fp, count(*) FILTER (own <> label AND other = label) AS fn FROM l JOIN b USING (a, b) GROUP BY a, b, label)
SELECT ct.a, ct.b, ct.label, ct.tp, ct.fn, ct.tn, ct.fp, round((ct.tp / nullif(ct.tp + ct.fp + ct.fn, 0) + cb.tp / nullif(cb.tp + cb.fp + cb.fn, 0)) / 2, 6) AS miou FROM ct JOIN cb ON ct.a = cb.a AND ct.b = cb.b AND ct.label = cb.label""")
def labelled_iou(spark, sf_dir):
    """Agreement of labels for each pair of scans, the earlier as the truth."""
    r = setmetrics.labelled_iou(*_paired(points(spark, sf_dir)), ["a", "b"])
    return r.select("a", "b", "label", "tp", "fn", "tn", "fp", F.round("miou", 6).alias("miou"))


@query("label_palette", using("points") + """, c(label, red, green, blue) AS (VALUES ('c0', 1.0, 0.0, 0.0), ('c1', 0.0, 1.0, 0.0), ('c2', 0.0, 0.0, 1.0))
SELECT p.label, coalesce(red, 0.5)::DOUBLE AS red, coalesce(green, 0.5)::DOUBLE AS green, coalesce(blue, 0.5)::DOUBLE AS blue, count(*) AS n FROM points p LEFT JOIN c ON c.label = p.label GROUP BY ALL""")
def label_palette(spark, sf_dir):
    """Points by label with the palette's colour, or grey."""
    palette = spark.createDataFrame([("c0", 1.0, 0.0, 0.0), ("c1", 0.0, 1.0, 0.0), ("c2", 0.0, 0.0, 1.0)], "label string, red double, green double, blue double")
    p = points(spark, sf_dir).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return p.join(F.broadcast(palette), "label", "left").select("label", *[F.coalesce(c, F.lit(0.5)).alias(c) for c in ("red", "green", "blue")], "n")


@query("closest_values", using("points") + """, s AS (SELECT label, x, lag(x) OVER (PARTITION BY label ORDER BY x) AS b FROM points)
SELECT label, round(min_by(b, (x - b, b)), 6) AS before, round(min_by(x, (x - b, b)), 6) AS after FROM s WHERE b IS NOT NULL GROUP BY label""")
def closest_values(spark, sf_dir):
    r = fits.closest_values(points(spark, sf_dir), ["label"], "x")
    return r.select("label", F.round("before", 6).alias("before"), F.round("after", 6).alias("after"))


@query("labelled_cloud_pairs", using("points") + """, d AS (SELECT a.scan_id AS sa, b.scan_id AS sb, a.label AS own, min_by(b.label, ((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.pid)) AS other
  FROM points a, points b WHERE a.scan_id < b.scan_id GROUP BY a.scan_id, b.scan_id, a.pid, a.label)
SELECT sa || ' - ' || sb AS pair, own AS label, count(*) AS n, count(*) FILTER (own = other) AS agree FROM d GROUP BY ALL""")
def labelled_cloud_pairs(spark, sf_dir):
    left, right = _paired(points(spark, sf_dir))
    near = spatial.knn_join(left, right, 1, ["a", "b"])
    pair = pair_key(F.col("a").cast("string"), F.col("b").cast("string"))
    return near.groupBy(pair.alias("pair"), "label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == F.col("t_label")).alias("agree"))


@query("organ_clusters")
def organ_clusters(spark, sf_dir):
    """Density clusters within each label."""
    return graph.dbscan(points(spark, sf_dir), 9.0, 4, ["label"])


@query("cloud_axes")
def cloud_axes(spark, sf_dir):
    """Planes and directions of each label's cloud."""
    return fits.axes(points(spark, sf_dir), ["label"])


@query("cylinder_radius")
def cylinder_radius(spark, sf_dir):
    """Radius of generated cylinders, and the error in percent."""
    shapes = [(2.0, 30.0), (7.5, 40.0), (20.0, 90.0)]
    clouds = None
    for n, (r, h) in enumerate(shapes):
        c = fits.cylinder(spark, r, h, 10_000, n).withColumns({"cylinder": F.lit(n), "truth": F.lit(r)})
        clouds = c if clouds is None else clouds.unionByName(c)
    found = fits.cylinder_radius(clouds, ["cylinder", "truth"])
    return found.withColumn("error_percent", F.round(F.abs(F.col("radius") - F.col("truth")) / F.col("truth") * 100, 2))


@query("plane_ransac")
def plane_ransac(spark, sf_dir):
    return fits.plane_ransac(points(spark, sf_dir), ["scan_id"])


@query("root_distance_skeleton")
def root_distance_skeleton(spark, sf_dir):
    """Skeleton nodes of each scan's cloud by bins of the distance to a root."""
    p = points(spark, sf_dir)
    out = None
    for scan, root in sorted(tuple(r) for r in p.groupBy("scan_id").agg(F.min("pid")).collect()):
        nodes, _ = graph.root_distance_skeleton(p.where(F.col("scan_id") == scan), root, 6, 10.0)
        nodes = nodes.select(F.lit(scan).alias("scan_id"), *nodes.columns)
        out = nodes if out is None else out.unionByName(nodes)
    return out


@query("nearest_organ_end", using("points") + """, d AS (SELECT a.scan_id AS a, b.scan_id AS b, a.label, b.pid, min_by(a.pid, ((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), a.pid)) AS stem_pid, min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d2
  FROM points a JOIN points b ON a.label = b.label WHERE a.scan_id < b.scan_id GROUP BY a.scan_id, b.scan_id, a.label, b.pid)
SELECT a, b, label, min_by(pid, (d2, pid)) AS base, min_by(stem_pid, (d2, pid)) AS stem_pid FROM d GROUP BY ALL""")
def nearest_organ_end(spark, sf_dir):
    """Per pair of scans and label, the later scan's organ point that is closest to the earlier's stem, and the stem's point."""
    stems, organs = _paired(points(spark, sf_dir))
    near = spatial.knn_join(organs, stems, 1, ["a", "b", "label"])
    return near.groupBy("a", "b", "label").agg(F.min_by("pid", F.struct("d2", "pid")).alias("base"), F.min_by("t_pid", F.struct("d2", "pid")).alias("stem_pid"))


@query("scan_similarity", using("points") + """, f AS (SELECT scan_id, pid // 4 AS name, label FROM points)
SELECT a.scan_id AS a, b.scan_id AS b, round(100.0 * count(*) FILTER (a.label = b.label) / count(*), 6) AS similarity FROM f a JOIN f b ON a.name = b.name AND a.scan_id < b.scan_id GROUP BY ALL""")
def scan_similarity(spark, sf_dir):
    """Share of equal files between replicates, over the names that both have."""
    f = points(spark, sf_dir).select("scan_id", F.floor(F.col("pid") / 4).alias("name"), F.col("label").alias("digest"))
    pairs = repeat.replicate_pairs(f, "scan_id", ["name"])
    return pairs.groupBy(F.col("a_scan_id").alias("a"), F.col("b_scan_id").alias("b")).agg(F.round(100.0 * F.count_if(F.col("a_digest") == F.col("b_digest")) / F.count(F.lit(1)), 6).alias("similarity"))


