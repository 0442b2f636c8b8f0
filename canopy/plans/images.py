"""Queries on views, masks, images and volumes."""

from __future__ import annotations

from pyspark.sql import functions as F

from canopy.catalog import query
from canopy.operators import projection, raster, setmetrics, volume
from canopy.plans.bindings import CENTRE, FOCAL, SIDE, images, label_masks, masks, points, using, views, volumes

_CAM = """cam AS (SELECT p.*, view, r00*x + r01*y + r02*z + tx AS cx, r10*x + r11*y + r12*z + ty AS cy, r20*x + r21*y + r22*z + tz AS cz FROM points p, views),
proj AS (SELECT *, 256.0::DOUBLE * cx / nullif(cz, 0) + 32 AS px, 256.0::DOUBLE * cy / nullif(cz, 0) + 32 AS py FROM cam)"""
_SEEN = _CAM + """, seen AS (SELECT * FROM (SELECT *, trunc(px)::BIGINT AS u, trunc(py)::BIGINT AS v FROM proj WHERE cz >= 0) WHERE u >= 0 AND u < 64 AND v >= 0 AND v < 64),
hit AS (SELECT s.*, m.value FROM seen s JOIN masks m ON m.view = s.view AND m.u = s.u AND m.v = s.v)"""


def _seen(spark, sf_dir):
    return projection.seen_pixels(points(spark, sf_dir), views(spark), FOCAL, CENTRE, CENTRE, SIDE, SIDE)


@query("project_points", using("points", "views") + f", {_CAM} SELECT pid, view, round(px, 6) AS px, round(py, 6) AS py, round(cz, 6) AS depth, px >= 0 AND px < 64 AND py >= 0 AND py < 64 AS in_picture FROM proj")
def project_points(spark, sf_dir):
    p = projection.project(points(spark, sf_dir), views(spark), FOCAL, CENTRE, CENTRE)
    inside = projection.in_picture(F.col("px"), F.col("py"), SIDE, SIDE)
    return p.select("pid", "view", *[F.round(c, 6).alias(c) for c in ("px", "py", "depth")], inside.alias("in_picture"))


@query("carve", using("points", "views", "masks") + f""", {_SEEN}, a AS (SELECT pid, min(value) AS least FROM hit GROUP BY pid)
SELECT p.pid, CASE WHEN least = 0 THEN -1 WHEN least IS NOT NULL THEN 1 ELSE 0 END AS state FROM points p LEFT JOIN a ON a.pid = p.pid""")
def carve(spark, sf_dir):
    return projection.carve(points(spark, sf_dir).select("pid"), _seen(spark, sf_dir), masks(spark), ["pid"])


@query("average_backprojection", using("points", "views", "masks") + f""", {_SEEN}, a AS (SELECT pid, sum(ln(1e-10::DOUBLE + value / 255)) AS t FROM hit GROUP BY pid)
SELECT p.pid, round(coalesce(t, 0), 6) AS total, round(least(exp(coalesce(t, 0)), 1.0), 6) AS value FROM points p LEFT JOIN a ON a.pid = p.pid""")
def average_backprojection(spark, sf_dir):
    a = projection.average(points(spark, sf_dir).select("pid"), _seen(spark, sf_dir), masks(spark), ["pid"])
    return a.select("pid", F.round("total", 6).alias("total"), F.round("value", 6).alias("value"))


@query("sum_backprojection", using("points", "views", "masks") + f""", {_SEEN}, a AS (SELECT pid, sum(value / 255) AS t FROM hit GROUP BY pid)
SELECT p.pid, round(coalesce(t, 0), 6) AS total, round(coalesce(t, 0), 6) AS value FROM points p LEFT JOIN a ON a.pid = p.pid""")
def sum_backprojection(spark, sf_dir):
    a = projection.average(points(spark, sf_dir).select("pid"), _seen(spark, sf_dir), masks(spark), ["pid"], log=False)
    return a.select("pid", F.round("total", 6).alias("total"), F.round("value", 6).alias("value"))


@query("label_vote", using("points", "views", "masks") + f""", {_SEEN}, s AS (SELECT pid, CASE WHEN value > 0 THEN 'fruit' ELSE 'leaf' END AS label, sum(CASE WHEN value > 0 THEN value ELSE 200 END) AS score FROM hit GROUP BY ALL),
b AS (SELECT pid, min_by(label, (-score, label)) AS label FROM s WHERE score > 0 GROUP BY pid) SELECT p.pid, coalesce(b.label, 'fruit') AS label FROM points p LEFT JOIN b ON b.pid = p.pid""")
def label_vote(spark, sf_dir):
    """Points labelled by the class masks of all views: the disk votes for fruit, the rest for leaf."""
    m = masks(spark)
    label = F.when(F.col("value") > 0, "fruit").otherwise("leaf")
    classes = m.select(label.alias("label"), "view", "u", "v", F.when(F.col("value") > 0, F.col("value")).otherwise(200).alias("value"))
    return projection.vote(points(spark, sf_dir), _seen(spark, sf_dir), classes, ["fruit", "leaf"])


@query("pose_from_extrinsics", using("views") + " SELECT view, round(-(r00*tx + r10*ty + r20*tz), 6) + 0.0 AS x, round(-(r01*tx + r11*ty + r21*tz), 6) + 0.0 AS y, round(-(r02*tx + r12*ty + r22*tz), 6) + 0.0 AS z FROM views")
def pose_from_extrinsics(spark, sf_dir):
    c = projection.camera_centres(views(spark))
    return c.select("view", *[(F.round(a, 6) + 0.0).alias(a) for a in "xyz"])  # no negative zero


@query("camera_plane", using("views") + """, c(corner, a, b) AS (VALUES (0, -0.125::DOUBLE, -0.125::DOUBLE), (1, 0.125::DOUBLE, -0.125::DOUBLE), (2, 0.125::DOUBLE, 0.125::DOUBLE), (3, -0.125::DOUBLE, 0.125::DOUBLE)),
s AS (SELECT *, -(r00*tx + r10*ty + r20*tz) AS px, -(r01*tx + r11*ty + r21*tz) AS py, -(r02*tx + r12*ty + r22*tz) AS pz, r00*a + r10*b + r20 AS dx, r01*a + r11*b + r21 AS dy, r02*a + r12*b + r22 AS dz FROM views, c),
t AS (SELECT *, (-50 - pz) / nullif(dz, 0) AS t FROM s)
SELECT view, corner::BIGINT AS corner, round(px + t*dx, 3) AS x, round(py + t*dy, 3) AS y, round(pz + t*dz, 3) AS z FROM t""")
def camera_plane(spark, sf_dir):
    p = projection.plane_corners(views(spark), FOCAL, CENTRE, CENTRE, SIDE, SIDE, (0, 0, -50), (0, 0, 1))
    return p.select("view", "corner", *[F.round(a, 3).alias(a) for a in "xyz"])


_RESCALED = """s AS (SELECT shot_id, min(least(r, g, b)) AS lo, max(greatest(r, g, b)) AS hi FROM images GROUP BY 1),
q AS (SELECT i.shot_id, u, v, coalesce((r - lo) / nullif(hi - lo, 0), 0) AS r, coalesce((g - lo) / nullif(hi - lo, 0), 0) AS g, coalesce((b - lo) / nullif(hi - lo, 0), 0) AS b FROM images i JOIN s ON s.shot_id = i.shot_id)"""


@query("linear_mask", using("images") + f", {_RESCALED} SELECT shot_id, u, v, CASE WHEN 0.1::DOUBLE * r + 1.0::DOUBLE * g + 0.1::DOUBLE * b > 0.5 THEN 255 ELSE 0 END AS mask, 255 - CASE WHEN 0.1::DOUBLE * r + 1.0::DOUBLE * g + 0.1::DOUBLE * b > 0.5 THEN 255 ELSE 0 END AS inverted FROM q")
def linear_mask(spark, sf_dir):
    m = raster.mask(raster.image_filter("linear", (0.1, 1.0, 0.1)), 0.5)
    return raster.rescaled(images(spark, sf_dir), ["shot_id"]).select("shot_id", "u", "v", m.alias("mask"), raster.inverted(m).alias("inverted"))


@query("excess_green", using("images") + f", {_RESCALED}, e AS (SELECT shot_id, u, v, r + g + b + 1e-9::DOUBLE AS s, r, g, b FROM q) SELECT shot_id, u, v, round(2 * (g / s) - r / s - b / s, 6) + 0.0 AS value FROM e")
def excess_green(spark, sf_dir):
    return raster.rescaled(images(spark, sf_dir), ["shot_id"]).select("shot_id", "u", "v", (F.round(raster.image_filter("excess_green"), 6) + 0.0).alias("value"))


@query("dilate_disk", using("images") + """, m AS (SELECT shot_id, u, v, CASE WHEN r > 240 THEN 255 ELSE 0 END AS value FROM images)
SELECT a.shot_id, a.u, a.v, coalesce(max(b.value), 0) AS value FROM m a LEFT JOIN m b ON a.shot_id = b.shot_id AND (a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v) <= 4 AND b.value <> 0 GROUP BY a.shot_id, a.u, a.v""")
def dilate_disk(spark, sf_dir):
    m = images(spark, sf_dir).select("shot_id", "u", "v", raster.mask(F.col("r"), 240).alias("value"))
    return raster.dilate(m, raster.disk(2), ["shot_id"])


@query("dilate_cross", using("label_masks") + """ SELECT a.shot_id, a.channel, a.u, a.v, coalesce(max(b.pred), 0) AS pred FROM label_masks a LEFT JOIN label_masks b
ON a.shot_id = b.shot_id AND a.channel = b.channel AND abs(a.u - b.u) + abs(a.v - b.v) <= 1 AND b.pred > 0 GROUP BY ALL""")
def dilate_cross(spark, sf_dir):
    m = label_masks(spark, sf_dir).select("shot_id", "channel", "u", "v", "pred")
    return raster.cross_dilate(m, 1, ["shot_id", "channel"], "pred")


_FILES = """f AS (SELECT channel, shot_id, count(*) FILTER (gt <> 0 AND pred <> 0) AS tp, count(*) FILTER (gt <> 0 AND pred = 0) AS fn, count(*) FILTER (gt = 0 AND pred = 0) AS tn, count(*) FILTER (gt = 0 AND pred <> 0) AS fp FROM label_masks GROUP BY ALL)"""


@query("mask_confusion", using("label_masks") + f", {_FILES} SELECT channel, shot_id, tp, fn, tn, fp, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp + fn, 0), 6) AS iou FROM f")
def mask_confusion(spark, sf_dir):
    f = setmetrics.per_file(label_masks(spark, sf_dir), ["channel", "shot_id"])
    return f.select("channel", "shot_id", *setmetrics.COUNTS, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "iou")])


@query("mask_evaluation", using("label_masks") + """, d AS (SELECT a.channel, a.shot_id, a.u, a.v, any_value(a.gt) AS gt, coalesce(max(b.pred), 0) AS pred FROM label_masks a LEFT JOIN label_masks b
ON a.shot_id = b.shot_id AND a.channel = b.channel AND abs(a.u - b.u) + abs(a.v - b.v) <= 1 AND b.pred > 0 GROUP BY a.channel, a.shot_id, a.u, a.v),
f AS (SELECT channel, shot_id, count(*) FILTER (gt <> 0 AND pred <> 0) AS tp, count(*) FILTER (gt <> 0 AND pred = 0) AS fn, count(*) FILTER (gt = 0 AND pred = 0) AS tn, count(*) FILTER (gt = 0 AND pred <> 0) AS fp FROM d GROUP BY ALL)
SELECT channel, shot_id, tp, fn, tn, fp, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp + fn, 0), 6) AS iou FROM f""")
def mask_evaluation(spark, sf_dir):
    """Predicted masks, dilated once, against masks of the same shape."""
    m = label_masks(spark, sf_dir)
    truth, prediction = (m.select("channel", "shot_id", "u", "v", F.col(c).alias("value")) for c in ("gt", "pred"))
    f = setmetrics.compare_masks(truth, prediction, ["channel", "shot_id"], 1)
    return f.select("channel", "shot_id", *setmetrics.COUNTS, *[F.round(c, 6).alias(c) for c in ("precision", "recall", "iou")])


@query("fileset_metrics", using("label_masks") + f""", {_FILES}, g AS (SELECT channel, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, sum(tn)::BIGINT AS tn, sum(fp)::BIGINT AS fp, avg(tp / nullif(tp + fp + fn, 0)) AS miou FROM f GROUP BY channel)
SELECT channel, tp, fn, tn, fp, round(miou, 6) AS miou, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM g""")
def fileset_metrics(spark, sf_dir):
    m = setmetrics.merged(setmetrics.per_file(label_masks(spark, sf_dir), ["channel", "shot_id"]), ["channel"])
    return m.select("channel", *setmetrics.COUNTS, *[F.round(c, 6).alias(c) for c in ("miou", "precision", "recall")])


@query("corpus_metrics", using("label_masks") + f""", {_FILES}, g AS (SELECT shot_id % 2 AS task, channel, sum(tp) AS tp, sum(fn) AS fn, sum(tn) AS tn, sum(fp) AS fp FROM f GROUP BY ALL)
SELECT task, channel, tp::BIGINT AS tp, fp::BIGINT AS fp, tn::BIGINT AS tn, fn::BIGINT AS fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM g""")
def corpus_metrics(spark, sf_dir):
    f = setmetrics.per_file(label_masks(spark, sf_dir), ["channel", "shot_id"]).withColumn("task", F.col("shot_id") % 2)
    m = setmetrics.merged(f, ["task", "channel"])
    return m.select("task", "channel", *setmetrics.COUNTS, *[F.round(c, 6).alias(c) for c in ("precision", "recall")])


@query("unmatched_files", using("label_masks") + """, g AS (SELECT DISTINCT channel, shot_id FROM label_masks), p AS (SELECT channel, shot_id FROM g WHERE shot_id % 7 <> 3 UNION ALL SELECT channel, shot_id FROM g WHERE shot_id = 5)
SELECT g.channel, g.shot_id, count(p.shot_id) AS matches FROM g LEFT JOIN p ON p.channel = g.channel AND p.shot_id = g.shot_id GROUP BY ALL HAVING count(p.shot_id) <> 1""")
def unmatched_files(spark, sf_dir):
    """Ground truth files without exactly one prediction."""
    g = label_masks(spark, sf_dir).select("channel", "shot_id").distinct()
    p = g.where("shot_id % 7 <> 3").unionByName(g.where("shot_id = 5"))
    return setmetrics.unmatched(g, p, ["channel", "shot_id"])


@query("binary_mask_pairs", using("label_masks") + """, c AS (SELECT a.channel, a.shot_id % 4 AS sa, b.shot_id % 4 AS sb, a.shot_id // 4 AS file, count(*) FILTER (a.pred <> 0 AND b.pred <> 0) AS tp, count(*) FILTER (a.pred <> 0 AND b.pred = 0) AS fn, count(*) FILTER (a.pred = 0 AND b.pred <> 0) AS fp
  FROM label_masks a JOIN label_masks b ON a.channel = b.channel AND a.u = b.u AND a.v = b.v AND a.shot_id // 4 = b.shot_id // 4 AND a.shot_id % 4 < b.shot_id % 4 GROUP BY ALL)
SELECT sa AS a, sb AS b, round(avg(tp / nullif(tp + fp, 0)), 6) AS mean_precision, round(median(tp / nullif(tp + fp, 0)), 6) AS median_precision, round(avg(tp / nullif(tp + fn, 0)), 6) AS mean_recall FROM c GROUP BY ALL""")
def binary_mask_pairs(spark, sf_dir):
    """Precision and recall of replicates' masks against each other."""
    from canopy.operators.repeat import replicate_pairs

    m = label_masks(spark, sf_dir).select("channel", "u", "v", (F.floor(F.col("shot_id") / 4)).alias("file"), (F.col("shot_id") % 4).alias("scan"), "pred")
    pairs = replicate_pairs(m, "scan", ["channel", "u", "v", "file"])
    f = setmetrics.per_file(pairs, ["a_scan", "b_scan", "channel", "file"], "a_pred", "b_pred")
    return f.groupBy(F.col("a_scan").alias("a"), F.col("b_scan").alias("b")).agg(
        F.round(F.avg("precision"), 6).alias("mean_precision"), F.round(F.median("precision"), 6).alias("median_precision"), F.round(F.avg("recall"), 6).alias("mean_recall")
    )


_BEST = """b AS (SELECT *, row_number() OVER (PARTITION BY i, j, k ORDER BY value DESC, label) AS n FROM volumes),
c AS (SELECT i, j, k, max(label) FILTER (n = 1) AS label, max(value) FILTER (n = 1) AS value, coalesce(max(value) FILTER (n = 2), 0) AS next FROM b GROUP BY ALL)"""


@query("argmax_voxels", using("volumes") + f", {_BEST} SELECT i, j, k, label, value, next FROM c WHERE 1 > 1.05 * next AND label <> 'R'")
def argmax_voxels(spark, sf_dir):
    return volume.assigned(volumes(spark, sf_dir), min_contrast=1.05, background="R").select("i", "j", "k", "label", "value", "next")


@query("background_volume", using("volumes") + " SELECT i, j, k, round(1 - max(value), 6) AS value FROM volumes GROUP BY ALL")
def background_volume(spark, sf_dir):
    return volume.background_of(volumes(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query("voxel_prior", using("volumes") + """, p(label, r, s) AS (VALUES ('A', 0.9::DOUBLE, 0.8::DOUBLE), ('N', 0.7::DOUBLE, 0.95::DOUBLE))
SELECT v.label, i, j, k, round(((3 - value) * ln(1 - r) + value * ln(r)) - ((3 - value) * ln(s) + value * ln(1 - s)), 6) AS value FROM volumes v JOIN p ON p.label = v.label""")
def voxel_prior(spark, sf_dir):
    v = volume.with_prior(volumes(spark, sf_dir), 3, {"A": 0.9, "N": 0.7, "R": 0.5}, {"A": 0.8, "N": 0.95})
    return v.select("label", "i", "j", "k", F.round("value", 6).alias("value"))


@query("voxel_eval", using("volumes") + f""", {_BEST}, t AS (SELECT l_returnflag AS label, l_orderkey % 8 AS i, l_partkey % 8 AS j, l_suppkey % 8 AS k, round(max(l_tax) * 12, 3) AS value FROM lineitem GROUP BY ALL),
m AS (SELECT t.label, t.value, coalesce(c.label = t.label AND c.value > 1.05 * c.next, false) AS p FROM t LEFT JOIN c ON c.i = t.i AND c.j = t.j AND c.k = t.k)
SELECT label, count(*) FILTER (value > 0.5 AND p) AS tp, count(*) FILTER (value > 0.5 AND NOT p) AS fn, count(*) FILTER (value < 0.5 AND p) AS fp, count(*) FILTER (value < 0.5 AND NOT p) AS tn FROM m GROUP BY label""")
def voxel_eval(spark, sf_dir):
    from canopy.plans.bindings import table

    li = table(spark, sf_dir, "lineitem")
    truth = li.groupBy(F.col("l_returnflag").alias("label"), (F.col("l_orderkey") % 8).alias("i"), (F.col("l_partkey") % 8).alias("j"), (F.col("l_suppkey") % 8).alias("k")).agg(F.round(F.max("l_tax") * 12, 3).alias("value"))
    return volume.evaluate(volumes(spark, sf_dir), truth, contrast=1.05)


@query("voxel_pair_diff", using("volumes") + """, a AS (SELECT label, i, j, k, value * 100 AS value FROM volumes WHERE i < 5), b AS (SELECT label, i, j, k, value * 90 + 1 AS value FROM volumes WHERE i > 2),
d AS (SELECT coalesce(a.label, b.label) AS label, coalesce(a.value, 0) - coalesce(b.value, 0) AS d FROM a FULL JOIN b ON a.label = b.label AND a.i = b.i AND a.j = b.j AND a.k = b.k)
SELECT label, trunc(sum(d * d))::BIGINT AS squared, trunc(sum(abs(d)) / 512)::BIGINT AS mean_abs FROM d GROUP BY label""")
def voxel_pair_diff(spark, sf_dir):
    v = volumes(spark, sf_dir)
    a = v.where("i < 5").withColumn("value", F.col("value") * 100)
    b = v.where("i > 2").withColumn("value", F.col("value") * 90 + 1)
    return volume.pair_difference(a, b, 512)


@query("volume_gradient", using("volumes") + """, w AS (SELECT *, lag(value) OVER l AS b, lead(value) OVER l AS a FROM volumes WINDOW l AS (PARTITION BY label, j, k ORDER BY i))
SELECT label, i, j, k, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN (a - b) / 2 WHEN a IS NOT NULL THEN a - value WHEN b IS NOT NULL THEN value - b ELSE 0 END, 6) AS di FROM w""")
def volume_gradient(spark, sf_dir):
    return volume.gradient(volumes(spark, sf_dir), by=["label"]).select("label", "i", "j", "k", F.round("di", 6).alias("di"))


@query("volume_slice", using("volumes") + " SELECT label, i, j, value FROM volumes WHERE k = 3")
def volume_slice(spark, sf_dir):
    return volumes(spark, sf_dir).where("k = 3").select("label", "i", "j", "value")


@query("volume_surface")
def volume_surface(spark, sf_dir):
    """Points and normals on the surface of each class's volume."""
    return volume.volume_to_cloud(volumes(spark, sf_dir), ["label"], 0.5)


@query("geodesic_times")
def geodesic_times(spark, sf_dir):
    """Travel times from a corner through each class's volume."""
    speed = volumes(spark, sf_dir).withColumn("value", F.col("value") + 0.1)
    return volume.geodesic_times(speed, ["label"], (0, 0, 0))


@query("resized_images", "SELECT p_partkey, CASE WHEN greatest(w, h) > 1500 THEN (w * 1500) // greatest(w, h) ELSE w END::BIGINT AS width, CASE WHEN greatest(w, h) > 1500 THEN (h * 1500) // greatest(w, h) ELSE h END::BIGINT AS height FROM (SELECT p_partkey, p_size * 60 AS w, p_size * 45 AS h FROM part)")
def resized_images(spark, sf_dir):
    from canopy.plans.bindings import table

    w, h = raster.resized(F.col("p_size") * 60, F.col("p_size") * 45, 1500)
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"))
