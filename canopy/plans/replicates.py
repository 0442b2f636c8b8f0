"""Queries on poses, replicates, ordered traits, skeletons and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.catalog import query
from canopy.functions.formats import pair_key
from canopy.operators import alignment, fits, graph, mesh, repeat, sequences
from canopy.operators.groups import busy_partitions
from canopy.plans.bindings import measures, poses, table, tree_edges, using

# --- poses

_MEDIAN = """m AS (SELECT image_id, median(x) AS mx, median(y) AS my, median(z) AS mz FROM poses GROUP BY 1),
e AS (SELECT p.image_id, p.replicate, sqrt((x-mx)*(x-mx) + (y-my)*(y-my) + (z-mz)*(z-mz)) AS error, sqrt((x-mx)*(x-mx) + (y-my)*(y-my)) AS error_xy, abs(z-mz) AS error_z FROM poses p JOIN m ON m.image_id = p.image_id)"""


def _errors(spark, sf_dir) -> DataFrame:
    p = poses(spark, sf_dir)
    m = repeat.median_pose(p, ["image_id"]).select("image_id", *[F.col("m" + a).alias(a) for a in "xyz"])
    return repeat.pose_errors(m, p, ["image_id"])


@query("pose_variability", using("poses") + f""", {_MEDIAN} SELECT image_id, replicate, round(avg(error), 6) AS mean, round(quantile_cont(error, 0.5), 6) AS median, round(stddev_pop(error), 6) AS std, count(error) AS n
FROM e GROUP BY GROUPING SETS ((), (image_id), (replicate))""")
def pose_variability(spark, sf_dir):
    """Distances to the median pose: over all, by image and by replicate."""
    s = repeat.spread(_errors(spark, sf_dir), F.col("error"), ["image_id", "replicate"])
    return s.select("image_id", "replicate", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "n")


@query("pose_vs_reference", using("poses") + """, r AS (SELECT image_id, x, y, z FROM poses WHERE replicate = 0 AND image_id <> 3),
e AS (SELECT p.image_id, p.replicate, sqrt((p.x-r.x)*(p.x-r.x) + (p.y-r.y)*(p.y-r.y) + (p.z-r.z)*(p.z-r.z)) AS error FROM poses p JOIN r ON r.image_id = p.image_id WHERE p.replicate > 0)
SELECT image_id, replicate, round(avg(error), 6) AS mean, round(quantile_cont(error, 0.5), 6) AS median, round(stddev_pop(error), 6) AS std, count(error) AS n FROM e GROUP BY GROUPING SETS ((), (image_id), (replicate))""")
def pose_vs_reference(spark, sf_dir):
    """Distances to a reference replicate, on the images that both have."""
    p = poses(spark, sf_dir)
    e = repeat.pose_errors(p.where("replicate = 0 AND image_id <> 3").drop("replicate"), p.where("replicate > 0"), ["image_id"])
    s = repeat.spread(e, F.col("error"), ["image_id", "replicate"])
    return s.select("image_id", "replicate", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")], "n")


@query("pose_report", using("poses") + f""", {_MEDIAN} SELECT replicate, round(avg(error), 6) AS mean, round(avg(error_xy), 6) AS mean_xy, round(avg(error_z), 6) AS mean_z, round(median(error), 6) AS median, count(*) FILTER (error >= 0.02) AS bad, count(*) FILTER (error < 0.02) AS good FROM e GROUP BY replicate""")
def pose_report(spark, sf_dir):
    e, limit = _errors(spark, sf_dir), 0.02
    return e.groupBy("replicate").agg(
        F.round(F.avg("error"), 6).alias("mean"), F.round(F.avg("error_xy"), 6).alias("mean_xy"), F.round(F.avg("error_z"), 6).alias("mean_z"), F.round(F.median("error"), 6).alias("median"),
        F.count_if(F.col("error") >= limit).alias("bad"), F.count_if(F.col("error") < limit).alias("good"),
    )


@query("pose_outliers", using("measures") + """, q AS (SELECT scan_id, quantile_cont(internode, 0.25) AS q1, quantile_cont(internode, 0.75) AS q3 FROM measures GROUP BY 1)
SELECT m.scan_id, pos, internode FROM measures m JOIN q ON q.scan_id = m.scan_id WHERE internode > q3 + 1.5 * (q3 - q1)""")
def pose_outliers(spark, sf_dir):
    """Upper fliers by interpolated quartiles."""
    return repeat.upper_fliers(measures(spark, sf_dir), "internode", ["scan_id"]).select("scan_id", "pos", "internode")


@query("rms_outliers", using("measures") + """, q AS (SELECT scan_id, median(internode) AS m FROM measures GROUP BY 1) SELECT x.scan_id, pos, internode FROM measures x JOIN q ON q.scan_id = x.scan_id WHERE NOT (internode > 0.5 * m AND internode < 1.5 * m)""")
def rms_outliers(spark, sf_dir):
    return repeat.far_from_median(measures(spark, sf_dir), "internode", ["scan_id"]).select("scan_id", "pos", "internode")


@query("blind_runs", using("measures") + """, f AS (SELECT *, pos - row_number() OVER (PARTITION BY scan_id ORDER BY pos) AS island FROM measures WHERE angle > 200),
r AS (SELECT scan_id, island, count(*) AS n FROM f GROUP BY ALL), l AS (SELECT scan_id, max(n) AS n FROM r GROUP BY 1), t AS (SELECT scan_id, count(*) AS n FROM measures GROUP BY 1)
SELECT t.scan_id, coalesce(l.n, 0) AS longest, round(coalesce(l.n, 0) * 360.0 / t.n, 6) AS blind_angle FROM t LEFT JOIN l ON l.scan_id = t.scan_id""")
def blind_runs(spark, sf_dir):
    b = sequences.blind_angles(measures(spark, sf_dir).withColumn("wrong", F.col("angle") > 200), ["scan_id"], "pos", "wrong")
    return b.select("scan_id", "longest", F.round("blind_angle", 6).alias("blind_angle"))


@query("intrinsics_dispersion", using("poses") + """, m AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my, avg(z) OVER w AS mz FROM poses WINDOW w AS (PARTITION BY image_id)) SELECT image_id, round(avg(abs(mx - x)), 6) AS x, round(avg(abs(my - y)), 6) AS y, round(avg(abs(mz - z)), 6) AS z FROM m GROUP BY image_id""")
def intrinsics_dispersion(spark, sf_dir):
    """Mean absolute deviation of replicates' parameters."""
    d = repeat.mean_deviation(poses(spark, sf_dir), ["image_id"], ["x", "y", "z"])
    return d.select("image_id", *[F.round(a, 6).alias(a) for a in "xyz"])


@query("pose_sources", using("poses") + """, c AS (SELECT image_id, replicate, x, y, z, replicate <> 2 OR image_id < 4 AS is_exact FROM poses), e AS (SELECT replicate, bool_and(is_exact) AS every FROM c GROUP BY 1)
SELECT image_id, c.replicate, CASE WHEN every THEN 'exact' ELSE 'approximate' END AS origin, round(CASE WHEN every THEN x ELSE x + 1 END, 6) AS x FROM c JOIN e ON e.replicate = c.replicate""")
def pose_sources(spark, sf_dir):
    """Exact poses of a scan only if all images have one, else the approximate ones."""
    c = poses(spark, sf_dir).select("image_id", "replicate", F.when((F.col("replicate") != 2) | (F.col("image_id") < 4), F.col("x")).alias("exact"), (F.col("x") + 1).alias("approximate"))
    every = c.groupBy("replicate").agg(F.every(F.col("exact").isNotNull()).alias("every"))
    j = c.join(every, "replicate")
    return j.select("image_id", "replicate", F.when(F.col("every"), "exact").otherwise("approximate").alias("origin"), F.round(F.when(F.col("every"), F.col("exact")).otherwise(F.col("approximate")), 6).alias("x"))


@query("value_repartition", using("poses") + " SELECT image_id, round(min(x), 6) AS least, round(quantile_cont(x, 0.25), 6) AS q1, round(median(x), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS most FROM poses GROUP BY 1")
def value_repartition(spark, sf_dir):
    q = F.percentile("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return poses(spark, sf_dir).groupBy("image_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), q.alias("q")).select(
        "image_id", F.round("lo", 6).alias("least"), *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "median", "q3"))], F.round("hi", 6).alias("most")
    )


@query("pair_heatmap", using("poses") + """, a AS (SELECT replicate, avg(x) AS m FROM poses GROUP BY 1), p AS (SELECT a.replicate AS x, b.replicate AS y, abs(a.m - b.m) AS d FROM a JOIN a b ON a.replicate < b.replicate)
SELECT x AS row, y AS "column", round(d, 6) AS value FROM p UNION ALL SELECT y, x, round(d, 6) FROM p UNION ALL SELECT replicate, replicate, 0 FROM a""")
def pair_heatmap(spark, sf_dir):
    means = poses(spark, sf_dir).groupBy("replicate").agg(F.avg("x").alias("m"))
    pairs = repeat.replicate_pairs(means, "replicate").select("a_replicate", "b_replicate", F.abs(F.col("a_m") - F.col("b_m")).alias("d"))
    return repeat.heatmap(pairs, "a_replicate", "b_replicate", "d").withColumn("value", F.round("value", 6))


# --- ordered traits


@query("internode_lag", using("measures") + " SELECT scan_id, pos, round(internode - lag(internode) OVER (PARTITION BY scan_id ORDER BY pos), 6) AS difference FROM measures")
def internode_lag(spark, sf_dir):
    return sequences.lag_difference(measures(spark, sf_dir), ["scan_id"], "pos", "internode").select("scan_id", "pos", F.round("difference", 6).alias("difference"))


@query("path_prefix", using("measures") + ", p AS (SELECT *, sum(internode) OVER (PARTITION BY scan_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path FROM measures) SELECT scan_id, pos, round(path, 6) AS path FROM p WHERE path <= 60")
def path_prefix(spark, sf_dir):
    return sequences.within_path(measures(spark, sf_dir), ["scan_id"], "pos", "internode", 60).select("scan_id", "pos", F.round("path", 6).alias("path"))


@query("stem_window", using("measures") + """, p AS (SELECT *, sum(internode) OVER (PARTITION BY scan_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS path FROM measures), a AS (SELECT scan_id, max(path) FILTER (pos = 10) AS mark FROM p GROUP BY 1)
SELECT p.scan_id, pos, round(path - mark, 6) AS "offset" FROM p JOIN a ON a.scan_id = p.scan_id WHERE abs(path - mark) <= 25""")
def stem_window(spark, sf_dir):
    """Stem nodes within a path around the tenth one."""
    w = sequences.around_anchor(measures(spark, sf_dir).withColumn("anchor", F.col("pos") == 10), ["scan_id"], "pos", "internode", "anchor", 25)
    return w.select("scan_id", "pos", F.round("offset", 6).alias("offset"))


@query("median_flip", using("measures") + ", m AS (SELECT *, median(angle) OVER (PARTITION BY scan_id) AS m FROM measures) SELECT scan_id, pos, round(CASE WHEN m > 180 THEN 360 - angle ELSE angle END, 6) AS angle FROM m")
def median_flip(spark, sf_dir):
    return sequences.median_flip(measures(spark, sf_dir), ["scan_id"]).select("scan_id", "pos", F.round("angle", 6).alias("angle"))


@query("angle_units", using("measures") + """, r AS (SELECT scan_id, pos, CASE WHEN scan_id % 2 = 0 THEN radians(angle) ELSE angle END AS angle FROM measures), u AS (SELECT scan_id, bool_and(angle < 2 * pi()) AS is_radians FROM r GROUP BY 1)
SELECT u.scan_id, is_radians, round(avg(CASE WHEN is_radians THEN degrees(angle) ELSE angle END), 9) AS mean_degrees FROM r JOIN u ON u.scan_id = r.scan_id GROUP BY ALL""")
def angle_units(spark, sf_dir):
    """The unit of each scan's angles, guessed, and their mean in degrees."""
    r = measures(spark, sf_dir).withColumn("angle", F.when(F.col("scan_id") % 2 == 0, F.radians("angle")).otherwise(F.col("angle")))
    a = r.groupBy("scan_id").agg(sequences.radians(F.col("angle")).alias("is_radians"), F.avg("angle").alias("rad"), F.avg(F.degrees("angle")).alias("deg"))
    return a.select("scan_id", "is_radians", F.round(F.when(F.col("is_radians"), F.col("deg")).otherwise(F.col("rad")), 9).alias("mean_degrees"))


@query("organ_counts", using("measures") + """, c AS (SELECT scan_id, scan_id % 3 AS plant, count(*) AS n FROM measures GROUP BY ALL), e AS (SELECT plant, n, count(*) AS times, min(scan_id) AS first FROM c GROUP BY ALL),
m AS (SELECT plant, max_by(n, (times, -first)) AS common, max(times) AS times FROM e GROUP BY 1) SELECT c.plant, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, any_value(common) AS common, any_value(times) AS times FROM c JOIN m ON m.plant = c.plant GROUP BY c.plant""")
def organ_counts(spark, sf_dir):
    c = measures(spark, sf_dir).groupBy("scan_id").agg(F.count(F.lit(1)).alias("n")).withColumn("plant", F.col("scan_id") % 3)
    return repeat.count_statistics(c, "n", "scan_id", ["plant"]).select("plant", "least", "most", F.round("mean", 6).alias("mean"), "common", "times")


@query("measures_check", using("measures") + """, l AS (SELECT scan_id, count(*) FILTER (angle > 30) AS angles, count(*) FILTER (internode > 1) AS internodes FROM measures GROUP BY 1)
SELECT scan_id, CASE WHEN angles = 0 OR internodes = 0 THEN 'missing' WHEN angles <> internodes THEN 'lengths differ' ELSE 'valid' END AS status FROM l""")
def measures_check(spark, sf_dir):
    """Whether both lists of a scan are there and equally long."""
    m = measures(spark, sf_dir).groupBy("scan_id").agg(F.collect_list(F.when(F.col("angle") > 30, F.col("angle"))).alias("angles"), F.collect_list(F.when(F.col("internode") > 1, F.col("internode"))).alias("internodes"))
    a, b = F.size("angles"), F.size("internodes")
    return m.select("scan_id", F.when((a == 0) | (b == 0), "missing").when(a != b, "lengths differ").otherwise("valid").alias("status"))


_ORGANS = """o AS (SELECT user_id AS scan_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
d AS (SELECT scan_id, pos, cos(value) AS fx, sin(value) AS fy, 0.2::DOUBLE AS fz, 0.1::DOUBLE AS sx, 0.05 * cos(pos) AS sy, 0.9::DOUBLE AS sz, cos(pos) AS bx, sin(pos) AS by_, pos * 3.0::DOUBLE AS bz FROM o),
w AS (SELECT *, lag(fx) OVER l AS pfx, lag(fy) OVER l AS pfy, lag(fz) OVER l AS pfz, lag(sx) OVER l AS psx, lag(sy) OVER l AS psy, lag(sz) OVER l AS psz, lag(bx) OVER l AS pbx, lag(by_) OVER l AS pby, lag(bz) OVER l AS pbz FROM d WINDOW l AS (PARTITION BY scan_id ORDER BY pos)),
n AS (SELECT *, (pfy*psz - pfz*psy)*(fy*sz - fz*sy) + (pfz*psx - pfx*psz)*(fz*sx - fx*sz) + (pfx*psy - pfy*psx)*(fx*sy - fy*sx) AS c,
 pfx*(fy*psz - fz*psy) + pfy*(fz*psx - fx*psz) + pfz*(fx*psy - fy*psx) AS det FROM w WHERE pfx IS NOT NULL)"""


@query("divergence_angles", f"WITH {_ORGANS} SELECT scan_id, pos, round(degrees(CASE WHEN det < 0 THEN 2 * pi() - acos(c) ELSE acos(c) END), 4) AS angle, round(sqrt((bx-pbx)*(bx-pbx) + (by_-pby)*(by_-pby) + (bz-pbz)*(bz-pbz)), 6) AS internode FROM n WHERE abs(c) <= 1")
def divergence_angles(spark, sf_dir):
    """Angles and internodes between successive organs."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    o = e.select(F.col("user_id").alias("scan_id"), pos.alias("pos"), "value")
    d = o.select(
        "scan_id", "pos", F.cos("value").alias("fx"), F.sin("value").alias("fy"), F.lit(0.2).alias("fz"), F.lit(0.1).alias("sx"), (F.lit(0.05) * F.cos("pos")).alias("sy"), F.lit(0.9).alias("sz"),
        F.cos("pos").alias("bx"), F.sin("pos").alias("by"), (F.col("pos") * 3.0).alias("bz"),
    )
    a = sequences.divergence(d, ["scan_id"], "pos").where(~F.isnan("angle"))
    return a.select("scan_id", "pos", F.round("angle", 4).alias("angle"), F.round("internode", 6).alias("internode"))


@query("sequence_alignment")
def sequence_alignment(spark, sf_dir):
    """Successive scans' organs aligned, with free ends."""
    m = measures(spark, sf_dir).groupBy("scan_id").agg(F.sort_array(F.collect_list(F.struct("pos", "angle", "internode"))).alias("s"))
    m = m.select("scan_id", F.transform("s", lambda x: F.struct(x["angle"].alias("angle"), x["internode"].alias("internode"))).alias("a"))
    b = m.select((F.col("scan_id") - 1).alias("scan_id"), F.col("a").alias("b"))
    return alignment.align(m.join(b, "scan_id").repartition(busy_partitions(spark), "scan_id"), ["scan_id"], free_ends=0.2)


@query("pose_circles")
def pose_circles(spark, sf_dir):
    """Circles fitted to the poses of each replicate."""
    return fits.circles(poses(spark, sf_dir), ["replicate"])


# --- skeletons


def _skeleton(spark, sf_dir) -> DataFrame:
    return tree_edges(spark, sf_dir).select(F.col("tree_id").alias("graph"), F.col("parent").alias("src"), F.col("child").alias("dst"), F.col("length").alias("weight"))


@query("node_degrees", using("tree_edges") + ", b AS (SELECT tree_id, parent AS id FROM tree_edges UNION ALL SELECT tree_id, child FROM tree_edges) SELECT tree_id AS graph, id, count(*) AS degree FROM b GROUP BY ALL")
def node_degrees(spark, sf_dir):
    return graph.degrees(_skeleton(spark, sf_dir), ["graph"])


@query("edge_lengths", """WITH n AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)
SELECT a.id AS src, b.id AS dst, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), 6) AS weight FROM n a JOIN n b ON b.id = a.id + 1""")
def edge_lengths(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    nodes = e.select(F.col("vec_id").alias("id"), *[e["embedding"][i].cast("double").alias(c) for i, c in enumerate("xyz")])
    edges = e.select(F.col("vec_id").alias("src"), (F.col("vec_id") + 1).alias("dst"))
    return graph.weighted(nodes, edges).withColumn("weight", F.round("weight", 6))


@query("root_distance", using("tree_edges").replace("WITH", "WITH RECURSIVE", 1) + """, r AS (SELECT tree_id, 1::BIGINT AS id, 0::BIGINT AS hops, 0::DOUBLE AS path FROM tree_edges GROUP BY 1
UNION ALL SELECT e.tree_id, e.child, hops + 1, path + length FROM r JOIN tree_edges e ON e.tree_id = r.tree_id AND e.parent = r.id) SELECT tree_id, id, hops, round(path, 6) AS path FROM r""")
def root_distance(spark, sf_dir):
    """Hops and path length of every node from its tree's root."""
    return graph.root_paths(_skeleton(spark, sf_dir), ["graph"], root=1).select(F.col("graph").alias("tree_id"), "id", "hops", F.round("path", 6).alias("path"))


@query("skeleton_components", using("tree_edges").replace("WITH", "WITH RECURSIVE", 1) + """, t AS (SELECT tree_id, child AS id FROM tree_edges WHERE length > 25 UNION ALL SELECT DISTINCT tree_id, 1 FROM tree_edges),
r AS (SELECT tree_id, id::BIGINT AS id, id::BIGINT AS component FROM t UNION ALL SELECT e.tree_id, e.child, r.component FROM r JOIN tree_edges e ON e.tree_id = r.tree_id AND e.parent = r.id WHERE e.length <= 25) SELECT tree_id, id, component FROM r""")
def skeleton_components(spark, sf_dir):
    """Components of every skeleton without its long edges.  A child's id is above its parent's, so SQL can follow each component from its top."""
    from canopy.operators.iterate import components

    e = tree_edges(spark, sf_dir).withColumnsRenamed({"parent": "src", "child": "dst"})
    nodes = e.select("tree_id", F.col("src").alias("id")).union(e.select("tree_id", "dst"))
    return components(nodes, e.where("length <= 25"), ["tree_id"])


@query("spanning_trees")
def spanning_trees(spark, sf_dir):
    return graph.spanning_trees(_skeleton(spark, sf_dir), ["graph"])


@query("main_stems")
def main_stems(spark, sf_dir):
    return graph.main_stems(_skeleton(spark, sf_dir), ["graph"], root=1)


@query("tree_graphs")
def tree_graphs(spark, sf_dir):
    return graph.tree_graphs(_skeleton(spark, sf_dir), ["graph"], root=1)


@query("fruit_node_counts")
def fruit_node_counts(spark, sf_dir):
    """Nodes of each fruit, from the labelled trees."""
    t = graph.tree_graphs(_skeleton(spark, sf_dir), ["graph"], root=1)
    return t.where(F.array_contains(F.split("labels", ","), "fruit")).groupBy("graph", "fruit_id").agg(F.count(F.lit(1)).alias("n"))


# --- meshes

_CUBE = "(VALUES (0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 1.0, 1.0, 0.0), (3, 0.0, 1.0, 0.0), (4, 0.0, 0.0, 1.0), (5, 1.0, 0.0, 1.0), (6, 1.0, 1.0, 1.0), (7, 0.0, 1.0, 1.0)) AS t(vid, x, y, z)"
_FACES = "(VALUES (0, 0, 2, 1), (1, 0, 3, 2), (2, 4, 5, 6), (3, 4, 6, 7), (4, 0, 1, 5), (5, 0, 5, 4), (6, 1, 2, 6), (7, 1, 6, 5), (8, 2, 3, 7), (9, 2, 7, 6), (10, 3, 0, 4), (11, 3, 4, 7)) AS t(tid, a, b, c)"


def _cubes(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """A cube for each part, as wide as its size; those of odd parts lack a triangle."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("mesh_id"), "p_size")
    cube, faces = spark.sql(f"SELECT * FROM {_CUBE}"), spark.sql(f"SELECT * FROM {_FACES}")
    v = p.join(F.broadcast(cube)).select("mesh_id", "vid", *[(F.col(a).cast("double") * F.col("p_size")).alias(a) for a in "xyz"])
    t = p.join(F.broadcast(faces)).where("mesh_id % 2 = 0 OR tid < 11").select("mesh_id", "tid", "a", "b", "c")
    return t, v


@query("mesh_area_volume", "SELECT p_partkey AS mesh_id, round(p_size * p_size * CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 5.5 END, 6)::DOUBLE AS area, p_partkey % 2 = 0 AS watertight, CASE WHEN p_partkey % 2 = 0 THEN p_size ^ 3 ELSE 0 END::DOUBLE AS volume FROM part")
def mesh_area_volume(spark, sf_dir):
    t, v = _cubes(spark, sf_dir)
    return mesh.shape(t, v).select("mesh_id", F.round("area", 6).alias("area"), "watertight", F.round("volume", 6).alias("volume"))


@query("mesh_ratios", """WITH m AS (SELECT p_partkey AS id, p_size * p_size * CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 5.5 END AS area, CASE WHEN p_partkey % 2 = 0 THEN p_size ^ 3 ELSE 0 END AS volume FROM part)
SELECT a.id AS mesh_a, b.id AS mesh_b, round(least(a.area, b.area) / greatest(a.area, b.area), 6)::DOUBLE AS area_ratio, round(coalesce(least(a.volume, b.volume) / nullif(greatest(a.volume, b.volume), 0), 0), 6)::DOUBLE AS volume_ratio FROM m a JOIN m b ON a.id // 8 = b.id // 8 AND a.id < b.id""")
def mesh_ratios(spark, sf_dir):
    """Area and volume ratios between the replicates of one object; an object has eight at most."""
    s = mesh.shape(*_cubes(spark, sf_dir)).withColumn("object", F.floor(F.col("mesh_id") / 8))
    return mesh.shape_ratios(s, ["object"]).select("mesh_a", "mesh_b", F.round("area_ratio", 6).alias("area_ratio"), F.round("volume_ratio", 6).alias("volume_ratio"))


@query("mesh_clusters", "SELECT p_partkey AS mesh_id, 0 AS cluster, CASE WHEN p_partkey % 2 = 0 THEN 12 ELSE 11 END::BIGINT AS n, round(p_size * p_size * CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 5.5 END, 6)::DOUBLE AS area FROM part")
def mesh_clusters(spark, sf_dir):
    t, v = _cubes(spark, sf_dir)
    return mesh.cluster_stats(t, v).withColumn("area", F.round("area", 6))


@query("chamfer_keys", using("poses") + ", a AS (SELECT DISTINCT replicate FROM poses) SELECT x.replicate || ' - ' || y.replicate AS key, x.replicate::VARCHAR AS a, y.replicate::VARCHAR AS b FROM a x JOIN a y ON x.replicate < y.replicate")
def chamfer_keys(spark, sf_dir):
    """Keys of pairs, written and read back."""
    from canopy.functions.formats import split_pair

    r = poses(spark, sf_dir).select("replicate").distinct()
    keys = repeat.replicate_pairs(r, "replicate").select(pair_key(F.col("a_replicate").cast("string"), F.col("b_replicate").cast("string")).alias("key"))
    a, b = split_pair(F.col("key"))
    return keys.select("key", a.alias("a"), b.alias("b"))
