"""The data model's tables, made from the driver's tables by pure expressions.

Each binding comes as a DataFrame builder and as DuckDB SQL (``SQL``), which the
queries' SQL takes in by name through ``using``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIDE = 64  # pixels of a view's mask


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled cloud for each scan: pid, scan_id, x, y, z, nx, ny, nz, label."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.lit(100.0) * e["embedding"][i].cast("double")
    return e.select(
        F.col("vec_id").alias("pid"), (F.col("vec_id") % 4).alias("scan_id"), *[at(i).alias(c) for i, c in enumerate(("x", "y", "z", "nx", "ny", "nz"))],
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("label"),
    )


def view_rows() -> list[tuple]:
    """Eight cameras on a circle of radius 300 that look at its centre: view, r00 ... r22, tx, ty, tz."""
    rows = []
    for v in range(8):
        a = 2 * math.pi * v / 8
        right, down, ahead = (-math.sin(a), math.cos(a), 0.0), (0.0, 0.0, -1.0), (-math.cos(a), -math.sin(a), 0.0)
        centre = (300 * math.cos(a), 300 * math.sin(a), 0.0)
        shift = [-sum(r * c for r, c in zip(row, centre, strict=True)) for row in (right, down, ahead)]
        rows.append((v, *(round(x, 6) + 0.0 for row in (right, down, ahead) for x in row), *(round(x, 6) + 0.0 for x in shift)))
    return rows


VIEW_COLUMNS = ["view", *[f"r{i}{j}" for i in range(3) for j in range(3)], "tx", "ty", "tz"]
FOCAL, CENTRE = 256.0, 32.0


def views(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(view_rows(), "view long, " + ", ".join(f"{c} double" for c in VIEW_COLUMNS[1:]))


def masks(spark: SparkSession) -> DataFrame:
    """mask pixels (view, u, v, value): a disk with a stripe cut out of every other view."""
    n = SIDE * SIDE
    p = spark.range(8 * n).select((F.floor(F.col("id") / n)).alias("view"), (F.col("id") % SIDE).alias("u"), (F.floor(F.col("id") / SIDE) % SIDE).alias("v"))
    disk = (F.col("u") - 32) * (F.col("u") - 32) + (F.col("v") - 32) * (F.col("v") - 32) < 144
    stripe = (F.col("view") % 2 == 1) & (F.col("u") % 8 == 0)
    return p.withColumn("value", F.when(disk & ~stripe, 255).otherwise(0))


def label_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth and prediction (shot_id, channel, u, v, gt, pred) as 0 or 1."""
    li = table(spark, sf_dir, "lineitem")
    keys = [(F.col("l_orderkey") % 20).alias("shot_id"), F.col("l_returnflag").alias("channel"), (F.col("l_partkey") % 32).alias("u"), (F.col("l_suppkey") % 32).alias("v")]
    cells = li.select(*keys, (F.col("l_quantity") > 25).cast("int").alias("g"), (F.col("l_discount") > 0.05).cast("int").alias("p"))
    return cells.groupBy("shot_id", "channel", "u", "v").agg(F.max("g").alias("gt"), F.max("p").alias("pred"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour pixels (shot_id, u, v, r, g, b) from 0 to 255."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy((F.col("l_suppkey") % 5).alias("shot_id"), (F.col("l_partkey") % 32).alias("u"), (F.col("l_orderkey") % 32).alias("v")).agg(
        F.max(F.col("l_quantity") * 5).alias("r"), F.max(F.col("l_discount") * 2000).alias("g"), F.min(F.col("l_tax") * 2500).alias("b")
    )


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class volumes (label, i, j, k, value) with values from 0 to 1."""
    li = table(spark, sf_dir, "lineitem")
    keys = [F.col("l_returnflag").alias("label"), (F.col("l_orderkey") % 8).alias("i"), (F.col("l_partkey") % 8).alias("j"), (F.col("l_suppkey") % 8).alias("k")]
    return li.groupBy(*keys).agg(F.round(F.max("l_discount") * 10, 3).alias("value"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camera positions of replicates: image_id, replicate, x, y, z."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_linenumber").alias("image_id"), (F.col("l_suppkey") % 5).alias("replicate")).agg(
        F.avg("l_quantity").alias("x"), F.avg(F.col("l_extendedprice") / 1000).alias("y"), F.avg(F.col("l_tax") * 100).alias("z")
    )


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered traits of scans: scan_id, pos, angle in degrees, internode."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("scan_id"), F.row_number().over(order).cast("long").alias("pos"), (F.col("value") * 7 % 360).alias("angle"), (F.col("value") / 10).alias("internode")
    )


def tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A binary tree for each customer: tree_id, parent, child (1 is the root), length."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    ranked = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tree_id"), F.row_number().over(order).cast("long").alias("rank"), (F.col("o_totalprice") / 10000).alias("length"))
    return ranked.select("tree_id", F.floor((F.col("rank") + 1) / 2).alias("parent"), (F.col("rank") + 1).alias("child"), "length")


_AT = ", ".join(f"100.0::DOUBLE * embedding[{i + 1}]::DOUBLE AS {c}" for i, c in enumerate(("x", "y", "z", "nx", "ny", "nz")))
_VIEWS = ", ".join("(" + ", ".join([str(r[0]), *[f"{x!r}::DOUBLE" for x in r[1:]]]) + ")" for r in view_rows())

SQL = {
    "points": f"SELECT vec_id AS pid, vec_id % 4 AS scan_id, {_AT}, 'c' || label::VARCHAR AS label FROM embeddings",
    "views": f"SELECT * FROM (VALUES {_VIEWS}) AS t({', '.join(VIEW_COLUMNS)})",
    "masks": "SELECT view, u, v, CASE WHEN (u - 32) * (u - 32) + (v - 32) * (v - 32) < 144 AND NOT (view % 2 = 1 AND u % 8 = 0) THEN 255 ELSE 0 END AS value "
             "FROM range(8) a(view), range(64) b(u), range(64) c(v)",
    "label_masks": "SELECT l_orderkey % 20 AS shot_id, l_returnflag AS channel, l_partkey % 32 AS u, l_suppkey % 32 AS v, max((l_quantity > 25)::INT) AS gt, max((l_discount > 0.05)::INT) AS pred FROM lineitem GROUP BY ALL",
    "images": "SELECT l_suppkey % 5 AS shot_id, l_partkey % 32 AS u, l_orderkey % 32 AS v, max(l_quantity * 5) AS r, max(l_discount * 2000) AS g, min(l_tax * 2500) AS b FROM lineitem GROUP BY ALL",
    "volumes": "SELECT l_returnflag AS label, l_orderkey % 8 AS i, l_partkey % 8 AS j, l_suppkey % 8 AS k, round(max(l_discount) * 10, 3) AS value FROM lineitem GROUP BY ALL",
    "poses": "SELECT l_linenumber AS image_id, l_suppkey % 5 AS replicate, avg(l_quantity) AS x, avg(l_extendedprice / 1000) AS y, avg(l_tax * 100) AS z FROM lineitem GROUP BY ALL",
    "measures": "SELECT user_id AS scan_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value * 7 % 360 AS angle, value / 10 AS internode FROM events",
    "tree_edges": "SELECT o_custkey AS tree_id, (n + 1) // 2 AS parent, n + 1 AS child, length FROM (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_totalprice / 10000 AS length FROM orders)",
}


def using(*names: str) -> str:
    """The start of a WITH clause that defines these bindings."""
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
