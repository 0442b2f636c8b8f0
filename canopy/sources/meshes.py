"""OBJ files: vertices and triangles with the material that is in use, and skeletons as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of each OBJ file: path, vid (from 1), x, y, z; and path, line, material, a, b, c.

    A file is read whole, so that its lines keep their order.  Polygons are cut into fans.
    """
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.obj").text(path).withColumn("path", F.col("_metadata.file_path"))
    lines = files.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line", "text")).withColumn("w", F.split(F.trim("text"), r"\s+"))
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    v = lines.where("w[0] = 'v'").withColumn("vid", F.row_number().over(Window.partitionBy("path").orderBy("line")).cast("long"))
    vertices = v.select("path", "vid", *[F.col("w")[i + 1].cast("double").alias(a) for i, a in enumerate("xyz")])
    f = lines.withColumn("material", F.last(F.when(F.col("w")[0] == "usemtl", F.col("w")[1]), True).over(order)).where("w[0] = 'f'")
    corner = lambda x: F.substring_index(x, "/", 1).cast("long")
    f = f.withColumn("p", F.transform(F.slice("w", 2, F.size("w") - 1), corner)).withColumn("n", F.explode(F.sequence(F.lit(1), F.size("p") - 2)))
    triangles = f.select("path", "line", "material", F.col("p")[0].alias("a"), F.col("p")[F.col("n")].alias("b"), F.col("p")[F.col("n") + 1].alias("c"))
    return vertices, triangles


def swapped_axes(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """From a frame with y up to one with z up."""
    return x, -z, y


SKELETON = "points array<array<double>>, lines array<array<long>>"


def read_skeletons(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of skeletons stored as JSON with points and lines."""
    s = spark.read.schema(SKELETON).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("graph"), "points", "lines")
    nodes = s.select("graph", F.posexplode("points").alias("id", "p")).select("graph", F.col("id").cast("long").alias("id"), *[F.col("p")[i].alias(a) for i, a in enumerate("xyz")])
    edges = s.select("graph", F.explode("lines").alias("l")).select("graph", F.col("l")[0].alias("src"), F.col("l")[1].alias("dst"))
    return nodes, edges


MEASURES = "angles array<double>, internodes array<double>"


def read_measures(spark: SparkSession, path: str) -> DataFrame:
    """(scan, pos, angle, internode) of measures stored as JSON with two lists of equal length."""
    m = spark.read.schema(MEASURES).option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("scan"), F.arrays_zip("angles", "internodes").alias("z"))
    return m.select("scan", F.posexplode("z").alias("pos", "m")).select("scan", F.col("pos").cast("long").alias("pos"), F.col("m.angles").alias("angle"), F.col("m.internodes").alias("internode"))
