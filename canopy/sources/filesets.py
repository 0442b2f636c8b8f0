"""Scans, filesets and files: lookup by metadata and by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the artifacts of each stage.
ARTIFACTS = {
    "masks": "pixels", "voxels": "voxels", "point_cloud": "points", "mesh_vertices": "vertices", "mesh_triangles": "triangles",
    "skeleton_nodes": "nodes", "skeleton_edges": "edges", "measures": "measures",
}
#: Filesets whose name isn't their task's.
SPECIAL = {"IntrinsicCalibration": "camera_model"}


def matching(files: DataFrame, wanted: Mapping[str, object], metadata: str = "metadata", typed: Sequence[str] = ()) -> DataFrame:
    """Files whose metadata have all the wanted values.  ``typed`` keys are columns, whose tests reach the Parquet reader; the others are looked up in the JSON."""
    out = files
    for key, value in wanted.items():
        own = F.col(key) if key in typed else F.get_json_object(metadata, f"$.{key}")
        out = out.where(own == (F.lit(value) if key in typed else F.lit(str(value))))
    return out


def of_task(filesets: DataFrame, task: str, name: str = "fileset") -> DataFrame:
    """The filesets of a task: those whose name starts with the task's."""
    return filesets.where(F.col(name).startswith(SPECIAL.get(task, task)))


def one_of_task(filesets: DataFrame, task: str, name: str = "fileset"):
    """The only fileset of a task; an error if there is none or more than one."""
    found = of_task(filesets, task, name).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} fileset of the task {task}")
    return found[0]


def located(filesets: DataFrame, tasks: Sequence[str], by: Sequence[str], name: str = "fileset", order: str = "ord") -> DataFrame:
    """For each group and task the first fileset whose name starts with the task's, or ``None`` as a word."""
    starts = F.array(*[F.struct(F.lit(t).alias("task"), F.col(name).startswith(t).alias("hit")) for t in tasks])
    rows = filesets.withColumn("t", F.explode(starts)).select(*by, "t.task", F.when(F.col("t.hit"), F.col(name)).alias("found"), F.when(F.col("t.hit"), F.col(order)).alias("at"))
    return rows.groupBy(*by, "task").agg(F.coalesce(F.min_by("found", "at"), F.lit("None")).alias(name))


def first_box(sources: Mapping[str, Column], displacement: Column | None = None) -> tuple[Column, Column]:
    """The name and the value of the first source that isn't null, moved by the displacement if there is one."""
    origin = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in sources.items()])
    value = F.coalesce(*sources.values())
    return origin, value if displacement is None else value + F.coalesce(displacement, F.lit(0.0))
