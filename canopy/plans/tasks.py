"""Tasks: named builders with typed parameters and upstream tasks, configured by TOML.

A task's result is a DataFrame.  ``run`` builds a task's upstream tasks first,
and takes a result from the store where it is already complete.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: (task, upstream task) of the pipeline.
EDGES = (
    ("Undistorted", "ImagesFilesetExists"), ("Masks", "Undistorted"), ("Segmentation2D", "Undistorted"), ("StructureFromMotion", "ImagesFilesetExists"), ("Voxels", "Masks"), ("VoxelsWithPrior", "Voxels"), ("PointCloud", "Voxels"),
    ("SegmentedPointCloud", "StructureFromMotion"), ("TriangleMesh", "PointCloud"), ("ClusteredMesh", "SegmentedPointCloud"), ("OrganSegmentation", "SegmentedPointCloud"), ("CurveSkeleton", "TriangleMesh"),
    ("RefineSkeleton", "CurveSkeleton"), ("TreeGraph", "CurveSkeleton"), ("AnglesAndInternodes", "TreeGraph"),
)


@dataclass
class Task:
    name: str
    build: Callable[..., DataFrame]
    upstream: tuple[str, ...] = ()
    params: dict[str, object] = field(default_factory=dict)


class Registry:
    """Tasks by name.  Builders get (spark, inputs, **params)."""

    def __init__(self) -> None:
        self.tasks: dict[str, Task] = {}

    def task(self, name: str, upstream: tuple[str, ...] = (), **params):
        def add(build):
            self.tasks[name] = Task(name, build, upstream, params)
            return build

        return add

    def order(self, name: str) -> list[str]:
        """The task after all that it needs; an error on a circle."""
        done: list[str] = []
        open_: set[str] = set()

        def visit(n: str) -> None:
            if n in done:
                return
            if n in open_:
                raise ValueError(f"the task {n} needs itself")
            open_.add(n)
            for u in self.tasks[n].upstream:
                visit(u)
            done.append(n)

        visit(name)
        return done

    def run(self, spark: SparkSession, name: str, config: Mapping[str, Mapping[str, object]] | None = None, store: str | None = None) -> DataFrame:
        """The result of a task.  With a store, results are written there and taken from there if they are complete."""
        results: dict[str, DataFrame] = {}
        for n in self.order(name):
            t = self.tasks[n]
            place = f"{store}/{n}" if store else None
            if place and is_complete(spark, place):
                results[n] = spark.read.parquet(place)
                continue
            own = {**t.params, **{k: v for k, v in (config or {}).get(n, {}).items() if k in t.params}}
            results[n] = t.build(spark, {u: results[u] for u in t.upstream}, **own)
            if place:
                results[n].write.mode("overwrite").parquet(place)
                results[n] = spark.read.parquet(place)
        return results[name]


def is_complete(spark: SparkSession, place: str) -> bool:
    """True if a write to the place has ended; asked of the store itself, so any that Spark knows will do."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place + "/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def read_config(text: str) -> dict[str, dict[str, object]]:
    """Sections of a TOML configuration.  Values that are JSON lists or objects in quotes are decoded."""
    out: dict[str, dict[str, object]] = {}
    for name, section in tomllib.loads(text).items():
        out[name] = {k: _decoded(v) for k, v in section.items()} if isinstance(section, dict) else {"value": section}
    return out


def _decoded(value: object) -> object:
    if isinstance(value, str) and value[:1] in "[{":
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def calibration_scans(config: Mapping[str, Mapping[str, object]]) -> list[str]:
    """The scans that a configuration needs for calibration."""
    return sorted({str(v) for s in config.values() for k, v in s.items() if "calibration_scan_id" in k and v})


def differing(a: Mapping[str, object], b: Mapping[str, object]) -> list[str]:
    """Keys whose values differ, or that one side lacks."""
    return sorted(k for k in {*a, *b} if a.get(k, ...) != b.get(k, ...))
