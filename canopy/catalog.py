"""The registry of this library's queries: name, builder and, where SQL can express it, DuckDB SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Builder
    sql: str | None = None


REGISTRY: dict[str, Query] = {}
MODULES = ("clouds", "images", "replicates", "traits", "comparisons", "metadata", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
    """Register a builder under a name."""

    def add(build: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(build, sql)
        return build

    return add


def load() -> dict[str, Query]:
    """The registry, with the queries of all modules."""
    for name in MODULES:
        importlib.import_module(f"canopy.plans.{name}")
    return REGISTRY


def queries() -> dict[str, Builder]:
    load()
    return {name: q.build for name, q in REGISTRY.items()}


def oracles() -> dict[str, str]:
    load()
    return {name: q.sql for name, q in REGISTRY.items() if q.sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load()["voxel_histogram"].build(spark, sf_dir)
