"""NPY and NPZ volumes as sparse tables of voxels, and labelled volumes as such files."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from canopy.session import ship_code

VOXELS = "path string, label string, i long, j long, k long, value double"


def volumes(data: bytes) -> dict[str, np.ndarray]:
    """The volumes of an NPY or NPZ file by label; a single one has no label."""
    loaded = np.load(io.BytesIO(data), allow_pickle=False)
    if isinstance(loaded, np.ndarray):
        return {"": loaded}
    names = list(loaded.files)
    return {"" if len(names) == 1 else n: loaded[n] for n in names}


def read(spark: SparkSession, path: str, glob: str = "*.np[yz]", zeros: bool = False) -> DataFrame:
    """The voxels of all NPY and NPZ files under a path; zeros only if asked for.  The label is null for an unlabelled volume."""
    ship_code(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, content in zip(b["path"], b["content"], strict=True):
                for label, v in volumes(bytes(content)).items():
                    at = np.argwhere(np.ones_like(v, dtype=bool) if zeros else v != 0)
                    for part in range(0, len(at), 1 << 18):
                        c = at[part : part + (1 << 18)]
                        yield pd.DataFrame({"path": where, "label": label or None, "i": c[:, 0], "j": c[:, 1], "k": c[:, 2], "value": v[tuple(c.T)].astype(float)})

    return files.mapInPandas(run, VOXELS)


def dense(voxels: pd.DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """A volume from a few voxels at hand."""
    out = np.zeros(shape)
    out[voxels["i"].to_numpy(), voxels["j"].to_numpy(), voxels["k"].to_numpy()] = voxels["value"].to_numpy()
    return out
