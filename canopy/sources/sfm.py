"""Binary models of structure-from-motion: ``cameras.bin``, ``images.bin`` and ``points3D.bin``.

The layouts are the public ones of the format: little-endian counts, then
records.  Parsing is one function for each file, applied to Spark's binary reader.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopy.session import ship_code

#: Model number: name and count of parameters, fixed by the format.
MODELS = {0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8), 6: ("FULL_OPENCV", 12)}

CAMERAS = "path string, camera_id long, model string, width long, height long, params array<double>"
IMAGES = "path string, image_id long, qvec array<double>, rotmat array<array<double>>, tvec array<double>, camera_id long, name string, xys array<array<double>>, point3d_ids array<long>"
POINTS = "path string, point_id long, x double, y double, z double, r int, g int, b int, error double, image_ids array<long>, point2d_idxs array<long>"


class Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str) -> tuple:
        values = struct.unpack_from("<" + form, self.data, self.at)
        self.at += struct.calcsize("<" + form)
        return values

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out


def rotation(q) -> list[list[float]]:
    """The rotation matrix of a unit quaternion (w, x, y, z)."""
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def parse_cameras(data: bytes) -> list[dict]:
    c = Cursor(data)
    rows = []
    for _ in range(c.take("Q")[0]):
        camera, model, width, height = c.take("iiQQ")
        name, n = MODELS[model]
        rows.append({"camera_id": camera, "model": name, "width": width, "height": height, "params": list(c.take(f"{n}d"))})
    return rows


def parse_images(data: bytes) -> list[dict]:
    c = Cursor(data)
    rows = []
    for _ in range(c.take("Q")[0]):
        (image,), q, t, (camera,), name = c.take("i"), c.take("4d"), c.take("3d"), c.take("i"), c.text()
        n = c.take("Q")[0]
        flat = [c.take("ddq") for _ in range(n)]
        rows.append({"image_id": image, "qvec": list(q), "rotmat": rotation(q), "tvec": list(t), "camera_id": camera, "name": name, "xys": [list(p[:2]) for p in flat], "point3d_ids": [p[2] for p in flat]})
    return rows


def parse_points(data: bytes) -> list[dict]:
    c = Cursor(data)
    rows = []
    for _ in range(c.take("Q")[0]):
        point, x, y, z, r, g, b, error, n = c.take("QdddBBBdQ")
        track = np.array(c.take(f"{2 * n}i"), dtype=np.int64).reshape(-1, 2)
        rows.append({"point_id": point, "x": x, "y": y, "z": z, "r": r, "g": g, "b": b, "error": error, "image_ids": track[:, 0].tolist(), "point2d_idxs": track[:, 1].tolist()})
    return rows


def _read(spark: SparkSession, path: str, glob: str, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    ship_code(spark)
    columns = [c.split()[0] for c in schema.split(", ")][1:]
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"], strict=True):
                out = pd.DataFrame(parse(bytes(content)), columns=columns)
                out.insert(0, "path", where)
                yield out

    return files.mapInPandas(run, schema)


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "cameras.bin", parse_cameras, CAMERAS)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "images.bin", parse_images, IMAGES)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "points3D.bin", parse_points, POINTS)


def colours(r: str = "r", g: str = "g", b: str = "b") -> list[Column]:
    """Colours from 0 to 1."""
    return [(F.col(c) / 255).alias(c) for c in (r, g, b)]
