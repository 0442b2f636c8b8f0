"""PLY files: ``spark.read.format("ply")``, and a writer of point clouds.

The reader gives a row for each element of one kind (option ``element``:
``vertex`` or ``face``); a face's list is the array ``idx``.  ASCII and binary
little-endian files are read.  Files come through Spark's own binary reader, so
any store that Spark reads will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from canopy.session import ship_code

CODES = {"char": "b", "int8": "b", "uchar": "B", "uint8": "B", "short": "h", "int16": "h", "ushort": "H", "uint16": "H", "int": "i", "int32": "i", "uint": "I", "uint32": "I", "float": "f", "float32": "f", "double": "d", "float64": "d"}

VERTEX = "path string, vid long, x double, y double, z double, nx double, ny double, nz double"
FACE = "path string, fid long, idx array<long>"


def parse(data: bytes) -> dict[str, list[dict]]:
    """The elements of a file by kind."""
    head, _, body = data.partition(b"end_header\n")
    kinds: list[tuple[str, int, list[tuple]]] = []
    form = "ascii"
    for line in head.decode("ascii").splitlines():
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            kinds.append((w[1], int(w[2]), []))
        elif w[:1] == ["property"]:
            kinds[-1][2].append((w[-1], CODES[w[2]], CODES[w[3]]) if w[1] == "list" else (w[-1], None, CODES[w[1]]))
    if form not in ("ascii", "binary_little_endian"):
        raise ValueError(f"PLY files of the format {form} aren't read")
    out: dict[str, list[dict]] = {}
    words, at = iter(body.split()), 0

    def number(code: str):
        nonlocal at
        if form == "ascii":
            w = next(words)
            return float(w) if code in "fd" else int(w)
        (v,) = struct.unpack_from("<" + code, body, at)
        at += struct.calcsize(code)
        return v

    for name, n, props in kinds:
        rows = out[name] = []
        for _ in range(n):
            rows.append({p: [number(code) for _ in range(number(count))] if count else number(code) for p, count, code in props})
    return out


def read(spark: SparkSession, path: str, element: str = "vertex") -> DataFrame:
    """The vertices or faces of all PLY files under a path."""
    ship_code(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for where, content in zip(b["path"], b["content"], strict=True):
                rows = parse(bytes(content)).get(element, [])
                if element == "face":
                    yield pd.DataFrame({"path": where, "fid": range(len(rows)), "idx": [next(v for v in r.values() if isinstance(v, list)) for r in rows]})
                else:
                    yield pd.DataFrame({"path": where, "vid": range(len(rows)), **{c: [float(r[c]) if c in r else None for r in rows] for c in ("x", "y", "z", "nx", "ny", "nz")}})

    return files.mapInPandas(run, FACE if element == "face" else VERTEX)


def write_cloud(points: DataFrame, path: str) -> None:
    """Write a cloud as ASCII PLY parts, one file for each partition's rows, through Spark's text sink."""
    ship_code(points.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            head = f"ply\nformat ascii 1.0\nelement vertex {len(b)}\nproperty double x\nproperty double y\nproperty double z\nend_header\n"
            yield pd.DataFrame({"value": [head + "\n".join(f"{x!r} {y!r} {z!r}" for x, y, z in zip(b["x"].tolist(), b["y"].tolist(), b["z"].tolist(), strict=True))]})

    points.select("x", "y", "z").mapInPandas(run, "value string").write.option("maxRecordsPerFile", 1).text(path)
