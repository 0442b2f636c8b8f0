"""Vector algebra on triples of Columns, so that it stays inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(*names: str | Column) -> Vec:
    return tuple(F.col(n) if isinstance(n, str) else n for n in names)  # type: ignore[return-value]


def of_array(a: Column) -> Vec:
    return a[0], a[1], a[2]


def minus(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def plus(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(x * s for x in a)  # type: ignore[return-value]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def det3(a: Vec, b: Vec, c: Vec) -> Column:
    return dot(a, cross(b, c))


def squared(a: Vec) -> Column:
    return dot(a, a)


def norm(a: Vec) -> Column:
    return F.sqrt(squared(a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(minus(a, b))


def oriented(reference: Vec, a: Vec) -> Vec:
    """``a``, turned round where it points away from the reference."""
    away = dot(reference, a) < 0
    return tuple(F.when(away, -x).otherwise(x) for x in a)  # type: ignore[return-value]


def matrix_apply(m: list[Vec], a: Vec) -> Vec:
    """Rows of a matrix times a vector."""
    return tuple(dot(r, a) for r in m)  # type: ignore[return-value]
