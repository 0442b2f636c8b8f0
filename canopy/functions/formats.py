"""Text forms of values: sizes, pair keys, identifiers, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units of byte sizes, fixed by the format.
OCTETS = ("octets", "Ko", "Mo", "Go", "To", "Po", "Eo", "Zo", "Yo")
BYTES = ("Bytes", "KB", "MB", "GB", "TB", "PB", "EB", "ZB", "YB")


def byte_size(n: Column, units: tuple[str, ...] = OCTETS) -> Column:
    """A size with its unit, to two decimals by steps of 1024; zero is ``0`` and the base unit.

    Comparisons choose the unit: a logarithm may fall just below a whole number.
    Large numbers are written out, without an exponent below 1e15.
    """
    out = F.concat(F.lit("0"), F.lit(units[0]))
    form = lambda i: F.concat(plain_number(F.round(n / F.lit(float(1024**i)), 2)), F.lit(" "), F.lit(units[i]))
    chosen = F.when(n == 0, out)
    for i in range(len(units) - 1, 0, -1):
        chosen = chosen.when(n >= F.lit(float(1024**i)), form(i))
    return chosen.otherwise(form(0))


def plain_number(x: Column) -> Column:
    """A number of two decimals at most as text, with one decimal at least; Spark's own cast turns to exponents at 1e7."""
    long = F.regexp_replace(x.cast("decimal(20, 2)").cast("string"), "0$", "")
    return F.when((F.abs(x) >= 1e7) & (F.abs(x) < 1e15), long).otherwise(x.cast("string"))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws(" - ", a, b)


def split_pair(key: Column) -> tuple[Column, Column]:
    parts = F.split(key, " - ", 2)
    return parts[0], parts[1]


def image_id(n: Column, label: str = "rgb", width: int = 5) -> Column:
    return F.concat(F.lpad(n.cast("string"), width, "0"), F.lit(f"_{label}"))


def stem(name: Column) -> Column:
    """A file name without its last extension."""
    return F.regexp_replace(name, r"\.[^.]*$", "")


def json_value(a: Column) -> Column:
    """An array as JSON; an empty one is ``None``."""
    return F.when(F.size(a) == 0, "None").otherwise(F.to_json(a))
