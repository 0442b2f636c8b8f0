"""Images as tables of pixels: rescaling, filters, thresholds and dilation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPSILON = 1e-9


def rescaled(pixels: DataFrame, by: Sequence[str], bands: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """All bands of an image between 0 and 1 by its least and greatest value.  An image of one value is 0."""
    span = pixels.groupBy(*by).agg(F.min(F.least(*bands)).alias("lo"), F.max(F.greatest(*bands)).alias("hi"))
    out = pixels.join(span, list(by))
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    return out.withColumns({b: F.coalesce((F.col(b) - F.col("lo")) / width, F.lit(0.0)) for b in bands}).drop("lo", "hi")


def linear(coefficients: Sequence[float]) -> Column:
    return F.lit(float(coefficients[0])) * F.col("r") + F.lit(float(coefficients[1])) * F.col("g") + F.lit(float(coefficients[2])) * F.col("b")


def excess_green() -> Column:
    total = F.col("r") + F.col("g") + F.col("b") + F.lit(EPSILON)
    return 2 * (F.col("g") / total) - F.col("r") / total - F.col("b") / total


def image_filter(name: str, coefficients: Sequence[float] = (0, 1, 0)) -> Column:
    if name == "linear":
        return linear(coefficients)
    if name == "excess_green":
        return excess_green()
    raise ValueError(f"no filter is named {name}")


def mask(value: Column, threshold: float) -> Column:
    return F.when(value > threshold, 255).otherwise(0)


def inverted(value: Column) -> Column:
    return F.lit(255) - value


def disk(radius: int) -> list[tuple[int, int]]:
    """Offsets within a Euclidean radius."""
    return [(a, b) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1) if a * a + b * b <= radius * radius]


CROSS = [(0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)]


def dilate(pixels: DataFrame, offsets: Sequence[tuple[int, int]], by: Sequence[str], value: str = "value") -> DataFrame:
    """The greatest value at the offsets of each pixel.  Only set pixels are spread, and only pixels that exist get a value."""
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in offsets])
    spread = pixels.where(F.col(value) != 0).withColumn("s", F.explode(steps))
    spread = spread.select(*by, (F.col("u") + F.col("s.a")).alias("u"), (F.col("v") + F.col("s.b")).alias("v"), F.col(value).alias("got"))
    got = spread.groupBy(*by, "u", "v").agg(F.max("got").alias("got"))
    return pixels.join(got, [*by, "u", "v"], "left").withColumn(value, F.coalesce("got", F.least(F.col(value), F.lit(0)))).drop("got")


def cross_dilate(pixels: DataFrame, times: int, by: Sequence[str], value: str = "value") -> DataFrame:
    """The 4-neighbour dilation, ``times`` over, as one spread over the diamond of that radius."""
    diamond = [(a, b) for a in range(-times, times + 1) for b in range(-times, times + 1) if abs(a) + abs(b) <= times]
    return dilate(pixels.withColumn(value, (F.col(value) > 0).cast("int")), diamond, by, value)


def resized(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """The sizes with the longer side at most ``most`` and the aspect kept."""
    longest = F.greatest(width, height)
    fit = lambda x: F.when(longest > most, F.floor(x * most / longest)).otherwise(x).cast("long")
    return fit(width), fit(height)
