"""Comparing replicates task by task: which functions belong to a task, and one long table of what they give."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopy.catalog import query
from canopy.functions.formats import pair_key
from canopy.operators import repeat, setmetrics, spatial
from canopy.plans.bindings import label_masks, measures, points, using

LONG = ("pair", "metric", "value")


def _long(wide: DataFrame, a: str, b: str, metrics: Sequence[str]) -> DataFrame:
    """(pair, metric, value) rows of a table with a column for each metric."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    key = pair_key(F.col(a).cast("string"), F.col(b).cast("string")).alias("pair")
    return wide.select(key, F.explode(cells).alias("c")).select("pair", "c.metric", "c.value")


def _sides(rows: DataFrame, scan: str) -> tuple[DataFrame, DataFrame]:
    """The rows of either scan of every pair of scans, with the pair (a, b).  There are as many pairs as replicates squared."""
    scans = rows.select(scan).distinct()
    pairs = scans.select(F.col(scan).alias("a")).join(scans.select(F.col(scan).alias("b")), F.col("a") < F.col("b"))
    return rows.join(pairs, F.col(scan) == F.col("a")).drop(scan), rows.join(pairs, F.col(scan) == F.col("b")).drop(scan)


def clouds(rows: DataFrame, scan: str = "scan_id", most: float = 2.0) -> DataFrame:
    """Chamfer distance, fitness and RMSE of clouds."""
    left, right = _sides(rows, scan)
    there = spatial.mean_nearest(left, right, ["a", "b"]).join(spatial.mean_nearest(right, left, ["a", "b"]).withColumnRenamed("mean_distance", "back"), ["a", "b"])
    wide = there.select("a", "b", (F.col("mean_distance") + F.col("back")).alias("chamfer")).join(spatial.registration(left, right, most, ["a", "b"]), ["a", "b"])
    return _long(wide, "a", "b", ["chamfer", "fitness", "rmse"])


def binary_masks(pixels: DataFrame, scan: str = "scan", on: Sequence[str] = ("channel", "file", "u", "v"), value: str = "pred") -> DataFrame:
    """Mean precision and recall of masks over the files that both scans have."""
    pairs = repeat.replicate_pairs(pixels.select(*on, scan, value), scan, list(on))
    keys = [f"a_{scan}", f"b_{scan}"]
    files = setmetrics.per_file(pairs, [*keys, *[c for c in on if c not in ("u", "v")]], f"a_{value}", f"b_{value}")
    return _long(files.groupBy(*keys).agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall")), *keys, ["precision", "recall"])


def organ_counts(rows: DataFrame, scan: str = "scan_id", plant: str = "plant") -> DataFrame:
    """The difference in the number of organs between the scans of each plant."""
    n = rows.groupBy(plant, scan).agg(F.count(F.lit(1)).alias("n"))
    pairs = repeat.replicate_pairs(n, scan, [plant]).withColumn("organs", F.abs(F.col("a_n") - F.col("b_n")))
    return _long(pairs, f"a_{scan}", f"b_{scan}", ["organs"])


#: Task: what compares its results.  Names resolve here and nowhere else.
COMPARISONS: dict[str, Callable[..., DataFrame]] = {"PointCloud": clouds, "Masks": binary_masks, "AnglesAndInternodes": organ_counts}


def report(tables: Mapping[str, DataFrame], tasks: Sequence[str] | None = None) -> DataFrame:
    """(task, pair, metric, value) for every task that has a comparison and a table; an asked task without either is an error."""
    for t in tasks or ():
        if t not in COMPARISONS or t not in tables:
            raise ValueError(f"the task {t} can't be compared")
    out = None
    for name in tasks or [t for t in COMPARISONS if t in tables]:
        part = COMPARISONS[name](tables[name]).select(F.lit(name).alias("task"), *LONG)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no table can be compared")
    return out


_PAIRS = """n AS (SELECT a.scan_id AS sa, b.scan_id AS sb, a.pid, min((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d2 FROM points a, points b WHERE a.scan_id <> b.scan_id GROUP BY ALL),
m AS (SELECT sa, sb, avg(sqrt(d2)) AS d, count(*) FILTER (d2 <= 4) / count(*) AS fitness, coalesce(sqrt(avg(d2) FILTER (d2 <= 4)), 0) AS rmse FROM n GROUP BY ALL),
c AS (SELECT x.sa || ' - ' || x.sb AS pair, x.d + y.d AS chamfer, x.fitness, x.rmse FROM m x JOIN m y ON x.sa = y.sb AND x.sb = y.sa WHERE x.sa < x.sb),
k AS (SELECT a.channel, a.shot_id % 4 AS sa, b.shot_id % 4 AS sb, a.shot_id // 4 AS file, count(*) FILTER (a.pred <> 0 AND b.pred <> 0) AS tp, count(*) FILTER (a.pred <> 0 AND b.pred = 0) AS fn, count(*) FILTER (a.pred = 0 AND b.pred <> 0) AS fp
  FROM label_masks a JOIN label_masks b ON a.channel = b.channel AND a.u = b.u AND a.v = b.v AND a.shot_id // 4 = b.shot_id // 4 AND a.shot_id % 4 < b.shot_id % 4 GROUP BY ALL),
b AS (SELECT sa || ' - ' || sb AS pair, avg(tp / nullif(tp + fp, 0)) AS p, avg(tp / nullif(tp + fn, 0)) AS r FROM k GROUP BY ALL),
o AS (SELECT scan_id // 6 AS plant, scan_id, count(*) AS n FROM measures GROUP BY ALL)"""


@query("repeatability_report", using("points", "label_masks", "measures") + f""", {_PAIRS}
SELECT task, pair, metric, round(value, 6) AS value FROM (
SELECT 'PointCloud' AS task, pair, 'chamfer' AS metric, chamfer AS value FROM c UNION ALL SELECT 'PointCloud', pair, 'fitness', fitness FROM c UNION ALL SELECT 'PointCloud', pair, 'rmse', rmse FROM c
UNION ALL SELECT 'Masks', pair, 'precision', p FROM b UNION ALL SELECT 'Masks', pair, 'recall', r FROM b
UNION ALL SELECT 'AnglesAndInternodes', x.scan_id || ' - ' || y.scan_id, 'organs', abs(x.n - y.n) FROM o x JOIN o y ON x.plant = y.plant AND x.scan_id < y.scan_id)""")
def repeatability_report(spark, sf_dir):
    """All comparisons of replicates in one long table; a plant has six scans of traits at most."""
    m = label_masks(spark, sf_dir).select("channel", "u", "v", F.floor(F.col("shot_id") / 4).alias("file"), (F.col("shot_id") % 4).alias("scan"), "pred")
    tables = {"PointCloud": points(spark, sf_dir), "Masks": m, "AnglesAndInternodes": measures(spark, sf_dir).withColumn("plant", F.floor(F.col("scan_id") / 6))}
    return report(tables).withColumn("value", F.round("value", 6))
