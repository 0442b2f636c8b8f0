"""Confusion counts of small masks and clouds, with the values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from canopy.operators import raster, setmetrics

LEFT, RIGHT, CENTRE = (1, 1, 0, 0), (0, 0, 1, 1), (0, 1, 1, 0)


def pixels(spark, truth, prediction, shot=0):
    rows = [("m", shot, u, v, float(truth[u]), float(prediction[u])) for v in range(2) for u in range(4)]
    return spark.createDataFrame(rows, "channel string, shot_id int, u int, v int, gt double, pred double")


@pytest.mark.parametrize(
    ("prediction", "counts", "ratios"),
    [(LEFT, (4, 0, 4, 0), (1, 1, 1)), (RIGHT, (0, 4, 0, 4), (0, 0, 0)), (CENTRE, (2, 2, 2, 2), (0.5, 0.5, 2 / 6)), ((0, -0.5, 0.5, 0), (2, 2, 2, 2), (0.5, 0.5, 2 / 6))],
)
def test_counts(spark, prediction, counts, ratios):
    r = setmetrics.per_file(pixels(spark, LEFT, prediction), ["channel", "shot_id"]).first()
    assert (r.tp, r.fn, r.tn, r.fp) == counts
    assert (r.precision, r.recall, r.iou) == pytest.approx(ratios)


def test_merged(spark):
    all_ = pixels(spark, LEFT, LEFT, 0).union(pixels(spark, LEFT, RIGHT, 1)).union(pixels(spark, LEFT, CENTRE, 2))
    r = setmetrics.merged(setmetrics.per_file(all_, ["channel", "shot_id"]), ["channel"]).first()
    assert (r.tp, r.fn, r.tn, r.fp) == (6, 6, 6, 6)
    assert (r.precision, r.recall, r.miou) == pytest.approx((0.5, 0.5, (1 + 0 + 2 / 6) / 3))


def test_nothing_set(spark):
    r = setmetrics.per_file(pixels(spark, (0, 0, 0, 0), (0, 0, 0, 0)), ["channel"]).first()
    assert (r.precision, r.recall, r.iou) == (None, None, None)


def test_dilated_prediction(spark):
    p = raster.cross_dilate(pixels(spark, LEFT, CENTRE), 1, ["channel", "shot_id"], "pred")
    r = setmetrics.per_file(p, ["channel"]).first()
    assert (r.tp, r.fn, r.tn, r.fp, r.precision, r.recall, r.iou) == (4, 0, 0, 4, 0.5, 1, 0.5)


def test_compared_masks(spark):
    side = lambda c, **w: pixels(spark, LEFT, CENTRE, **w).select("channel", "shot_id", "u", "v", F.col(c).alias("value"))
    keys = ["channel", "shot_id"]
    count = lambda r: (r.tp, r.fn, r.tn, r.fp)
    assert count(setmetrics.compare_masks(side("gt"), side("pred"), keys).first()) == (2, 2, 2, 2)
    assert count(setmetrics.compare_masks(side("gt"), side("pred"), keys, 1).first()) == (4, 0, 0, 4)
    for other in (side("pred").where("u < 3"), side("pred").union(side("pred", shot=1))):
        with pytest.raises(ValueError, match="different shapes"):
            setmetrics.compare_masks(side("gt"), other, keys)


def test_labelled_clouds_by_group(spark):
    cloud = lambda labels: spark.createDataFrame([(g, i, float(i), 0.0, 0.0, c) for g, row in enumerate(labels) for i, c in enumerate(row)], "g long, pid long, x double, y double, z double, label string")
    found = {(r.g, r.label): (r.tp, r.fp, r.fn, r.tn, r.miou) for r in setmetrics.labelled_iou(cloud(["1122", "12"]), cloud(["1112", "12"]), ["g"]).collect()}
    assert found == {(0, "1"): (2, 0, 1, 1, pytest.approx(2 / 3)), (0, "2"): (1, 1, 0, 2, 0.5), (1, "1"): (1, 0, 0, 1, 1), (1, "2"): (1, 0, 0, 1, 1)}


def test_missing_file(spark):
    a, b = pixels(spark, LEFT, LEFT, 0), pixels(spark, LEFT, LEFT, 1)
    keys = a.select("channel", "shot_id").distinct()
    with pytest.raises(ValueError, match="no single match"):
        setmetrics.require_matches(keys, b.select("channel", "shot_id").distinct(), ["channel", "shot_id"])
    setmetrics.require_matches(keys, keys, ["channel", "shot_id"])


@pytest.mark.parametrize(
    ("truth", "prediction", "wanted"),
    [
        ("1234", "1234", {"1": 1, "2": 1, "3": 1, "4": 1}),
        ("1234", "1134", {"1": 0.5, "2": 0, "3": 1, "4": 1}),
        ("1122", "1112", {"1": 2 / 3, "2": 1 / 2}),
    ],
)
def test_labelled_clouds(spark, truth, prediction, wanted):
    cloud = lambda labels: spark.createDataFrame([(i, float(i), 0.0, 0.0, c) for i, c in enumerate(labels)], "pid long, x double, y double, z double, label string")
    found = {r.label: r.miou for r in setmetrics.labelled_iou(cloud(truth), cloud(prediction)).collect()}
    assert found == pytest.approx(wanted)


def test_filters(spark):
    p = pixels(spark, LEFT, CENTRE).select("shot_id", "u", "v", F.col("gt").alias("r"), F.col("pred").alias("g"), F.lit(0.5).alias("b"))
    out = raster.rescaled(p, ["shot_id"]).select("u", raster.image_filter("linear", (0, 1, 0)).alias("x"), raster.image_filter("excess_green").alias("e"))
    assert {(r.u, r.x) for r in out.collect()} == {(0, 0.0), (1, 1.0), (2, 1.0), (3, 0.0)}
    with pytest.raises(ValueError, match="no filter"):
        raster.image_filter("blur")
