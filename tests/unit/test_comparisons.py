import pytest

from canopy.plans.comparisons import report


def test_only_known_tasks(spark):
    with pytest.raises(ValueError, match="can't be compared"):
        report({}, ["PointCloud"])
    with pytest.raises(ValueError, match="no table"):
        report({"Unknown": spark.range(1)})


def test_identical_replicates(spark):
    p = spark.createDataFrame([(s * 10 + i, s, float(i), 0.0, 0.0) for s in (1, 2, 3) for i in range(4)], "pid long, scan_id int, x double, y double, z double")
    rows = report({"PointCloud": p}).collect()
    assert len(rows) == 9 and {(r.metric, r.value) for r in rows} == {("chamfer", 0.0), ("fitness", 1.0), ("rmse", 0.0)}


def test_every_scan_has_a_skeleton(spark, sf):
    from canopy.plans.bindings import points
    from canopy.plans.clouds import root_distance_skeleton

    scans = {r.scan_id for r in points(spark, sf).select("scan_id").distinct().collect()}
    assert len(scans) == 4 and {r.scan_id for r in root_distance_skeleton(spark, sf).collect()} == scans
