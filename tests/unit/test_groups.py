"""Functions of whole groups: many small groups in few batches, and trees."""

import pytest
from pyspark.sql import functions as F

from canopy.operators import graph


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_groups_are_whole_across_batches(spark, small_batches):
    rows = [(g, k, k + 1, 1.0) for g in (1, 2, 3, None) for k in range(7)] + [(9, 0, 1, 2.0)]
    edges = spark.createDataFrame(rows, "g long, src long, dst long, weight double").repartition(5)
    found = graph.per_graph(edges, ["g"], lambda rows: [(len(rows), sum(w for _, _, w in rows))], "n long, total double")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 7, 7.0), (2, 7, 7.0), (3, 7, 7.0), (None, 7, 7.0), (9, 1, 2.0)], key=str)


def test_graphs_are_solved_in_batches(spark):
    edges = spark.createDataFrame([(1, 1, 2, 1.0)], "graph long, src long, dst long, weight double")
    for solved in (graph.spanning_trees(edges, ["graph"]), graph.main_stems(edges, ["graph"], 1), graph.tree_graphs(edges, ["graph"], 1)):
        assert "FlatMapGroups" not in plan(solved) and "MapInArrow" in plan(solved)  # a call for each graph costs milliseconds


def test_root_distance_has_no_limit_of_rows(spark, sf):
    from canopy.plans.replicates import root_distance

    spark.conf.set("spark.sql.cteRecursionRowLimit", 100)
    try:
        found = root_distance(spark, sf)
        assert found.count() > 100 and found.where("id = 1 AND hops = 0 AND path = 0").count() == found.select("tree_id").distinct().count()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")


def test_root_paths(spark):
    rows = [(1, 1, 2, 1.0), (1, 1, 3, 2.0), (1, 3, 4, None), (2, 5, 6, 1.0)]
    found = graph.root_paths(spark.createDataFrame(rows, "g long, src long, dst long, weight double"), ["g"], 1)
    assert set(map(tuple, found.collect())) == {(1, 1, 0, 0.0), (1, 2, 1, 1.0), (1, 3, 1, 2.0), (1, 4, 2, None), (2, 1, 0, 0.0)}
    with pytest.raises(Exception, match="circle"):
        graph.root_paths(spark.createDataFrame([(1, 1, 2, 1.0), (1, 2, 1, 1.0)], "g long, src long, dst long, weight double"), ["g"], 1).collect()


def test_directions_of_batches_of_trees(spark):
    from canopy.operators import traits

    nodes = [(0, 0, 0, 0), (1, 0, 0, 10), (2, 0, 0, 20), (3, 0, 0, 40), (4, 10, 0, 12), (5, 0, 10, 22)]
    edges = [(0, 1), (1, 2), (2, 3), (1, 4), (2, 5)]
    n = spark.createDataFrame([(g, i, float(x), float(y), float(z)) for g in range(4) for i, x, y, z in nodes], "g long, id long, x double, y double, z double")
    e = spark.createDataFrame([(g, a, b) for g in range(4) for a, b in edges], "g long, src long, dst long")
    labelled = n.join(graph.tree_graphs(graph.weighted(n, e, ["g"]), ["g"], 0), ["g", "id"])
    found = traits.directions(labelled, e, ["g"], 20.0, 5.0)
    assert "FlatMapCoGroups" not in plan(found)
    rows = {(r.g, r.organ): (r.fx, r.fy, r.sz) for r in found.collect()}
    assert len(rows) == 8
    for g in range(4):
        assert rows[(g, 0)] == pytest.approx((10 / 104**0.5, 0, 1)) and rows[(g, 1)] == pytest.approx((0, 10 / 104**0.5, 1))
