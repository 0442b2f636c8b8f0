"""Results that must equal DuckDB's to the last bit or letter."""

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from canopy.functions import formats
from canopy.operators import repeat
from canopy.plans import metadata


def test_fliers_at_the_threshold(spark):
    rows = [(1, v) for v in (3.5, 14.6, 22.4, 28.8, 29.4, 48.3)]  # the threshold is 48.29999999999999 if products aren't rounded
    assert [r.v for r in repeat.upper_fliers(spark.createDataFrame(rows, "g long, v double"), "v", ["g"]).collect()] == [48.3]


def test_quantiles_against_duckdb(spark):
    rng = np.random.default_rng(3)
    df = pd.DataFrame({"g": rng.integers(0, 3000, 20000), "v": np.round(rng.exponential(50, 20000), 2) / 10})
    df.loc[::97, "v"] = None
    wanted = duckdb.sql("SELECT g, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM df GROUP BY g").df()
    made = spark.createDataFrame([(int(g), None if v != v else float(v)) for g, v in df.itertuples(index=False)], "g long, v double")
    found = repeat.quantiles(made, "v", ["g"], {"q1": 0.25, "q3": 0.75}).select("g", "q1", "q3").distinct().toPandas()
    both = found.merge(wanted, on="g", suffixes=("", "_sql"))
    assert len(both) == len(wanted) and (both["q1"] == both["q1_sql"]).all() and (both["q3"] == both["q3_sql"]).all()


def test_large_sizes(spark, tmp_path):
    keys = [1, 2, 3, 7, 999, 1001, 5999, 20011, 99999, 200003, 359999]
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(str(tmp_path / "supplier.parquet"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    from canopy import catalog

    wanted = {tuple(r) for r in c.sql(catalog.load()["byte_sizes"].sql).df().itertuples(index=False, name=None)}
    assert {tuple(r) for r in metadata.byte_sizes(spark, str(tmp_path)).collect()} == wanted
    d = spark.createDataFrame([(3 * 1024**4,)], "n long")
    assert d.select(formats.byte_size(F.col("n")).alias("s")).first().s == "3.0 To"
