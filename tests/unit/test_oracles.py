"""Every query that has SQL gives the rows of that SQL."""

import duckdb
import pandas as pd
import pytest

from canopy import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for k in df.columns:
        if pd.api.types.is_numeric_dtype(df[k]) and not pd.api.types.is_bool_dtype(df[k]):
            df[k] = df[k].astype("float64").round(6) + 0.0
        else:
            df[k] = df[k].map(lambda v: None if v is None or v is pd.NaT or v != v else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True).astype(str)


@pytest.mark.parametrize("name", sorted(n for n, q in catalog.load().items() if q.sql))
def test_rows_of_sql(name, spark, sf, duck):
    q = catalog.REGISTRY[name]
    found, wanted = canonical(q.build(spark, sf).toPandas()), canonical(duck.sql(q.sql).df())
    pd.testing.assert_frame_equal(found, wanted)


@pytest.mark.parametrize("name", sorted(n for n, q in catalog.load().items() if not q.sql))
def test_rows_only(name, spark, sf):
    assert catalog.REGISTRY[name].build(spark, sf).count() > 0
