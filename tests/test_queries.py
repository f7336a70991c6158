"""Every registered relational query against its SQL, on the smallest tables."""

import os

import pytest

import __spark_entry__
from wardline import driver_queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in os.listdir(D):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{D}/{t}')")
    return c


def rows(df):
    cols = sorted(df.columns)
    key = lambda v: (v is None or v != v, str(v) if isinstance(v, str) else 0.0 if v is None or v != v else float(v))
    return cols, sorted(tuple(key(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(driver_queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got, want = rows(driver_queries.queries()[name](spark, D).toPandas()), rows(duck.execute(driver_queries.oracle_sql()[name]).df())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        for x, y in zip(a, b):
            assert x == y or x[1] == pytest.approx(y[1], rel=1e-9, abs=1e-9)


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0
