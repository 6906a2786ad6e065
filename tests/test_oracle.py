"""Every registered query against its DuckDB SQL on the smallest tables."""

import numbers

import duckdb
import pandas as pd
import pytest

from gridloom.plans import registry
from gridloom.plans.fixtures import BASE

DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "NULL"
    if hasattr(v, "year"):
        return str(v)[:10]
    return repr(float(v)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    made = QUERIES[name](spark, DIR).toPandas()
    if name not in SQL:
        assert len(made)
        return
    want = duck.sql(SQL[name]).df()
    assert sorted(made.columns) == sorted(want.columns)
    assert rows(made) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 30
