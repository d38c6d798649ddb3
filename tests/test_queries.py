"""Every registered query against its SQL on the smallest tables; the few without SQL must give rows."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as app

DATA = Path("/root/testdata/sf0.001")
# The queries of the optional part have tests of their own.
QUERIES, SQL = app._telemetry_queries(), app._telemetry_sql()

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def oracle():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) and math.isfinite(value) else str(value)


def rows(names, tuples):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(t[i]) for i in order) for t in tuples)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) - set(SQL) == {"anomalies_fused"}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, str(DATA))
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    expected = oracle.sql(SQL[name])
    assert sorted(df.columns) == sorted(expected.columns)
    assert got == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    assert app.entry(spark).count() == 5
