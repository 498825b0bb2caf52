"""Every registered query runs on the smallest driver tables, and every query
with oracle SQL returns exactly what DuckDB returns for the same parquet."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracle import rows_of  # noqa: E402
from conftest import SF_SMALL  # noqa: E402
from kpiforge.sources.tables import TABLES  # noqa: E402

NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns[0] == "breakdown"


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    got = E.queries()[name](spark, SF_SMALL).toArrow()
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows >= 0
        return
    want = duck.sql(sql).arrow()
    if hasattr(want, "read_all"):
        want = want.read_all()
    assert sorted((f.name, str(f.type)) for f in got.schema) == sorted((f.name, str(f.type)) for f in want.schema)
    assert rows_of(got, False) == rows_of(want, False)
