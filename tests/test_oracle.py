"""Registered queries against their SQL on the smallest tables.  """

import duckdb
import pytest

import __spark_entry__ as entry
from oracle_check import TABLES, compare

SF = "/root/testdata/sf0.001"
NAMES = list(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    ok, msg = compare(name, spark, entry.queries(), entry.oracle_sql(), con, SF)
    assert ok, msg


def test_every_query_has_a_callable_and_sql_keys_exist():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 250


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "date", "composite", "rank"] and df.take(1)
