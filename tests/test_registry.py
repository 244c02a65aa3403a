"""Every registered query gives rows, and the columns of its oracle, on the smallest tables; entry() works."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from leadsmith.plans import registry
from leadsmith.sources.fixtures import TABLES

#: Reports of rare events, which the smallest tables need not hold.
MAY_BE_EMPTY = {"stuck_jobs", "throttle_events", "log_query", "log_query_store", "free_provider_anti"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "_key" in df.columns


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_runs(spark, duck, name):
    df = registry.queries()[name](spark, SF_SMALL)
    rows = df.limit(5).collect()
    assert rows or name in MAY_BE_EMPTY
    if name in registry.oracle_sql():
        oracle = duck.execute(f"select * from ({registry.oracle_sql()[name]}) limit 0")
        assert sorted(df.columns) == sorted(d[0] for d in oracle.description)


def test_oracle_subset_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())
