"""Queries over whole tables, against their SQL in DuckDB."""

import duckdb
import pytest

from panelspark.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    own = duckdb.connect()
    for name in ("events", "orders"):
        own.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return own


def numbers_apart(found):
    """The rows in order, as their values but for floats and as their floats."""
    found = sorted(map(tuple, found), key=str)
    return [[x for x in r if not isinstance(x, float)] for r in found], [x for r in found for x in r if isinstance(x, float)]


def same_rows(got, want):
    a, x = numbers_apart(got)
    b, y = numbers_apart(want)
    return a == b and x == pytest.approx(y, rel=0, abs=2e-6)


@pytest.mark.parametrize("name", ["cumulate_between", "cumulate_first"])
def test_every_event_is_cumulated(spark, database, name):
    got = queries.QUERIES[name](spark, SF)
    want = database.sql(queries.SQL[name])
    assert got.columns == want.columns and same_rows(got.collect(), want.fetchall())
    ids = database.sql("SELECT event_id FROM events ORDER BY 1").fetchall()
    assert got.select("event_id").orderBy("event_id").collect() == ids


@pytest.mark.parametrize("name, key, table", [("expand_time_trading_days", "event_id", "events"), ("expand_months_trading_days", "event_id", "events"), ("long_to_wide", "o_custkey", "orders")])
def test_every_row_is_expanded_or_pivoted(spark, database, name, key, table):
    got = queries.QUERIES[name](spark, SF)
    want = database.sql(queries.SQL[name])
    assert got.columns == want.columns and same_rows(got.collect(), want.fetchall())
    assert got.select(key).distinct().orderBy(key).collect() == database.sql(f"SELECT DISTINCT {key} FROM {table} ORDER BY 1").fetchall()


def test_all_priorities_are_pivoted(database):
    assert [r[0] for r in database.sql("SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1").fetchall()] == list(queries.ALL_PRIORITIES)
