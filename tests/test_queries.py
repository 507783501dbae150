"""Every registered query with SQL gives the same rows as DuckDB, on whole tables."""

import pytest
from compare import connect, difference

from pyspark.sql import functions as F

import __spark_entry__ as entry
from shelfcast.catalog import fixtures as fx

SF_DIR = "/root/testdata/sf0.001"
STATEMENTS = entry.oracle_sql()
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)
    own = {n for n in QUERIES if not n.startswith("op") and n != "pipeline"}
    assert all(n.startswith("gbt_") for n in own - set(STATEMENTS))


@pytest.mark.parametrize("name", sorted(n for n in STATEMENTS if not n.startswith("op")))
def test_same_as_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, SF_DIR), duck, STATEMENTS[name]) is None


def test_entry(spark):
    rows = {(r["split"], r["label"]): r for r in entry.entry(spark).collect()}
    test = rows["test", "weekday_median_4w"]
    assert (test["n_scored"], test["rmse"], test["mape"], test["wape"]) == (82, 41095.1661, 174.6941, 51.0679)


def test_daily_facts_hold_every_line(spark, duck):
    """All lines count; only Sundays, on which stores are closed, are set to 0."""
    want = duck.sql(
        """SELECT SUM(CAST(ROUND(l_extendedprice * 100) AS BIGINT)), MAX(CAST(l_shipdate AS DATE)) FROM lineitem
        WHERE isodow(l_shipdate) <> 7"""
    ).fetchall()[0]
    got = fx.derive_daily(spark, SF_DIR).where("Open = 1").agg(F.sum("Sales"), F.max("Date")).first()
    assert (got[0], got[1]) == (int(want[0]), want[1])
