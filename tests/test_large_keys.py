"""Suppliers past the keys whose square fits an int: 4,634 and more."""

import datetime as dt
import math

import duckdb
import pytest
from compare import difference

import __spark_entry__ as entry
from shelfcast.catalog import fixtures as fx

KEYS = (5, 6, 4_633, 4_634, 4_635, 46_341, 70_001)
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Some weeks before and in the test window; each supplier ships on most days, some orders twice a day."""
    folder = tmp_path_factory.mktemp("large-keys")
    first = dt.datetime(2001, 6, 1)
    lines = [
        (1 + (place * 31 + day) % 90, key, first + dt.timedelta(days=day), 10.25 + place * day % 700)
        for place, key in enumerate(KEYS)
        for day in range(157)
        if (day + place) % 9
    ]
    tables = {
        "supplier": ([(key,) for key in KEYS], "s_suppkey long"),
        "orders": ([(order, order * 7 % 40) for order in range(1, 91)], "o_orderkey long, o_custkey long"),
        "lineitem": (lines, "l_orderkey long, l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/parts/{name}")
        (part,) = (folder / "parts" / name).glob("*.parquet")
        part.replace(folder / f"{name}.parquet")
    return str(folder)


def test_a_distance_is_no_int(spark, folder):
    rows = fx.stores(spark, fx.BySupplier(folder)).collect()
    got = {r["Store"]: r["CompetitionDistance"] for r in rows}
    assert got == {n: None if n % 8 == 3 else 100.0 * (n * n + 1) for n in KEYS}


def test_distance_of_each_day(spark, folder):
    rows = QUERIES["supplier_features_competition"](spark, folder).distinct().collect()
    got = {r["Store"]: r["competition_distance_log"] for r in rows}
    far = 2 * max(100.0 * (n * n + 1) for n in KEYS if n % 8 != 3)
    want = {n: math.log1p(far if n % 8 == 3 else 100.0 * (n * n + 1)) for n in KEYS}
    assert got == {n: pytest.approx(v, abs=1e-6) for n, v in want.items()}


@pytest.mark.parametrize(
    "name", ["features_competition", "missing_rates", "range_forecast", "request_status", "serving_table"]
)
def test_same_as_sql(spark, folder, name):
    tables = duckdb.connect()
    for table in ("supplier", "orders", "lineitem"):
        tables.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    statement = entry.oracle_sql()[f"supplier_{name}"]
    got = QUERIES[f"supplier_{name}"](spark, folder)
    assert got.count() > 0
    assert difference(got, tables, statement) is None
