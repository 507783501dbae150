"""Retail tables derived from the given tables, and the staged copies queries share.

Stores are nations, a store's day is the lines shipped that day to its customers, and
sales are cents. ``BySupplier`` makes stores of suppliers and their shipped lines. The published schedule (opening, promotion, holidays) follows from
store and date.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.dates import iso_weekday
from shelfcast.sources.staging import stage
from shelfcast.spec import PanelSpec

SPEC = PanelSpec(
    valid_start=dt.date(2001, 8, 1),
    test_start=dt.date(2001, 9, 18),
    serve_to=dt.date(2001, 12, 22),
    money_scale=100,
)
#: Last shipping day of the tables; the published calendar begins after it.
HISTORY_END = dt.date(2001, 11, 4)
FIRST_MONDAY = dt.date(1995, 1, 2)
#: Lines that a task handles when daily facts are summed, some 100 bytes each in memory.
ROWS_A_TASK = 250_000


@dataclass(frozen=True)
class BySupplier:
    """An input folder whose stores are the suppliers, whose number grows with the tables."""

    folder: str

    def __str__(self) -> str:
        return self.folder


_staged: dict[tuple[str, str | BySupplier, str], DataFrame] = {}


def shared(
    spark: SparkSession, sf_dir: str | BySupplier, name: str, build: Callable[[], DataFrame], staged: bool = False
) -> DataFrame:
    """``build()`` staged once per application and input folder; ``staged`` says it is already."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        _staged[key] = build() if staged else stage(build(), name)
    return _staged[key]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _promo(store: Column, date: Column) -> Column:
    week = F.floor(F.datediff(date, F.lit(FIRST_MONDAY)) / F.lit(7.0))
    on = (iso_weekday(date) <= 5) & ((week + store) % 2 == 0)
    return on.cast("int")


def _store_keys(spark: SparkSession, sf_dir: str | BySupplier) -> DataFrame:
    """(n): the keys of all stores, 0, 1, 2 .."""
    table, key = ("supplier", "s_suppkey") if isinstance(sf_dir, BySupplier) else ("nation", "n_nationkey")
    return _table(spark, sf_dir, table).select(F.col(key).cast("int").alias("n"))


def _dealt(df: DataFrame, tasks: int, *keys: str) -> DataFrame:
    """``df`` dealt by a hash of ``keys``; tables of few tasks are left to Spark's own sizes."""
    return df if tasks <= df.sparkSession.sparkContext.defaultParallelism else df.repartition(tasks, *keys)


def derive_daily(spark: SparkSession, sf_dir: str | BySupplier) -> DataFrame:
    """Daily facts. A task sorts and sums about ROWS_A_TASK lines, however many there are: tables are dealt
    in parts by the number of lines. An order finds its customer before it finds its lines, so lines move
    twice: to their order, and to their store's day, where they are summed as they arrive."""
    lines = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_suppkey").cast("int").alias("supplier"),
        F.col("l_shipdate").cast("date").alias("Date"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
    )
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    tasks = -(-lines.count() // ROWS_A_TASK)
    if isinstance(sf_dir, BySupplier):
        lines = lines.withColumnRenamed("supplier", "Store")
    else:
        lines = lines.drop("supplier")
        customers = _table(spark, sf_dir, "customer").select(
            "c_custkey", F.col("c_nationkey").cast("int").alias("Store")
        )
        orders = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).drop("c_custkey")
    rows = _dealt(lines, tasks, "l_orderkey").join(
        _dealt(orders, tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    sold = (
        _dealt(rows.select("Store", "Date", "o_custkey", "cents"), tasks, "Store", "Date")
        .groupBy("Store", "Date")
        .agg(F.sum("cents").alias("cents"), F.count_distinct("o_custkey").alias("buyers"))
    )
    date, weekday = F.col("Date"), iso_weekday(F.col("Date"))
    is_open = weekday != 7
    md = F.month(date) * 100 + F.dayofmonth(date)
    return sold.select(
        "Store",
        weekday.alias("DayOfWeek"),
        "Date",
        F.when(is_open, F.col("cents")).otherwise(F.lit(0)).cast("long").alias("Sales"),
        F.when(is_open, F.col("buyers")).otherwise(F.lit(0)).cast("long").alias("Customers"),
        is_open.cast("int").alias("Open"),
        _promo(F.col("Store"), date).alias("Promo"),
        F.when(md.isin(101, 501, 1003), "a")
        .when(md.isin(413, 416), "b")
        .when(md.isin(1225, 1226), "c")
        .otherwise("0")
        .alias("StateHoliday"),
        (md.between(701, 831) | (md >= 1223)).cast("int").alias("SchoolHoliday"),
    )


def derive_stores(spark: SparkSession, sf_dir: str | BySupplier) -> DataFrame:
    n = F.col("n")
    wide = n.cast("long")  # the square of an int key past 4,633 does not fit an int
    dated = n % 5 != 0
    member = n % 2 == 1
    return _store_keys(spark, sf_dir).select(
        n.alias("Store"),
        F.substring(F.lit("abcd"), n % 4 + 1, F.lit(1)).alias("StoreType"),
        F.substring(F.lit("abc"), n % 3 + 1, F.lit(1)).alias("Assortment"),
        F.when(n % 8 != 3, (100 * (wide * wide + 1)).cast("double")).alias("CompetitionDistance"),
        F.when(dated, n % 12 + 1).alias("CompetitionOpenSinceMonth"),
        F.when(dated, n % 9 + 1993).alias("CompetitionOpenSinceYear"),
        (n % 2).alias("Promo2"),
        F.when(member, (n * 7) % 50 + 1).alias("Promo2SinceWeek"),
        F.when(member, n % 5 + 1995).alias("Promo2SinceYear"),
        F.when(~member, F.lit(None).cast("string"))
        .when(n % 3 == 0, "Jan,Apr,Jul,Oct")
        .when(n % 3 == 1, "Feb,May,Aug,Nov")
        .otherwise("Mar,Jun,Sep,Dec")
        .alias("PromoInterval"),
    )


def derive_future(spark: SparkSession, sf_dir: str | BySupplier) -> DataFrame:
    """Published calendar of the days after the history, for three stores in four."""
    first = HISTORY_END + dt.timedelta(days=1)
    days = F.sequence(F.lit(first), F.lit(SPEC.serve_to))
    rows = (
        _store_keys(spark, sf_dir)
        .withColumnRenamed("n", "Store")
        .where(F.col("Store") % 4 != 0)
        .select("Store", F.explode(days).alias("Date"))
    )
    date, weekday = F.col("Date"), iso_weekday(F.col("Date"))
    # Stores are 0, 1, 2 ..; those divisible by four have no rows and no ids.
    earlier_stores = F.col("Store") - F.ceil(F.col("Store") / F.lit(4.0))
    place = earlier_stores * SPEC.horizon + F.datediff(date, F.lit(first)) + 1
    return rows.select(
        place.cast("long").alias("Id"),
        "Store",
        weekday.alias("DayOfWeek"),
        "Date",
        F.when((F.col("Store") == 6) & (weekday == 3), F.lit(None).cast("int"))
        .otherwise((weekday != 7).cast("int"))
        .alias("Open"),
        _promo(F.col("Store"), date).alias("Promo"),
        F.lit("0").alias("StateHoliday"),
        (F.month(date) == 8).cast("int").alias("SchoolHoliday"),
    )


def daily(spark: SparkSession, sf_dir: str | BySupplier) -> DataFrame:
    return shared(spark, sf_dir, "daily", lambda: derive_daily(spark, sf_dir))


def stores(spark: SparkSession, sf_dir: str | BySupplier) -> DataFrame:
    return derive_stores(spark, sf_dir)


def future(spark: SparkSession, sf_dir: str | BySupplier) -> DataFrame:
    return derive_future(spark, sf_dir)
