"""Date-complete panels, split labels and row filters."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.dates import iso_weekday
from shelfcast.spec import PanelSpec


def store_days(
    facts: DataFrame, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """Every store on every day between the first and last date of the whole table.

    ``first`` and ``last`` narrow the days. Each store row generates its own calendar,
    so nothing is paired with anything. The stores are few bytes that become many rows,
    so they are spread over all cores first.
    """
    bounds = facts.agg(F.min("Date").alias("first"), F.max("Date").alias("last"))
    low, high = bounds.select("first").scalar(), bounds.select("last").scalar()
    if first is not None:
        low = F.greatest(low, F.lit(first))
    if last is not None:
        high = F.least(high, F.lit(last))
    stores = facts.select("Store").distinct()
    # A number keeps the few small stores from being coalesced into one task; by a hash of
    # its own, as by the store alone it would be merged into the distinct's exchange.
    tasks = int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = stores.repartition(tasks, F.xxhash64("Store"))
    return spread.select("Store", F.explode(F.sequence(low, high)).alias("Date"))


def between(df: DataFrame, first: dt.date | None, last: dt.date | None) -> DataFrame:
    """Rows of ``first``..``last``, by bounds on the plain column, which reach the scan."""
    if first is not None:
        df = df.where(F.col("Date") >= F.lit(first))
    return df if last is None else df.where(F.col("Date") <= F.lit(last))


def complete_panel(
    facts: DataFrame, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """One row per store and day; ``is_gap`` marks days without recorded sales.

    Promotion and opening stay NULL on gap days, holiday flags get their usual value.
    """
    rows = between(facts.drop("DayOfWeek"), first, last)
    panel = store_days(facts, first, last).join(rows, ["Store", "Date"], "left")
    return fill_calendar(panel.withColumn("is_gap", F.isnull("Sales")))


def complete_extended_panel(
    history: DataFrame, first: dt.date | None = None, last: dt.date | None = None
) -> DataFrame:
    """Panel over history and future days; ``is_gap`` means the day was in neither.

    Future days have a row and no sales, so absence is told by the row itself. Gap
    days count as closed and without promotion.
    """
    rows = between(history.drop("DayOfWeek"), first, last).withColumn("_present", F.lit(True))
    panel = store_days(history, first, last).join(rows, ["Store", "Date"], "left")
    panel = panel.withColumn("is_gap", F.isnull("_present")).drop("_present")
    return fill_calendar(panel, schedule=True)


def fill_calendar(panel: DataFrame, schedule: bool = False) -> DataFrame:
    """Fill what the calendar decides; ``schedule`` also fills opening and promotion."""
    filled = panel.fillna({"StateHoliday": "0", "SchoolHoliday": 0})
    if schedule:
        filled = filled.fillna({"Open": 0, "Promo": 0})
    return filled.withColumn("DayOfWeek", iso_weekday(F.col("Date")))


def with_stores(df: DataFrame, stores: DataFrame) -> DataFrame:
    """Left join of the store table; Catalyst broadcasts it while its size allows."""
    return df.join(stores, "Store", "left")


def split_label(date: Column, spec: PanelSpec) -> Column:
    return (
        F.when(date >= F.lit(spec.test_start), "test")
        .when(date >= F.lit(spec.valid_start), "valid")
        .otherwise("train")
    )


def add_split(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return df.withColumn("split", split_label(F.col("Date"), spec))


def split_days(split: str, spec: PanelSpec) -> tuple[dt.date | None, dt.date | None]:
    """First and last day of a split; the outer ends are open."""
    day = dt.timedelta(days=1)
    return {
        "train": (None, spec.valid_start - day),
        "valid": (spec.valid_start, spec.test_start - day),
        "test": (spec.test_start, None),
    }[split]


def modelling_rows(panel: DataFrame) -> DataFrame:
    """Observed rows without the customer count, which nobody knows in advance."""
    return panel.where(~F.col("is_gap")).drop("Customers")


def in_split(df: DataFrame, *splits: str) -> DataFrame:
    return df.where(F.col("split").isin(*splits))


def trading_days(df: DataFrame) -> DataFrame:
    return df.where(F.col("Open") == 1)


def before(df: DataFrame, cutoff: dt.date) -> DataFrame:
    return df.where(F.col("Date") < F.lit(cutoff))


def trailing(df: DataFrame, cutoff: dt.date, days: int) -> DataFrame:
    """The ``days`` days that end the day before ``cutoff``."""
    start = cutoff - dt.timedelta(days=days)
    return df.where((F.col("Date") >= F.lit(start)) & (F.col("Date") < F.lit(cutoff)))


def readable_days(first: dt.date, last: dt.date, spec: PanelSpec) -> tuple[dt.date, dt.date]:
    """The days that features of ``first``..``last`` can read."""
    return first - dt.timedelta(days=spec.look_back), last + dt.timedelta(days=spec.look_ahead)


def bounded_history(df: DataFrame, first: dt.date, last: dt.date, spec: PanelSpec) -> DataFrame:
    """Only the rows that features of the days ``first``..``last`` can read.

    A date filter does not move below a window, so it is put there: it reaches the scan.
    """
    return between(df, *readable_days(first, last, spec))


def panel_summary(panel: DataFrame) -> DataFrame:
    """Rows, gaps and observations per split, with trading days and date range."""
    seen = ~F.col("is_gap")
    return panel.groupBy("split").agg(
        F.count(F.lit(1)).alias("panel_rows"),
        F.count_if("is_gap").alias("gap_rows"),
        F.count_if(seen).alias("rows"),
        F.sum(F.when(seen, F.col("Open"))).alias("open_rows"),
        F.min(F.when(seen, F.col("Date"))).alias("first"),
        F.max(F.when(seen, F.col("Date"))).alias("last"),
    )


def proposed_split(facts: DataFrame, days: int = 48) -> DataFrame:
    """Three windows counted back from the last date, with rows and trading days in each."""
    end = facts.agg(F.max("Date").alias("end")).scalar()
    test_start = F.date_sub(end, days - 1)
    valid_start = F.date_sub(end, 2 * days - 1)
    label = (
        F.when(F.col("Date") >= test_start, "test")
        .when(F.col("Date") >= valid_start, "valid")
        .otherwise("train")
    )
    first = F.min("Date")
    return (
        facts.groupBy(label.alias("split"))
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count_if(F.col("Open") == 1).alias("open_rows"),
            first.alias("_first"),
        )
        .select(
            "split",
            F.when(F.col("split") == "test", test_start)
            .when(F.col("split") == "valid", valid_start)
            .otherwise(F.col("_first"))
            .alias("first"),
            F.when(F.col("split") == "test", end)
            .when(F.col("split") == "valid", F.date_sub(test_start, 1))
            .otherwise(F.date_sub(valid_start, 1))
            .alias("last"),
            "rows",
            "open_rows",
        )
    )
