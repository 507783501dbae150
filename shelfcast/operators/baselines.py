"""Baseline forecasts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.panel import before, trading_days, trailing


def same_day_last_week(target: DataFrame, history: DataFrame, name: str = "pred") -> DataFrame:
    """Sales of exactly seven days earlier.

    Not a valid long-horizon forecast: late days read sales from inside the horizon.
    It is kept to show what that is worth, and as what the leakage check must catch.
    """
    shifted = history.select("Store", F.date_add("Date", 7).alias("Date"), F.col("Sales").alias(name))
    return target.join(shifted, ["Store", "Date"], "left")


def last_week_repeated(
    target: DataFrame, history: DataFrame, cutoff: dt.date, name: str = "pred"
) -> DataFrame:
    """The last week before the cutoff, closed days included, tiled over the horizon."""
    week = (
        trailing(history, cutoff, 7)
        .groupBy("Store", "DayOfWeek")
        .agg((F.sum("Sales") / F.count("Sales")).alias(name))
    )
    return target.join(week, ["Store", "DayOfWeek"], "left")


def weekday_medians(history: DataFrame, cutoff: dt.date, weeks: int = 4) -> DataFrame:
    """Median trading-day sales per store and weekday over the last ``weeks`` weeks."""
    return (
        trading_days(trailing(history, cutoff, 7 * weeks))
        .groupBy("Store", "DayOfWeek")
        .agg(F.percentile("Sales", F.lit(0.5)).alias("weekday_median"))
    )


def store_medians(history: DataFrame, cutoff: dt.date) -> DataFrame:
    """Median trading-day sales per store over all history; a group is one row per day."""
    return (
        trading_days(before(history, cutoff))
        .groupBy("Store")
        .agg(F.percentile("Sales", F.lit(0.5)).alias("store_median"))
    )


def weekday_median(
    target: DataFrame, history: DataFrame, cutoff: dt.date, weeks: int = 4, name: str = "pred"
) -> DataFrame:
    """Weekday median, or the store's median where the weekday never traded."""
    return (
        target.join(weekday_medians(history, cutoff, weeks), ["Store", "DayOfWeek"], "left")
        .join(store_medians(history, cutoff), "Store", "left")
        .withColumn(name, F.coalesce("weekday_median", "store_median"))
        .drop("weekday_median", "store_median")
    )
