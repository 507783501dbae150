"""Range forecasts: many requests answered from one feature table in one job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.dates import iso_weekday
from shelfcast.operators.selection import CATEGORICAL, serving_columns
from shelfcast.operators.vocabulary import require_known
from shelfcast.plans.features import features_between, serving_features
from shelfcast.sources.files import extended_history
from shelfcast.sources.staging import bucketed
from shelfcast.spec import PanelSpec

#: What serving rows are looked up by.
SERVED_BY = ("store_key", "Date")
OK, UNKNOWN, REVERSED, OUTSIDE, EMPTY = "ok", "unknown store", "reversed range", "outside range", "no rows"


def serving_table(
    facts: DataFrame,
    future: DataFrame,
    stores: DataFrame,
    features: list[str],
    spec: PanelSpec,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """Features of every servable day, built once and bucketed by store and day.

    A given vocabulary must hold all values of the categorical features.
    """
    table = serving_features(extended_history(facts, future), stores, spec)
    table = bucketed(serving_columns(table, features), "serving", SERVED_BY)
    if vocabulary is not None:
        require_known(table, vocabulary, tuple(c for c in CATEGORICAL if c in features))
    return table


def offline_table(facts: DataFrame, stores: DataFrame, features: list[str], spec: PanelSpec) -> DataFrame:
    """The same features of the days from the test window on, from the training path, bucketed alike."""
    last = spec.test_start + dt.timedelta(days=spec.horizon - 1)
    table = features_between(facts, stores, spec.test_start, last, spec)
    return bucketed(serving_columns(table, features), "offline", SERVED_BY)


def calendar_table(future: DataFrame) -> DataFrame:
    """The published ids, bucketed as the serving table is."""
    return bucketed(future.withColumnRenamed("Store", "store_key"), "calendar", SERVED_BY)


def serving_summary(serving: DataFrame) -> DataFrame:
    return serving.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_distinct("store_key").alias("stores"),
        F.count("Sales").alias("known"),
        F.count_if(F.isnull("Sales")).alias("unseen"),
        F.min("Date").alias("serve_from"),
        F.max("Date").alias("serve_to"),
    )


def store_ranges(serving: DataFrame) -> DataFrame:
    return serving.groupBy("store_key").agg(
        F.min("Date").alias("first_date"), F.max("Date").alias("last_date")
    )


def store_list(serving: DataFrame, limit: int = 50) -> DataFrame:
    """The first stores that can be served, and how many there are in all."""
    stores = serving.select("store_key").distinct()
    n = stores.agg(F.count(F.lit(1)).alias("n")).scalar()
    return stores.orderBy("store_key").limit(limit).withColumn("n_stores", n)


def _checked(requests: DataFrame, serving: DataFrame) -> DataFrame:
    """Requests with their store's range and the first reason to refuse them, if any."""
    span = serving.agg(F.min("Date").alias("lo"), F.max("Date").alias("hi"))
    low, high = span.select("lo").scalar(), span.select("hi").scalar()
    ranges = store_ranges(serving).withColumnRenamed("store_key", "store_id")
    refused = (
        F.when(F.isnull("first_date"), UNKNOWN)
        .when(F.col("end_date") < F.col("start_date"), REVERSED)
        .when((F.col("start_date") < low) | (F.col("end_date") > high), OUTSIDE)
    )
    return requests.join(ranges, "store_id", "left").withColumn("refused", refused)


def _requested_days(checked: DataFrame) -> DataFrame:
    """One row per day of each request that is not refused; at most the servable days."""
    return checked.where(F.isnull("refused")).select(
        "request_id",
        F.col("store_id").alias("store_key"),
        F.explode(F.sequence("start_date", "end_date")).alias("Date"),
    )


def request_rows(requests: DataFrame, serving: DataFrame) -> DataFrame:
    """Serving rows of every valid request.

    The range is spelt out as days, so the join is on (store, day): a store asked for
    by a third of all requests is spread over its days.
    """
    return _requested_days(_checked(requests, serving)).join(serving, ["store_key", "Date"])


def request_status(requests: DataFrame, serving: DataFrame) -> DataFrame:
    """Status of each request and the number of days it gets."""
    checked = _checked(requests, serving)
    days = (
        _requested_days(checked)
        .join(serving.select("store_key", "Date"), ["store_key", "Date"])
        .groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("n_days"))
    )
    status = F.coalesce("refused", F.when(F.isnull("n_days"), EMPTY).otherwise(OK))
    return checked.join(days, "request_id", "left").select(
        "request_id",
        "store_id",
        "start_date",
        "end_date",
        status.alias("status"),
        F.coalesce("n_days", F.lit(0)).alias("n_days"),
        F.when(status == EMPTY, F.col("first_date")).alias("first_date"),
        F.when(status == EMPTY, F.col("last_date")).alias("last_date"),
    )


def _percent_error():
    actual = F.when(F.col("Sales") > 0, F.col("Sales"))
    return F.abs(actual - F.col("pred")) / actual * 100


def day_forecasts(rows: DataFrame) -> DataFrame:
    """One row per request and day; no actual and no error where sales are unknown."""
    return rows.select(
        "request_id",
        F.col("store_key").alias("store_id"),
        F.col("Date").alias("date"),
        iso_weekday(F.col("Date")).alias("day_of_week"),
        (F.col("Open") == 1).alias("open"),
        (F.col("Promo") == 1).alias("promo"),
        F.round("pred", 2).alias("predicted_sales"),
        F.col("Sales").cast("double").alias("actual_sales"),
        F.round(_percent_error(), 2).alias("absolute_percentage_error"),
    )


def range_summaries(rows: DataFrame) -> DataFrame:
    """Totals per request."""
    trading = F.sum(F.col("Open").cast("long"))
    return rows.groupBy("request_id").agg(
        F.first("store_key").alias("store_id"),
        F.count(F.lit(1)).alias("n_days"),
        trading.alias("n_trading_days"),
        F.round(F.sum("pred"), 2).alias("total_predicted_sales"),
        F.round(F.sum("pred") / F.greatest(trading, F.lit(1)), 2).alias(
            "mean_predicted_sales_per_trading_day"
        ),
        F.round(F.avg(_percent_error()), 2).alias("mape_vs_actual"),
    )


def forecast_ranges(
    requests: DataFrame, serving: DataFrame, predict: Callable[[DataFrame], DataFrame]
) -> tuple[DataFrame, DataFrame]:
    """Day rows and summaries of all valid requests; ``predict`` adds ``pred`` to rows.

    A forecast belongs to a store and a day: the days that any request asks for are picked first, so
    each is scored once, however many requests ask for it, and days nobody asks for are not. Only
    what answers show goes through the join.
    """
    wanted = ["store_key", "Date", "Open", "Promo", "Sales", "pred"]
    days = _requested_days(_checked(requests, serving))
    asked = serving.join(days.select("store_key", "Date").distinct(), ["store_key", "Date"], "left_semi")
    rows = days.join(predict(asked).select(*wanted), ["store_key", "Date"])
    return day_forecasts(rows), range_summaries(rows)
