"""Baselines scored on a held-out window."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.targets import closed_rule
from shelfcast.operators.baselines import (
    last_week_repeated,
    same_day_last_week,
    store_medians,
    weekday_median,
)
from shelfcast.operators.panel import between, split_days, trading_days, trailing
from shelfcast.operators.scores import evaluate, long_forecasts
from shelfcast.spec import PanelSpec

BASELINES = ("lag7_rolling", "last_week_tiled", "weekday_median_4w")


def window_rows(facts: DataFrame, split: str, spec: PanelSpec) -> DataFrame:
    return between(facts, *split_days(split, spec)).withColumn("split", F.lit(split))


def week_before(facts: DataFrame, split: str, spec: PanelSpec) -> DataFrame:
    """The days that lie seven days before those of a split."""
    return between(facts, *[d and d - dt.timedelta(days=7) for d in split_days(split, spec)])


def median_forecasts(facts: DataFrame, split: str, spec: PanelSpec, weeks: int = 4) -> DataFrame:
    """Rows of a split with the weekday median known at that split's own cutoff."""
    return weekday_median(window_rows(facts, split, spec), facts, spec.cutoff(split), weeks)


def baseline_forecasts(facts: DataFrame, split: str, spec: PanelSpec) -> DataFrame:
    """The three baselines side by side on the rows of a split."""
    cutoff: dt.date = spec.cutoff(split)
    rows = window_rows(facts, split, spec)
    rows = same_day_last_week(rows, week_before(facts, split, spec), "lag7_rolling")
    rows = last_week_repeated(rows, facts, cutoff, "last_week_tiled")
    return weekday_median(rows, facts, cutoff, 4, "weekday_median_4w")


def baseline_scores(facts: DataFrame, spec: PanelSpec, splits=("valid", "test")) -> DataFrame:
    """Scores of all baselines on all splits from one aggregation."""
    parts = [
        long_forecasts(baseline_forecasts(facts, split, spec), {b: b for b in BASELINES})
        for split in splits
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return evaluate(rows, ("split", "label"), scale=spec.money_scale)


def weeks_scores(
    facts: DataFrame, split: str, spec: PanelSpec, weeks: tuple[int, ...]
) -> DataFrame:
    """Weekday medians over several numbers of weeks, scored on one split.

    All medians of a store and weekday come from one pass over the longest look-back.
    """
    cutoff = spec.cutoff(split)
    recent = trading_days(trailing(facts, cutoff, 7 * max(weeks)))

    def since(w: int):
        return F.when(F.col("Date") >= F.lit(cutoff - dt.timedelta(days=7 * w)), F.col("Sales"))

    medians = recent.groupBy("Store", "DayOfWeek").agg(
        *[F.percentile(since(w), F.lit(0.5)).alias(f"weeks_{w}") for w in weeks]
    )
    rows = (
        window_rows(facts, split, spec)
        .join(medians, ["Store", "DayOfWeek"], "left")
        .join(store_medians(facts, cutoff), "Store", "left")
        .withColumns({f"weeks_{w}": F.coalesce(f"weeks_{w}", "store_median") for w in weeks})
        .drop("store_median")
    )
    long = long_forecasts(rows, {f"weeks_{w}": f"weeks_{w}" for w in weeks})
    return evaluate(long, scale=spec.money_scale)


def store_forecast(rows: DataFrame, store: DataFrame, baseline: str, model: str) -> DataFrame:
    """Trading days of one store with both forecasts and each one's MAPE for the store.

    ``store`` has one row. The MAPE window runs over that store's days in the split.
    """
    chosen = trading_days(rows.join(store.select("Store"), "Store", "left_semi"))
    everything = Window.partitionBy("Store")
    actual = F.when(F.col("Sales") > 0, F.col("Sales"))

    forecasts = {c: closed_rule(F.col(c), F.col("Open")) for c in (baseline, model)}

    def mape_of(column: str):
        return F.avg(F.abs(actual - forecasts[column]) / actual).over(everything) * 100

    return chosen.select(
        "Store",
        "Date",
        "Promo",
        "Sales",
        forecasts[baseline].alias("baseline"),
        forecasts[model].alias("model"),
        mape_of(baseline).alias("baseline_mape"),
        mape_of(model).alias("model_mape"),
    )
