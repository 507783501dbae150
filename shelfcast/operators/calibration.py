"""Constant multipliers for a squared percentage error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.targets import rmspe

# The grid 0.960, 0.965 .. 1.020.
MULTIPLIERS = tuple(round(0.960 + 0.005 * i, 3) for i in range(13))
MIN_GAIN_PCT = 1.0


def total_ratio(forecasts: DataFrame) -> DataFrame:
    """Total forecast over total actual on trading days."""
    is_open = F.col("Open") == 1
    return forecasts.groupBy("label").agg(
        F.try_divide(
            F.sum(F.when(is_open, F.col("pred"))), F.sum(F.when(is_open, F.col("Sales")))
        ).alias("ratio")
    )


def _grid(multipliers) -> Column:
    """RMSPE of every multiplier on trading days, as one array aggregate."""
    is_open = F.col("Open") == 1
    return F.array(
        *[
            F.struct(
                rmspe(F.col("Sales"), F.col("pred") * F.lit(f), is_open).alias("rmspe"),
                F.lit(f).alias("multiplier"),
            )
            for f in multipliers
        ]
    )


def multiplier_scores(forecasts: DataFrame, multipliers=MULTIPLIERS) -> DataFrame:
    """RMSPE per multiplier, all of them in one pass over the rows."""
    return (
        forecasts.groupBy("label")
        .agg(_grid(multipliers).alias("grid"))
        .select("label", F.explode("grid").alias("g"))
        .select("label", "g.multiplier", "g.rmspe")
    )


def best_multiplier(forecasts: DataFrame, multipliers=MULTIPLIERS) -> DataFrame:
    """Best grid multiplier, its gain, the one to apply, and the closed-form optimum.

    The smallest multiplier wins a tie. A gain of a percent or less is not applied.
    The closed form E[r] / E[r^2], r = forecast / actual, is a check on the grid.
    """
    actual = F.when((F.col("Open") == 1) & (F.col("Sales") > 0), F.col("Sales"))
    ratio = F.col("pred") / actual
    rows = forecasts.groupBy("label").agg(
        rmspe(F.col("Sales"), F.col("pred")).alias("base_rmspe"),
        F.try_divide(F.avg(ratio), F.avg(ratio * ratio)).alias("closed_form"),
        F.array_min(_grid(multipliers)).alias("best"),
    )
    gain = F.try_divide(F.col("base_rmspe") - F.col("best.rmspe"), F.col("base_rmspe")) * 100
    return rows.select(
        "label",
        "base_rmspe",
        F.col("best.multiplier").alias("best_multiplier"),
        F.col("best.rmspe").alias("best_rmspe"),
        gain.alias("gain_pct"),
        F.when(gain > MIN_GAIN_PCT, F.col("best.multiplier")).otherwise(F.lit(1.0)).alias("applied"),
        "closed_form",
    )
