"""Programme and competitor features.

What depends on the store alone is computed on the store table; only what also
depends on the date is left to the rows of the panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.dates import month_abbreviation, month_start, monday_of_week

DAYS_PER_MONTH = 30.44
NOT_RECORDED = -999.0
MAX_MONTHS = 240.0


def store_attributes(stores: DataFrame, panel_stores: DataFrame) -> DataFrame:
    """Store table with the store-level parts of the features.

    ``panel_stores`` holds the stores of the panel: a missing competitor distance is
    taken as twice the largest distance among those.
    """
    widest = (
        stores.join(panel_stores.select("Store").distinct(), "Store", "left_semi")
        .agg((F.max("CompetitionDistance") * 2).alias("far"))
        .scalar()
    )
    return (
        stores.withColumns(distance_columns(widest))
        .withColumn(
            "competitor_since",
            month_start(F.col("CompetitionOpenSinceYear"), F.col("CompetitionOpenSinceMonth")),
        )
        .withColumn(
            "programme_since", monday_of_week(F.col("Promo2SinceYear"), F.col("Promo2SinceWeek"))
        )
        .withColumn("programme_months", F.split(F.coalesce("PromoInterval", F.lit("")), ","))
    )


def distance_columns(widest: Column) -> dict[str, Column]:
    return {
        "competition_distance_log": F.log1p(F.coalesce("CompetitionDistance", widest)),
        "competition_distance_missing": F.isnull("CompetitionDistance").cast("int"),
    }


def programme_columns(date: Column) -> dict[str, Column]:
    active = F.coalesce((F.col("Promo2") == 1) & (date >= F.col("programme_since")), F.lit(False))
    restarts = F.array_contains("programme_months", month_abbreviation(date))
    return {
        "promo2_active": active.cast("int"),
        "promo2_weeks_running": F.when(
            active, F.datediff(date, F.col("programme_since")) / F.lit(7.0)
        ).otherwise(F.lit(-1.0)),
        "promo2_restart_month": (active & restarts).cast("int"),
    }


def competitor_columns(date: Column) -> dict[str, Column]:
    """Months since the competitor opened: negative before the opening, -999 unknown."""
    months = F.datediff(date, F.col("competitor_since")) / F.lit(DAYS_PER_MONTH)
    return {
        "competition_open_months": F.greatest(
            F.least(F.coalesce(months, F.lit(NOT_RECORDED)), F.lit(MAX_MONTHS)), F.lit(NOT_RECORDED)
        )
    }
