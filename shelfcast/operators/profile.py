"""Profiles of the facts that later choices rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfcast.operators.ordering import exact_quantiles, running_totals
from shelfcast.operators.panel import trading_days

QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
STORE_QUANTILES = {"p01": 0.01, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p99": 0.99}


def _long(one_row: DataFrame, names: list[str]) -> DataFrame:
    """One (statistic, value) row per column of a one-row frame."""
    pairs = [F.struct(F.lit(n).alias("statistic"), F.col(n).cast("double").alias("value")) for n in names]
    return (
        one_row.select(F.explode(F.array(*pairs)).alias("p")).select("p.statistic", "p.value")
    )


def sample_skewness(value: Column) -> Column:
    """Skewness with the small-sample factor; Spark's own is the population form."""
    n = F.count(value).cast("double")
    return F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def target_profile(facts: DataFrame) -> DataFrame:
    """Distribution of trading-day sales, and the skew before and after log1p."""
    rows = trading_days(facts)
    sales = F.col("Sales").cast("double")
    moments = rows.agg(
        F.count("Sales").alias("count"),
        F.avg(sales).alias("mean"),
        F.stddev_samp(sales).alias("std"),
        F.min("Sales").alias("min"),
        F.max("Sales").alias("max"),
        sample_skewness(sales).alias("skew"),
        sample_skewness(F.log1p(sales)).alias("skew_log1p"),
    )
    quartiles = exact_quantiles(rows.select("Sales"), "Sales", QUARTILES)
    return _long(moments, moments.columns).unionByName(_long(quartiles, quartiles.columns))


def gap_audit(facts: DataFrame) -> DataFrame:
    """How many stores lack days, how many days they have, and where the holes lie."""
    counts = facts.groupBy("Store").agg(F.count(F.lit(1)).alias("days"))
    calendar = facts.agg(F.count_distinct("Date").alias("n")).scalar()
    gapped = counts.where(F.col("days") < calendar)
    # One row per distinct number of days, so at most one per calendar day.
    spread = counts.groupBy("days").agg(F.count(F.lit(1)).alias("n"))
    short = F.col("days") < calendar
    kept = F.when(short, F.col("n")).otherwise(F.lit(0))

    def at(p: float) -> Column:
        return F.percentile(F.when(short, F.col("days")), F.lit(p), F.greatest(kept, F.lit(1)))

    total = F.sum(kept)
    mean = F.try_divide(F.sum(kept * F.col("days")), total)
    squares = F.sum(kept * F.col("days") * F.col("days")) - total * mean * mean
    stores = spread.agg(
        F.max(calendar).alias("calendar_days"),
        F.sum("n").alias("stores"),
        F.sum(F.col("n") - kept).alias("full_stores"),
        total.alias("gapped_stores"),
        mean.alias("gapped_mean"),
        F.when(total > 1, F.sqrt(F.greatest(squares, F.lit(0.0)) / (total - 1))).alias("gapped_std"),
        F.min(F.when(short, F.col("days"))).alias("gapped_min"),
        at(0.25).alias("gapped_p25"),
        at(0.5).alias("gapped_p50"),
        at(0.75).alias("gapped_p75"),
        F.max(F.when(short, F.col("days"))).alias("gapped_max"),
    )
    n_gapped = gapped.agg(F.count(F.lit(1)).alias("n")).scalar()
    present = (
        facts.join(gapped.select("Store"), "Store", "left_semi")
        .groupBy("Date")
        .agg(F.count_distinct("Store").alias("present"))
    )
    absent = present.where(F.col("present") < n_gapped).agg(
        F.min("Date").alias("first"), F.max("Date").alias("last")
    )
    return stores.withColumn("absent_first", absent.select("first").scalar()).withColumn(
        "absent_last", absent.select("last").scalar()
    )


def weekday_profile(facts: DataFrame) -> DataFrame:
    """Share of open days and mean sales, over all and over trading days, per weekday."""
    return facts.groupBy("DayOfWeek").agg(
        (F.avg("Open") * 100).alias("pct_open"),
        F.avg("Sales").alias("mean_all"),
        F.avg(F.when(F.col("Open") == 1, F.col("Sales"))).alias("mean_open"),
    )


def promo_profile(facts: DataFrame) -> DataFrame:
    """Trading days, mean and median sales with and without promotion."""
    rows = trading_days(facts)
    means = rows.groupBy("Promo").agg(F.count("Sales").alias("days"), F.avg("Sales").alias("mean"))
    medians = exact_quantiles(rows.select("Promo", "Sales"), "Sales", {"median": 0.5}, ["Promo"])
    return means.join(medians, "Promo")


def store_totals(facts: DataFrame) -> DataFrame:
    """Trading-day totals per store: what every store-level mean is made of."""
    return trading_days(facts).groupBy("Store").agg(
        F.sum("Sales").alias("sales"), F.count("Sales").alias("days")
    )


def _lift(flag: str) -> Column:
    def mean(value: int) -> Column:
        on = F.col(flag) == value
        return F.try_divide(F.sum(F.when(on, F.col("sales"))), F.sum(F.when(on, F.col("days"))))

    return (F.try_divide(mean(1), mean(0)) - 1) * 100


def promo_lift(facts: DataFrame, stores: DataFrame) -> DataFrame:
    """Percent by which mean sales are higher with a promotion, and in programme stores.

    The second compares different stores and says nothing about cause.
    """
    daily = trading_days(facts).groupBy("Promo").agg(
        F.sum("Sales").alias("sales"), F.count("Sales").alias("days")
    )
    programme = store_totals(facts).join(stores.select("Store", "Promo2"), "Store", "left")
    return daily.agg(_lift("Promo").alias("lift_pct")).select(
        F.lit("Promo").alias("flag"), "lift_pct"
    ).unionByName(
        programme.agg(_lift("Promo2").alias("lift_pct")).select(F.lit("Promo2").alias("flag"), "lift_pct")
    )


def store_heterogeneity(facts: DataFrame) -> DataFrame:
    """Quantiles of store means, their p99/p01 ratio and the median variation in a store."""
    sales = F.col("Sales").cast("double")
    per_store = trading_days(facts).groupBy("Store").agg(
        F.avg(sales).alias("mean"), F.stddev_samp(sales).alias("std")
    ).withColumn("cv", F.try_divide(F.col("std"), F.col("mean")))
    moments = per_store.agg(
        F.count("mean").alias("count"),
        F.avg("mean").alias("mean"),
        F.stddev_samp("mean").alias("std"),
        F.min("mean").alias("min"),
        F.max("mean").alias("max"),
    )
    levels = exact_quantiles(per_store.select("mean"), "mean", STORE_QUANTILES).withColumn(
        "p99_over_p01", F.try_divide(F.col("p99"), F.col("p01"))
    )
    variation = exact_quantiles(per_store.select("cv"), "cv", {"median_cv": 0.5})
    return (
        _long(moments, moments.columns)
        .unionByName(_long(levels, levels.columns))
        .unionByName(_long(variation, variation.columns))
    )


def metadata_profile(
    facts: DataFrame, stores: DataFrame, attributes=("StoreType", "Assortment", "Promo2")
) -> DataFrame:
    """Mean trading-day sales and stores per attribute value, from one row per store."""
    pairs = [
        F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes
    ]
    return (
        store_totals(facts)
        .join(stores.select("Store", *attributes), "Store", "left")
        .select("sales", "days", F.explode(F.array(*pairs)).alias("p"))
        .groupBy("p.attribute", "p.value")
        .agg(
            F.try_divide(F.sum("sales"), F.sum("days")).alias("mean"),
            F.count(F.lit(1)).alias("n_stores"),
        )
    )


def distance_profile(stores: DataFrame) -> DataFrame:
    counts = stores.agg(
        F.count(F.lit(1)).alias("stores"),
        F.count_if(F.isnull("CompetitionDistance")).alias("missing"),
        F.max("CompetitionDistance").alias("max"),
    )
    median = exact_quantiles(
        stores.select("CompetitionDistance"), "CompetitionDistance", {"median": 0.5}
    )
    return _long(counts, counts.columns).unionByName(_long(median, median.columns))


def monthly_trend(facts: DataFrame, months: int = 18) -> DataFrame:
    """Mean trading-day sales of the last ``months`` calendar months, empty ones as NULL."""
    rows = trading_days(facts)
    span = rows.agg(F.trunc(F.min("Date"), "MM").alias("lo"), F.trunc(F.max("Date"), "MM").alias("hi"))
    start = F.greatest(F.col("lo"), F.add_months("hi", 1 - months))
    calendar = span.select(
        F.explode(F.sequence(start, F.col("hi"), F.expr("interval 1 month"))).alias("month")
    )
    first = span.select(start.alias("start")).scalar()
    means = (
        rows.where(F.col("Date") >= first)
        .groupBy(F.trunc("Date", "MM").alias("month"))
        .agg(F.avg("Sales").alias("mean"))
    )
    return calendar.join(means, "month", "left").orderBy("month")


def yearly_trend(facts: DataFrame) -> DataFrame:
    return (
        trading_days(facts)
        .groupBy(F.year("Date").alias("year"))
        .agg(F.avg("Sales").alias("mean"))
        .orderBy("year")
    )


def holiday_rates(df: DataFrame) -> DataFrame:
    """Share of rows in school holidays and on state holidays, per split."""
    return df.groupBy("split").agg(
        F.avg("SchoolHoliday").alias("school_holiday_rate"),
        F.avg((F.col("StateHoliday") != "0").cast("int")).alias("state_holiday_rate"),
    )


def _stores_by_size(facts: DataFrame) -> DataFrame:
    """Stores with their place by ascending mean trading-day sales, from zero."""
    means = store_totals(facts).select("Store", (F.col("sales") / F.col("days")).alias("mean"))
    ranked = running_totals(means, ["mean", "Store"], F.lit(1), "place")
    return ranked.withColumn("place", F.col("place") - 1)


def stratified_sample(facts: DataFrame, n: int = 15, seed: int = 0) -> DataFrame:
    """One store from each of ``n`` size strata, chosen by a seeded hash.

    The strata are as equal as can be; the first ones take the remainder.
    """
    ranked = _stores_by_size(facts)
    size = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    base = F.floor(size / n)
    extra = size % n
    wide = extra * (base + 1)
    stratum = F.when(F.col("place") < wide, F.floor(F.try_divide(F.col("place"), base + 1))).otherwise(
        extra + F.floor(F.try_divide(F.col("place") - wide, base))
    )
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("Store").cast("string")))
    return ranked.groupBy(stratum.alias("stratum")).agg(
        F.min_by("Store", draw).alias("Store"), F.count(F.lit(1)).alias("stores")
    )


def median_store(facts: DataFrame) -> DataFrame:
    """The store in the middle by size: place floor(n / 2)."""
    ranked = _stores_by_size(facts)
    size = ranked.agg(F.count(F.lit(1)).alias("n")).scalar()
    return ranked.where(F.col("place") == F.floor(size / 2)).select("Store", "mean")
