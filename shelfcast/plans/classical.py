"""A classical forecast per store: seasonal autoregression on log sales.

The model is (1 - a B - b B^2)(1 - s B^7)(1 - B^7) log1p(sales) = noise. It is fitted
by conditional least squares from one row of cross products per store, so a store's
history is summed where it lies and never gathered.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.dates import day_number
from shelfcast.functions.targets import closed_rule, from_log
from shelfcast.operators.history import CHUNK, DAY, HOME, with_halo
from shelfcast.operators.panel import before
from shelfcast.spec import PanelSpec

SEASON = 7
TERMS = (0, 1, 2, 7, 8, 9)
DEPTH = max(TERMS) + SEASON
SWEEPS = 20
UNKNOWNS = 3


def regular_series(history: DataFrame, spec: PanelSpec) -> DataFrame:
    """One log-sales value per store and day from its first to its last row.

    Days without sales are filled linearly between the trading days around them; both
    ends take the nearest value. Neighbours are looked up within chunks of days, and
    across chunks through one summary row per chunk.
    """
    value = F.when(F.col("Sales") > 0, F.log1p("Sales"))
    rows = history.select("Store", "Date", value.alias("y")).withColumn(
        CHUNK, F.floor(day_number(F.col("Date")) / F.lit(spec.chunk_days))
    )
    point = F.struct("Date", "y")
    by_chunk = Window.partitionBy("Store").orderBy(CHUNK)
    later = by_chunk.rowsBetween(1, Window.unboundedFollowing)
    earlier = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("Store")
    summary = (
        rows.groupBy("Store", CHUNK)
        .agg(
            F.min("Date").alias("_lo"),
            F.max("Date").alias("_hi"),
            F.min(F.when(F.isnotnull("y"), point)).alias("_point"),
        )
        .select(
            "Store",
            CHUNK,
            F.first("_point", ignorenulls=True).over(later).alias("_after"),
            F.count("_point").over(earlier).alias("_points_before"),
            F.min("_lo").over(whole).alias("series_start"),
            F.max("_hi").over(whole).alias("series_end"),
        )
    )
    inside = Window.partitionBy("Store", CHUNK).orderBy("Date")
    points = rows.where(F.isnotnull("y")).select(
        "Store",
        CHUNK,
        "Date",
        "y",
        F.lead(point).over(inside).alias("_next"),
        F.row_number().over(inside).alias("_nth"),
    )
    joined = points.join(summary, ["Store", CHUNK]).withColumn("_next", F.coalesce("_next", "_after"))
    opens = (F.col("_nth") == 1) & (F.col("_points_before") == 0)
    start = F.when(opens, F.col("series_start")).otherwise(F.col("Date"))
    stop = F.coalesce(F.date_sub(F.col("_next.Date"), 1), F.col("series_end"))
    days = joined.select(
        "Store",
        "series_end",
        F.col("Date").alias("_from"),
        "y",
        "_next",
        F.explode(F.sequence(start, stop)).alias("Date"),
    )
    share = F.datediff("Date", "_from") / F.datediff(F.col("_next.Date"), F.col("_from"))
    line = F.col("y") + (F.col("_next.y") - F.col("y")) * share
    filled = F.when((F.col("Date") > F.col("_from")) & F.isnotnull("_next"), line).otherwise(F.col("y"))
    return days.select("Store", "Date", filled.alias("y"), "series_end")


def _moment(i: int, j: int) -> str:
    return f"m_{min(i, j)}_{max(i, j)}"


def cross_products(series: DataFrame, spec: PanelSpec) -> DataFrame:
    """Sums of products of the weekly differences at the lags the model uses, per store."""
    window = Window.partitionBy("Store", CHUNK).orderBy(DAY)

    def back(k: int) -> Column:
        return F.lag("y", k).over(window) if k else F.col("y")

    rows = with_halo(series.select("Store", "Date", "y"), spec.chunk_days, DEPTH)
    rows = rows.withColumns({f"_z{k}": back(k) - back(k + SEASON) for k in TERMS})
    known = F.col(HOME)
    for k in TERMS:
        known = known & F.isnotnull(f"_z{k}")
    pairs = [(i, j) for i in TERMS for j in TERMS if i <= j]
    return (
        rows.where(known)
        .groupBy("Store")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(_moment(i, j)) for i, j in pairs],
        )
    )


def _coefficients() -> Column:
    """Alternate between the daily terms given the weekly one and the reverse."""
    def m(i: int, j: int) -> Column:
        return F.col(_moment(i, j))

    def without_season(i: int, j: int, s: Column) -> Column:
        cross = m(i, j + SEASON) + m(j, i + SEASON)
        return m(i, j) - s * cross + s * s * m(i + SEASON, j + SEASON)

    def without_days(i: int, j: int, a: Column, b: Column) -> Column:
        total = F.lit(0.0)
        for p, cp in ((0, F.lit(1.0)), (1, -a), (2, -b)):
            for q, cq in ((0, F.lit(1.0)), (1, -a), (2, -b)):
                total = total + cp * cq * m(i + p, j + q)
        return total

    def sweep(state: Column, _: Column) -> Column:
        s = state["s"]
        aa, ab, bb = without_season(1, 1, s), without_season(1, 2, s), without_season(2, 2, s)
        ya, yb = without_season(0, 1, s), without_season(0, 2, s)
        det = aa * bb - ab * ab
        a = F.try_divide(ya * bb - yb * ab, det)
        b = F.try_divide(yb * aa - ya * ab, det)
        with_ab = F.struct(a.alias("a"), b.alias("b"))
        return F.transform(
            F.array(with_ab),
            lambda c: F.struct(
                c["a"].alias("a"),
                c["b"].alias("b"),
                F.try_divide(
                    without_days(0, 7, c["a"], c["b"]), without_days(7, 7, c["a"], c["b"])
                ).alias("s"),
            ),
        )[0]

    zero = F.lit(0.0).cast("double")
    start = F.struct(zero.alias("a"), zero.alias("b"), zero.alias("s"))
    nullable = F.when(F.lit(True), start).cast("struct<a:double,b:double,s:double>")
    return F.aggregate(F.sequence(F.lit(1), F.lit(SWEEPS)), nullable, sweep)


def fit(series: DataFrame, spec: PanelSpec) -> DataFrame:
    """Coefficients per store; ``error`` says why a store has none."""
    fitted = cross_products(series, spec).select("Store", "n", _coefficients().alias("c"))
    # Fewer equations than coefficients have no one solution, whatever rounding makes of them.
    usable = F.col("n") >= UNKNOWNS
    solved = F.isnotnull("c.a") & F.isnotnull("c.b") & F.isnotnull("c.s")
    return fitted.select(
        "Store",
        F.when(usable & solved, F.col("c.a")).alias("a"),
        F.when(usable & solved, F.col("c.b")).alias("b"),
        F.when(usable & solved, F.col("c.s")).alias("s"),
        F.when(~usable, F.lit("too little history")).when(~solved, F.lit("no unique solution")).alias("error"),
    )


def _next_value(y: Column) -> Column:
    def z(k: int) -> Column:
        return F.element_at(y, -k) - F.element_at(y, -(k + SEASON))

    a, b, s = F.col("a"), F.col("b"), F.col("s")
    step = a * z(1) + b * z(2) + s * z(7) - a * s * z(8) - b * s * z(9)
    return F.element_at(y, -SEASON) + step


def forecast(history: DataFrame, cutoff: dt.date, spec: PanelSpec) -> DataFrame:
    """(Store, Date, pred, error) for the horizon after each store's last row before the cutoff.

    A store that cannot be fitted has one row with a reason and no forecast.
    """
    known = before(history, cutoff)
    series = regular_series(known, spec)
    # The last DEPTH days of a store, at most one row each.
    tail = (
        series.where(F.datediff("series_end", "Date") < DEPTH)
        .groupBy("Store", "series_end")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("Date", "y"))), lambda r: r["y"]).alias("tail"))
    )
    ready = (
        known.select("Store")
        .distinct()
        .join(fit(series, spec), "Store", "left")
        .join(tail, "Store", "left")
        .withColumn("error", F.coalesce("error", F.when(F.isnull("a"), F.lit("too little history"))))
    )
    path = F.aggregate(
        F.sequence(F.lit(1), F.lit(spec.horizon)),
        F.col("tail"),
        lambda y, _: F.concat(y, F.array(_next_value(y))),
    )
    steps = F.slice(path, F.size("tail") + 1, spec.horizon)
    return (
        ready.withColumn("_steps", F.when(F.isnull("error"), steps))
        .select("Store", "series_end", "error", F.posexplode_outer("_steps").alias("_i", "_y"))
        .select(
            "Store",
            F.date_add("series_end", F.col("_i") + 1).alias("Date"),
            from_log(F.col("_y")).alias("pred"),
            "error",
        )
    )


def classical_rows(target: DataFrame, forecasts: DataFrame, name: str = "pred") -> DataFrame:
    """Target rows with the classical forecast: nothing where missing or closed."""
    pred = forecasts.where(F.isnull("error")).select("Store", "Date", F.col("pred").alias("_pred"))
    return (
        target.join(pred, ["Store", "Date"], "left")
        .withColumn(name, closed_rule(F.greatest("_pred", F.lit(0.0)), F.col("Open")))
        .drop("_pred")
    )
