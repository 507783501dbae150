"""Promotion and sales history by calendar-day frames.

A frame such as 48..75 days back is a RANGE frame over the day number, so it means
days whether or not the table has a row for each of them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.dates import day_number
from shelfcast.spec import PanelSpec

CHUNK, DAY, HOME = "_chunk", "_day", "_home"


def with_halo(
    df: DataFrame, span: int, back: int, ahead: int = 0, wanted: tuple[dt.date, dt.date] | None = None
) -> DataFrame:
    """Cut every series into chunks of days, each with copies of the rows its frames reach.

    A row goes to its home chunk and to any chunk whose first days look back to it or
    whose last day looks ahead to it. Frames evaluated per (Store, chunk) are then
    exact for home rows, and a group never holds more than ``span + back + ahead``
    days, however long or hot a store is. With ``wanted`` days only the chunks that those lie in
    are made, each of them whole.
    """
    day = day_number(F.col("Date"))
    kept = F.lit(True)
    if wanted is not None:
        low, high = ((d - dt.date(1970, 1, 1)).days // span for d in wanted)
        kept = F.col(CHUNK).between(low, high)
        start, end = low * span - back, (high + 1) * span - 1 + ahead
        df = df.where(F.col("Date").between(*[F.lit(dt.date(1970, 1, 1) + dt.timedelta(days=n)) for n in (start, end)]))
    first = F.floor((day - ahead) / F.lit(span))
    last = F.floor((day + back) / F.lit(span))
    copies = (
        df.withColumn(DAY, day)
        .withColumn(CHUNK, F.explode(F.sequence(first, last)))
        .where(kept)
        .withColumn(HOME, F.col(CHUNK) == F.floor(F.col(DAY) / F.lit(span)))
    )
    return copies.repartition("Store", CHUNK)


def _days(oldest: int, newest: int):
    """Frame from ``oldest`` to ``newest`` days ago; negative means ahead."""
    return Window.partitionBy("Store", CHUNK).orderBy(DAY).rangeBetween(-oldest, -newest)


def _on_day(column: str, ago: int) -> Column:
    """The value exactly ``ago`` days back, NULL if that day has no row."""
    return F.max(column).over(_days(ago, ago))


def promo_windows() -> dict[str, Column]:
    def flag(ago: int) -> Column:
        return F.coalesce(_on_day("Promo", ago), F.lit(0))

    return {
        "promo_prev_day": flag(1),
        "promo_next_day": flag(-1),
        "promo_lag7": flag(7),
        "promo_lag14": flag(14),
        "promo_count_14d": F.coalesce(F.sum("Promo").over(_days(13, 0)), F.lit(0)),
    }


def promo_edges() -> dict[str, Column]:
    """First and last day of a promotion run, from the neighbouring days' flags."""
    today = F.coalesce(F.col("Promo") == 1, F.lit(False))
    return {
        "promo_first_day": (today & (F.col("promo_prev_day") == 0)).cast("int"),
        "promo_last_day": (today & (F.col("promo_next_day") == 0)).cast("int"),
    }


def _median(values: Column) -> Column:
    """Median of an array that is not empty.

    The lambda lets the array be sorted once. It also keeps the projection it is in out
    of whole-stage code, where one method would outgrow what the JVM compiles.
    """
    def middle(ordered: Column) -> Column:
        low = F.floor((F.size(ordered) - 1) / F.lit(2)).cast("int")
        high = F.floor(F.size(ordered) / F.lit(2)).cast("int")
        return (F.get(ordered, low) + F.get(ordered, high)) / 2

    return F.transform(F.array(F.sort_array(values)), middle)[0]


def _reaches(n: Column, least: int) -> Column:
    """Whether ``n`` is ``least`` or more; by a lambda, for the sake of the projection, as in ``_median``."""
    return F.transform(F.array(n), lambda n: n >= least)[0]


def running_sums() -> Column:
    """Counts and sums of trading-day sales and of opening, from a chunk's first row on.

    Sales are whole numbers, so differences of two sums are exact; squares are summed
    as decimals and only their differences become doubles.
    """
    frame = Window.partitionBy("Store", CHUNK).orderBy(DAY).rowsBetween(Window.unboundedPreceding, 0)
    exact = F.col("_sold").cast("decimal(18,0)")
    return F.struct(
        F.count("_sold").over(frame).alias("n"),
        F.coalesce(F.sum("_sold").over(frame), F.lit(0)).alias("sold"),
        F.coalesce(F.sum(exact * exact).over(frame), F.lit(0).cast("decimal(38,0)")).alias("squares"),
        F.count("Open").over(frame).alias("days"),
        F.coalesce(F.sum("Open").over(frame), F.lit(0)).alias("open"),
    )


def sales_windows(spec: PanelSpec) -> dict[str, Column]:
    """Lags, the running sums at the edges of each rolling window, and the level's values.

    A rolling window costs two look-ups of a running sum, whatever its length.
    """
    columns = {}
    for lag in sorted({*spec.lags, *spec.weekday_lags}):
        columns[f"lag_{lag}"] = _on_day("_sold", lag)
    edges = {0, spec.level_window, *spec.roll_windows}
    for ago in sorted(spec.horizon + e for e in edges):
        known = Window.partitionBy("Store", CHUNK).orderBy(DAY)
        known = known.rangeBetween(Window.unboundedPreceding, -ago)
        columns[f"_until_{ago}"] = F.last("_run").over(known)
    level = _days(spec.horizon + spec.level_window - 1, spec.horizon)
    columns["_level"] = F.collect_list("_sold").over(level)
    return columns


def sales_levels(spec: PanelSpec) -> dict[str, Column]:
    """Rolling mean, deviation, median and open rate, each with enough days or NULL."""
    def between(window: int, part: str) -> Column:
        new = F.col(f"_until_{spec.horizon}.{part}")
        old = F.col(f"_until_{spec.horizon + window}.{part}")
        return F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0))

    columns = {}
    for window in spec.roll_windows:
        n, total, squares = (between(window, part) for part in ("n", "sold", "squares"))
        enough = _reaches(n, spec.min_count(window))
        mean = total / n
        columns[f"roll_mean_{window}"] = F.when(enough, mean)
        # Mostly a long; converting a decimal to a double is slow.
        square_sum = F.coalesce(squares.try_cast("long").cast("double"), squares.cast("double"))
        spread = F.greatest(square_sum - mean * total, F.lit(0.0))
        columns[f"roll_std_{window}"] = F.when(enough, F.sqrt(spread / (n - 1)))
    level = spec.level_window
    least = spec.min_count(level)
    columns[f"roll_median_{level}"] = F.when(F.size("_level") >= least, _median(F.col("_level")))
    columns[f"open_rate_{level}"] = F.when(
        between(level, "days") >= least, between(level, "open") / between(level, "days")
    )
    return columns


def sales_ratios(spec: PanelSpec) -> dict[str, Column]:
    """Trend and weekday level; the latter averages lags that are already columns."""
    lags = [F.col(f"lag_{lag}") for lag in spec.weekday_lags]
    known = F.lit(0)
    total = F.lit(0)
    for lag in lags:
        known = known + F.isnotnull(lag).cast("int")
        total = total + F.coalesce(lag, F.lit(0))
    weekday = F.when(known >= 2, total / known)
    level = F.col(f"roll_mean_{spec.level_window}")
    trend = F.col(f"roll_mean_{spec.trend_window}")
    return {
        f"trend_{spec.level_window}_over_{spec.trend_window}": F.try_divide(level, trend),
        f"dow_mean_{spec.weekday_weeks}": weekday,
        "dow_ratio": F.try_divide(weekday, level),
    }


def promo_agreement(df: DataFrame, spec: PanelSpec, lags=(7, 14, 21, 28)) -> DataFrame:
    """How often a day's promotion state equals that of ``lag`` days before, per lag."""
    windows = {f"_p{lag}": _on_day("Promo", lag) for lag in lags}
    rows = with_halo(df.select("Store", "Date", "Promo"), spec.chunk_days, max(lags))
    shares = [
        F.struct(
            F.lit(lag).alias("lag"),
            F.count(f"_p{lag}").alias("pairs"),
            (F.avg((F.col("Promo") == F.col(f"_p{lag}")).cast("int")) * 100).alias("agree_pct"),
        )
        for lag in lags
    ]
    one = rows.withColumns(windows).where(HOME).agg(F.array(*shares).alias("s"))
    return one.select(F.explode("s").alias("s")).select("s.lag", "s.pairs", "s.agree_pct")


def promo_mismatch_cost(df: DataFrame, scored: Column, spec: PanelSpec) -> DataFrame:
    """Error of a seven-days-ago forecast, by whether the promotion state is the same.

    ``scored`` picks the judged rows; earlier rows only serve as their past.
    """
    rows = with_halo(df, spec.chunk_days, 7).withColumns(
        {"_then": _on_day("Sales", 7), "_promo_then": _on_day("Promo", 7)}
    )
    judged = rows.where(
        F.col(HOME) & scored & (F.col("Open") == 1) & (F.col("Sales") > 0) & F.isnotnull("_then")
    )
    error = F.abs(F.col("Sales") - F.col("_then")) / F.col("Sales") * 100
    same = F.coalesce(F.col("Promo") == F.col("_promo_then"), F.lit(False))
    return judged.groupBy(same.alias("promo_matches")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(error).alias("mean_error_pct")
    )


def sales_feature_names(spec: PanelSpec) -> list[str]:
    names = [f"lag_{lag}" for lag in spec.lags]
    for window in spec.roll_windows:
        names += [f"roll_mean_{window}", f"roll_std_{window}"]
    level = spec.level_window
    return names + [
        f"roll_median_{level}",
        f"trend_{level}_over_{spec.trend_window}",
        f"open_rate_{level}",
        f"dow_mean_{spec.weekday_weeks}",
        "dow_ratio",
    ]


def add_history(
    df: DataFrame,
    spec: PanelSpec,
    promo: bool = True,
    sales: bool = True,
    wanted: tuple[dt.date, dt.date] | None = None,
) -> DataFrame:
    """Promotion and sales features of every row: one exchange, one sort.

    With ``wanted``, a first and a last day, the rows of those days alone. A filter on days does not
    move below a window; as frames never leave a chunk, other chunks need not be made for it.
    """
    if not isinstance(df.schema["Sales"].dataType, T.IntegralType):
        raise TypeError("Sales must be whole numbers; hold fractions as cents")
    sold = F.when(F.col("Open") == 1, F.col("Sales"))
    out = with_halo(
        df.withColumn("_sold", sold), spec.chunk_days, spec.look_back, spec.look_ahead, wanted
    )
    windows = {}
    if promo:
        windows |= promo_windows()
    if sales:
        out = out.withColumn("_run", running_sums())
        windows |= sales_windows(spec)
    out = out.withColumns(windows).where(HOME)
    if wanted is not None:
        out = out.where(F.col("Date").between(*[F.lit(d) for d in wanted]))
    if promo:
        out = out.withColumns(promo_edges())
    if sales:
        out = out.withColumns(sales_levels(spec)).withColumns(sales_ratios(spec))
    helpers = [c for c in windows if c.startswith("_")]
    helpers += [f"lag_{lag}" for lag in spec.weekday_lags if lag not in spec.lags]
    return out.drop("_sold", "_run", CHUNK, DAY, HOME, *helpers)
