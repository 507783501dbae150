"""A classical forecast with moving-average terms, by regression in two stages.

Of the weekly differences z of log sales, a long autoregression is fitted first; what it leaves
stands for the noise e. Then z is regressed on its own and on the noise's lags of a day and a week:

    z[t] = f1 z[t-1] + f7 z[t-7] + g1 e[t-1] + g7 e[t-7] + e[t]

The noise is a weighted sum of lags of z, so all sums of the second stage follow from those of the
first: one row of cross products per store holds both, and no history is gathered or read twice.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.targets import from_log
from shelfcast.operators.history import CHUNK, DAY, HOME, with_halo
from shelfcast.operators.panel import before
from shelfcast.plans.classical import SEASON, regular_series
from shelfcast.spec import PanelSpec

#: Lags of the long autoregression, and those of z and of its noise in the model.
LONG = (1, 2, 7, 8, 9, 14)
OWN = (1, 7)
NOISE = (1, 7)
#: All lags of z that either stage multiplies.
LAGS = tuple(sorted({0, *LONG, *OWN} | {p + k for p in NOISE for k in (0, *LONG)}))
DEPTH = max(LAGS) + SEASON
#: Fewer days than this for each unknown are no history.
DAYS_EACH = 10


def _product(i: int, j: int) -> Column:
    return F.col(f"m_{min(i, j)}_{max(i, j)}")


def products(series: DataFrame, spec: PanelSpec) -> DataFrame:
    """Sums of products of the weekly differences at all lags, per store."""
    window = Window.partitionBy("Store", CHUNK).orderBy(DAY)
    days = sorted({k + s for k in LAGS for s in (0, SEASON)})
    rows = with_halo(series.select("Store", "Date", "y"), spec.chunk_days, DEPTH)
    rows = rows.withColumns({f"_y{k}": F.lag("y", k).over(window) for k in days if k}).withColumn("_y0", F.col("y"))
    rows = rows.select("Store", HOME, *[(F.col(f"_y{k}") - F.col(f"_y{k + SEASON}")).alias(f"_z{k}") for k in LAGS])
    known = F.col(HOME)
    for k in LAGS:
        known = known & F.isnotnull(f"_z{k}")
    pairs = [(i, j) for i in LAGS for j in LAGS if i <= j]
    sums = [F.sum(F.col(f"_z{i}") * F.col(f"_z{j}")).alias(f"m_{i}_{j}") for i, j in pairs]
    return rows.where(known).groupBy("Store").agg(F.count(F.lit(1)).alias("n"), *sums)


def solution(rows: list[list[Column]]) -> Column:
    """The unknowns of a linear system, an array; each row ends in its right side.

    Elimination by one pivot after the other. An array with NULLs where a pivot vanishes.
    """
    size = len(rows)

    def eliminate(matrix: Column, k: Column) -> Column:
        pivot_row = F.get(matrix, k)
        pivot = F.get(pivot_row, k)

        def cleared(row: Column, i: Column) -> Column:
            share = F.try_divide(F.get(row, k), pivot)
            return F.when(i == k, F.transform(row, lambda x: F.try_divide(x, pivot))).otherwise(
                F.zip_with(row, pivot_row, lambda x, y: x - y * share)
            )

        return F.transform(matrix, cleared)

    matrix = F.array(*[F.array(*[c.cast("double") for c in row]) for row in rows])
    done = F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), matrix, eliminate)
    return F.transform(done, lambda row: F.get(row, F.lit(size)))


def coefficients(series: DataFrame, spec: PanelSpec) -> DataFrame:
    """(Store, n, long, own, error): the long autoregression's weights and f1, f7, g1, g7.

    ``error`` says why a store has none.
    """
    first = [[_product(i, j) for j in LONG] + [_product(0, i)] for i in LONG]
    rows = products(series, spec).withColumn("long", solution(first))
    # e[t-p] is the sum of weight[k] * z[t-p-k].
    weight = {0: F.lit(1.0)} | {k: -F.get("long", F.lit(i)) for i, k in enumerate(LONG)}
    rows = rows.withColumns({f"w_{k}": w for k, w in weight.items()})

    def with_noise(i: int, p: int) -> Column:
        return sum((F.col(f"w_{k}") * _product(i, p + k) for k in weight), F.lit(0.0))

    def of_noise(p: int, q: int) -> Column:
        return sum((F.col(f"w_{k}") * with_noise(p + k, q) for k in weight), F.lit(0.0))

    terms = [(False, i) for i in OWN] + [(True, p) for p in NOISE]

    def product(a: tuple[bool, int], b: tuple[bool, int]) -> Column:
        if a[0] and b[0]:
            return of_noise(a[1], b[1])
        if a[0] or b[0]:
            return with_noise(*((b[1], a[1]) if a[0] else (a[1], b[1])))
        return _product(a[1], b[1])

    sums = {f"s_{x}_{y}": product(a, b) for x, a in enumerate(terms) for y, b in enumerate(terms) if x <= y}
    sums |= {f"r_{x}": product((False, 0), a) for x, a in enumerate(terms)}
    rows = rows.withColumns(sums)
    second = [[F.col(f"s_{min(x, y)}_{max(x, y)}") for y in range(len(terms))] + [F.col(f"r_{x}")] for x in range(len(terms))]
    usable = F.col("n") >= DAYS_EACH * len(LONG)
    rows = rows.withColumn("own", solution(second))
    solved = ~F.exists("long", lambda c: c.isNull()) & ~F.exists("own", lambda c: c.isNull())
    error = F.when(~usable, F.lit("too little history")).when(~solved, F.lit("no unique solution"))
    return rows.select("Store", "n", "long", "own", error.alias("error"))


def forecast(history: DataFrame, cutoff: dt.date, spec: PanelSpec) -> DataFrame:
    """(Store, Date, pred, error) for the horizon after each store's last row before the cutoff.

    The noise of days to come is 0. A store that cannot be fitted has one row with a reason.
    """
    known = before(history, cutoff)
    series = regular_series(known, spec)
    # The last DEPTH days of a store, at most one row each.
    tail = (
        series.where(F.datediff("series_end", "Date") < DEPTH)
        .groupBy("Store", "series_end")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("Date", "y"))), lambda r: r["y"]).alias("y"))
    )
    fitted = coefficients(series, spec)
    ready = known.select("Store").distinct().join(fitted, "Store", "left").join(tail, "Store", "left")
    ready = ready.withColumn("error", F.when(F.isnull("n"), F.lit("too little history")).otherwise(F.col("error")))

    def z(y: Column, ago: int) -> Column:
        return F.element_at(y, -ago) - F.element_at(y, -(ago + SEASON))

    # The noise of the last week, the oldest day first.
    noise = [
        z(F.col("y"), ago) - sum((F.get("long", F.lit(i)) * z(F.col("y"), ago + k) for i, k in enumerate(LONG)), F.lit(0.0))
        for ago in range(max(NOISE), 0, -1)
    ]
    start = F.struct(F.col("y").alias("y"), F.array(*noise).alias("e"))

    def step(state: Column, _: Column) -> Column:
        y, e = state["y"], state["e"]
        lags = [z(y, k) for k in OWN] + [F.element_at(e, -k) for k in NOISE]
        value = sum((F.get("own", F.lit(i)) * lag for i, lag in enumerate(lags)), F.element_at(y, -SEASON))
        return F.struct(F.concat(y, F.array(value)).alias("y"), F.concat(e, F.array(F.lit(0.0))).alias("e"))

    fits = F.isnull("error") & (F.size("y") == DEPTH)
    path = F.when(fits, F.aggregate(F.sequence(F.lit(1), F.lit(spec.horizon)), start, step)["y"])
    return (
        ready.withColumn("steps", F.slice(path, DEPTH + 1, spec.horizon))
        .select("Store", "series_end", "error", F.posexplode_outer("steps").alias("i", "ahead"))
        .select("Store", F.date_add("series_end", F.col("i") + 1).alias("Date"), from_log(F.col("ahead")).alias("pred"), "error")
    )
