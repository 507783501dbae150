"""Two paths that must agree: time leakage, serving skew, submission ids."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["Store", "Date"]


def _unequal(a: Column, b: Column, rtol: float, atol: float) -> Column:
    close = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return ~(a.eqNullSafe(b) | F.coalesce(close, F.lit(False)))


def _paired(left: DataFrame, right: DataFrame, columns: list[str], key: list[str] = KEY) -> DataFrame:
    a = left.select(*key, *[F.col(c).cast("double").alias(f"a_{c}") for c in columns])
    b = right.select(*key, *[F.col(c).cast("double").alias(f"b_{c}") for c in columns])
    return a.join(b, key)


def leakage_report(
    build: Callable[[DataFrame], DataFrame],
    panel: DataFrame,
    cutoff: dt.date,
    rows: Column,
    columns: list[str],
    rtol: float = 1e-9,
    atol: float = 1e-8,
) -> DataFrame:
    """Build features with and without the sales from ``cutoff`` on, and compare.

    ``rows`` picks the rows to compare. A column that differs read a sale it could not
    have known. The panel has to reach as far as a leak might: days that are cut off
    are unknown in both builds. Both builds go through one pass over one panel: every store is
    there twice, as an even number with its sales and as the odd one after it without those from
    ``cutoff`` on, and a store is told apart by its number, which no feature reads.
    """
    store = F.col("Store").cast("long") * 2
    known = F.when(F.col("Date") < F.lit(cutoff), F.col("Sales"))
    seen = F.struct(store.alias("Store"), F.col("Sales"))
    blind = F.struct((store + 1).alias("Store"), known.alias("Sales"))
    others = [c for c in panel.columns if c not in ("Store", "Sales")]
    both = panel.select(*others, F.explode(F.array(seen, blind)).alias("_s")).select(*others, "_s.Store", "_s.Sales")
    built = build(both).where(rows)
    is_blind = F.col("Store").bitwiseAND(F.lit(1)) == 1
    key = F.shiftright("Store", 1)
    own = [F.max(F.when(~is_blind, F.col(c).cast("double"))).alias(f"a_{c}") for c in columns]
    other = [F.max(F.when(is_blind, F.col(c).cast("double"))).alias(f"b_{c}") for c in columns]
    pairs = built.groupBy(key.alias("Store"), "Date").agg(*own, *other)
    counts = [
        F.struct(
            F.lit(c).alias("feature"),
            F.count(F.lit(1)).alias("rows"),
            F.count_if(_unequal(F.col(f"a_{c}"), F.col(f"b_{c}"), rtol, atol)).alias("rows_differ"),
        )
        for c in columns
    ]
    return (
        pairs.agg(F.array(*counts).alias("c"))
        .select(F.explode("c").alias("c"))
        .select("c.*", (F.try_divide("c.rows_differ", "c.rows") * 100).alias("pct_differ"))
    )


def _correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient over pairs without NULL; NULL if either side is constant.

    The built-in ``corr`` fails on a constant side in ANSI mode.
    """
    x, y = F.when(F.isnotnull(y), x), F.when(F.isnotnull(x), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def target_correlation(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of each column with same-day sales; near 1 the target leaked in."""
    sales = F.col("Sales").cast("double")
    pairs = [
        F.struct(F.lit(c).alias("feature"), _correlation(sales, F.col(c).cast("double")).alias("corr"))
        for c in columns
    ]
    return (
        df.agg(F.array(*pairs).alias("c")).select(F.explode("c").alias("c")).select("c.feature", "c.corr")
    )


def strongest(correlations: DataFrame) -> DataFrame:
    return correlations.agg(
        F.max_by("feature", F.abs("corr")).alias("feature"), F.max(F.abs("corr")).alias("abs_corr")
    )


def skew_report(
    offline: DataFrame, serving: DataFrame, columns: list[str], tolerance: float = 1e-6, key: list[str] = KEY
) -> DataFrame:
    """Rows on which two paths disagree, per column, over the keys both hold.

    Tables that are bucketed by ``key`` are compared where they lie.
    """
    pairs = _paired(offline, serving, columns, key)
    counts = []
    for c in columns:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        counts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(F.lit(1)).alias("rows"),
                F.count_if(_unequal(a, b, 0.0, tolerance)).alias("rows_differ"),
                F.max(F.abs(a - b)).alias("max_diff"),
            )
        )
    return pairs.agg(F.array(*counts).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def worst_disagreements(offline: DataFrame, serving: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The ``k`` rows on which two paths differ most."""
    pairs = _paired(offline, serving, [column])
    return (
        pairs.select(
            *KEY,
            F.col(f"a_{column}").alias("offline"),
            F.col(f"b_{column}").alias("serving"),
            F.abs(F.col(f"a_{column}") - F.col(f"b_{column}")).alias("diff"),
        )
        .orderBy(F.desc("diff"), *KEY)
        .limit(k)
    )


def submission_report(submission: DataFrame, expected: DataFrame) -> DataFrame:
    """Ids missing, added or repeated against the expected ones, and NULL forecasts.

    One aggregation over both id lists; everything but the two counts must be zero.
    """
    ids = submission.select("Id", F.lit(1).alias("s"), F.lit(0).alias("e"), F.isnull("Sales").alias("n"))
    want = expected.select("Id", F.lit(0).alias("s"), F.lit(1).alias("e"), F.lit(False).alias("n"))
    per_id = ids.unionByName(want).groupBy("Id").agg(
        F.sum("s").alias("s"), F.sum("e").alias("e"), F.count_if("n").alias("n")
    )
    return per_id.agg(
        F.sum("s").alias("rows"),
        F.sum("e").alias("expected_rows"),
        F.count_if(F.col("s") == 0).alias("missing_ids"),
        F.count_if(F.col("e") == 0).alias("extra_ids"),
        F.count_if(F.col("s") > 1).alias("repeated_ids"),
        F.sum("n").alias("null_forecasts"),
    )


def require_sound(report: DataFrame, empty_rows: DataFrame) -> None:
    """Raise if a submission's report counts a fault or a row without features."""
    counts = report.first().asDict()
    faults = {k: n for k, n in counts.items() if k not in ("rows", "expected_rows") and n}
    n_empty = empty_rows.count()
    if n_empty:
        faults["rows_without_features"] = n_empty
    if faults:
        raise ValueError("; ".join(f"{n} {k}" for k, n in faults.items()))


def rows_without_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows in which every feature is NULL."""
    empty = F.lit(True)
    for f in features:
        empty = empty & F.isnull(f)
    return df.where(empty)
