"""Error tables: any number of forecasts and splits in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.targets import closed_rule, mape, rmse, rmspe, scored, wape

METRICS = ("rmse", "mape", "wape")


def long_forecasts(df: DataFrame, forecasts: dict[str, str], closed: bool = True) -> DataFrame:
    """One row per forecast: ``forecasts`` maps a label to the column that holds it."""
    pairs = []
    for label, column in forecasts.items():
        value = F.col(column).cast("double")
        value = closed_rule(value, F.col("Open")) if closed else value
        pairs.append(F.struct(F.lit(label).alias("label"), value.alias("pred")))
    rest = [c for c in df.columns if c not in forecasts.values()]
    return df.select(*rest, F.explode(F.array(*pairs)).alias("_f")).select(*rest, "_f.label", "_f.pred")


def evaluate(
    forecasts: DataFrame,
    by: tuple[str, ...] = ("label",),
    actual: str = "Sales",
    is_open: str | None = "Open",
    scale: int = 1,
) -> DataFrame:
    """Rows scored, RMSE, MAPE and WAPE per group."""
    y, p = F.col(actual), F.col("pred")
    keep = scored(y, None if is_open is None else F.col(is_open))
    return forecasts.groupBy(*by).agg(
        F.count_if(keep).alias("n_scored"),
        rmse(y, p, keep, scale).alias("rmse"),
        mape(y, p, keep).alias("mape"),
        wape(y, p, keep).alias("wape"),
    )


def relative_error(forecasts: DataFrame, by: tuple[str, ...] = ("label",)) -> DataFrame:
    return forecasts.groupBy(*by).agg(
        F.count_if(F.col("Sales") > 0).alias("n_scored"),
        rmspe(F.col("Sales"), F.col("pred")).alias("rmspe"),
    )


def improvement(scores: DataFrame, baseline: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Percent by which each row beats the row labelled ``baseline`` of its group.

    Scores have one row per forecast and group, so the window holds a few rows.
    """
    group = Window.partitionBy(*by)
    gains = {}
    for m in METRICS:
        base = F.max(F.when(F.col("label") == baseline, F.col(m))).over(group)
        gains[f"improvement_{m}_pct"] = (1 - F.try_divide(F.col(m), base)) * 100
    return scores.withColumns(gains)


def headline(scores: DataFrame, model: str, baseline: str) -> DataFrame:
    """One row per metric: baseline, model and the drop in percent."""
    def pick(label: str, metric: str):
        return F.max(F.when(F.col("label") == label, F.col(metric)))

    row = scores.agg(
        F.array(
            *[
                F.struct(
                    F.lit(m).alias("metric"),
                    pick(baseline, m).alias("baseline"),
                    pick(model, m).alias("model"),
                )
                for m in METRICS
            ]
        ).alias("rows")
    )
    return row.select(F.explode("rows").alias("r")).select(
        "r.metric",
        "r.baseline",
        "r.model",
        ((1 - F.try_divide(F.col("r.model"), F.col("r.baseline"))) * 100).alias("drop_pct"),
    )


def in_label_order(scores: DataFrame, labels: list[str]) -> DataFrame:
    """Rows in the order of ``labels``, others last."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("label"))
    return scores.orderBy(F.when(place == 0, F.lit(len(labels) + 1)).otherwise(place), "label")
