"""Run tables: what was fitted, with what, and how it scored."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.scores import METRICS
from shelfcast.sources.schemas import RUN_FEATURES, RUN_METRICS, RUN_TEXT, RUNS
from shelfcast.sources.staging import stage

#: ``runs`` is written last: a run is there once its row is, with all that belongs to it.
TABLES = {
    "run_metrics": RUN_METRICS,
    "run_params": RUN_TEXT,
    "run_tags": RUN_TEXT,
    "run_features": RUN_FEATURES,
    "runs": RUNS,
}


def _append(spark: SparkSession, root: str, table: str, rows: DataFrame) -> None:
    rows.coalesce(1).write.mode("append").parquet(f"{root}/{table}")


def append_run(
    spark: SparkSession,
    root: str,
    name: str,
    params: dict | None = None,
    metrics: dict[str, float] | DataFrame | None = None,
    tags: dict | None = None,
    features: list[tuple[str, float | None]] | None = None,
) -> str:
    """Append one run to the tables under ``root`` and return its id.

    ``metrics`` may be a table (key, value). What a lost append has left behind is never read.
    Appends to one ``root`` follow one another.
    """
    run = uuid.uuid4().hex
    if not isinstance(metrics, DataFrame):
        metrics = spark.createDataFrame([(k, float(v)) for k, v in (metrics or {}).items()], "key string, value double")
    text = {t: [(run, k, str(v)) for k, v in (x or {}).items()] for t, x in (("run_params", params), ("run_tags", tags))}
    rows = {
        "run_metrics": metrics.select(F.lit(run).alias("run_uuid"), "key", "value"),
        **{t: spark.createDataFrame(x, RUN_TEXT) for t, x in text.items()},
        "run_features": spark.createDataFrame([(run, i, f, gain) for i, (f, gain) in enumerate(features or [])], RUN_FEATURES),
        "runs": spark.createDataFrame([(run, name)], RUNS),
    }
    for table in TABLES:
        _append(spark, root, table, rows[table])
    return run


def log_holdout(
    spark: SparkSession, root: str, scores: DataFrame, params: dict, name: str = "sealed windows"
) -> str:
    """Append the scores of the held-out windows as a run: a metric for each window, label and column."""
    numbers = [c for c in scores.columns if c not in ("split", "label")]
    long = scores.unpivot(["split", "label"], [F.col(c).cast("double").alias(c) for c in numbers], "measure", "value")
    metrics = long.select(F.concat_ws("/", "split", "label", "measure").alias("key"), "value").where(F.isnotnull("value"))
    return append_run(spark, root, name, params, metrics, {"windows": "held out"})


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A table's rows of all runs that were appended whole."""
    rows = spark.read.schema(TABLES[table]).parquet(f"{root}/{table}")
    if table == "runs":
        return rows
    return rows.join(read_table(spark, root, "runs").select("run_uuid"), "run_uuid", "left_semi")


def runs_of_scores(scores: DataFrame, prefix: str = "valid_") -> tuple[DataFrame, DataFrame]:
    """The runs and run_metrics rows of a score table with one row per label."""
    keyed = scores.withColumn("run_uuid", F.md5("label"))
    pairs = [F.struct(F.lit(prefix + m).alias("key"), F.col(m).alias("value")) for m in METRICS]
    metrics = keyed.select("run_uuid", F.explode(F.array(*pairs)).alias("p")).select(
        "run_uuid", "p.key", "p.value"
    )
    return keyed.select("run_uuid", F.col("label").alias("name")), metrics


def run_values(runs: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Name and value of one metric over all runs."""
    logged = metrics.where(F.col("key") == key).select("run_uuid", "key", "value")
    return runs.select("run_uuid", "name").join(logged, "run_uuid").drop("run_uuid")


def noise_floor(values: DataFrame, seeds: list[str]) -> DataFrame:
    """How far the score moves when nothing but the seed does."""
    return values.where(F.col("name").isin(seeds)).agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        (F.max("value") - F.min("value")).alias("range"),
    )


def against_noise(values: DataFrame, seeds: list[str], variants: list[str]) -> DataFrame:
    """Each variant's value and whether it lies inside the band of the seed runs."""
    values = stage(values, "values")  # read twice, computed once
    value = F.col("value")
    band = values.where(F.col("name").isin(seeds)).agg(F.min("value").alias("low"), F.max("value").alias("high"))
    inside = value.between(band.select("low").scalar(), band.select("high").scalar())
    return (
        values.where(F.col("name").isin(variants))
        .select("name", "value", inside.alias("inside_band"))
        .orderBy("value", "name")
    )


def ablation_table(scores: DataFrame, baseline: str, reference: str = "full") -> DataFrame:
    """Scores per variant, the change against ``reference`` and the gain over the baseline."""
    scores = stage(scores, "scores")  # read twice, computed once
    mape, label = F.col("mape"), F.col("label")
    picked = scores.agg(
        F.max(F.when(label == reference, mape)).alias("full"), F.max(F.when(label == baseline, mape)).alias("base")
    )
    full, base = picked.select("full").scalar(), picked.select("base").scalar()
    return scores.where(label != baseline).select(
        label.alias("name"),
        *METRICS,
        (mape - full).alias("mape_vs_full"),
        ((1 - F.try_divide(mape, base)) * 100).alias("improve_vs_baseline_pct"),
    )


def logged_scores(runs: DataFrame, metrics: DataFrame, prefix: str = "valid_") -> DataFrame:
    """A score row for each run, labelled with its name, from the run tables."""
    own = metrics.where(F.col("key").isin([prefix + m for m in METRICS]))
    columns = [F.max(F.when(F.col("key") == prefix + m, F.col("value"))).alias(m) for m in METRICS]
    return runs.join(own, "run_uuid").groupBy("run_uuid", F.col("name").alias("label")).agg(*columns).drop("run_uuid")
