"""CSV and Parquet readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.operators.checks import require_sound, rows_without_features, submission_report
from shelfcast.sources.schemas import FACTS, FUTURE, STORES
from shelfcast.sources.staging import stage


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("dateFormat", "yyyy-MM-dd")
        .option("mode", "FAILFAST")
        .csv(path)
    )


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """Daily facts; the holiday code stays text, so '0' and 'a' are one type."""
    return _csv(spark, path, FACTS)


def read_stores(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, STORES)


def read_future(spark: SparkSession, path: str) -> DataFrame:
    """Published calendar rows, as read: ``Id`` kept, ``Open`` possibly NULL."""
    return _csv(spark, path, FUTURE)


def future_rows(future: DataFrame) -> DataFrame:
    """Future calendar in the shape of facts: open unless told otherwise, sales unknown."""
    return (
        future.drop("Id")
        .withColumn("Open", F.coalesce("Open", F.lit(1)))
        .withColumn("Sales", F.lit(None).cast("long"))
    )


def extended_history(facts: DataFrame, future: DataFrame) -> DataFrame:
    """History and future calendar as one table, matched by column name."""
    return facts.drop("Customers").unionByName(future_rows(future), allowMissingColumns=True)


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_serving_table(serving: DataFrame, path: str) -> None:
    """Range-cluster by store and date: a request for one store prunes by min/max."""
    (
        serving.repartitionByRange("store_key", "Date")
        .sortWithinPartitions("store_key", "Date")
        .write.mode("overwrite")
        .parquet(path)
    )


def publish_submission(
    submission: DataFrame, expected: DataFrame, features: DataFrame, names: list[str], path: str
) -> None:
    """Write a submission to ``path`` once its checks have passed; else raise and leave nothing there.

    The rows are written aside and judged as written: every expected id once, no forecast missing,
    and no row of ``features`` without any of ``names``.
    """
    aside = stage(submission.select("Id", "Sales"), "submission")
    require_sound(submission_report(aside, expected), rows_without_features(features, names))
    write_submission(aside, path)


def write_submission(submission: DataFrame, path: str) -> None:
    """CSV of ``Id, Sales`` ordered by Id over all part files, two decimals."""
    (
        submission.select("Id", F.format_string("%.2f", F.col("Sales").cast("double")).alias("Sales"))
        .orderBy("Id")
        .write.mode("overwrite")
        .option("header", True)
        .csv(path)
    )
