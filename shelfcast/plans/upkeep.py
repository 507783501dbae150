"""A feature table on disk that is kept up with its sources.

With the table stands a record of what it was made from: a digest of each day of the facts, one of
the stores and one of the settings. When days are added or changed, only the days whose frames read
them are built anew and swapped in; when anything else changed, all are. The record is appended
last, so a refresh that was cut short is done again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.plans.features import features_between
from shelfcast.sources.staging import stage
from shelfcast.spec import PanelSpec

#: The folders below a split.
MONTH = "in_month"
RECORD = "version long, source string, Date date, n long, digest decimal(38,0)"


def _digest(df: DataFrame) -> tuple[Column, Column]:
    """Number of rows and an order-free digest of them."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)]).cast("decimal(38,0)")
    return F.count(F.lit(1)).alias("n"), F.sum(row).alias("digest")


def source_record(facts: DataFrame, stores: DataFrame, spec: PanelSpec) -> DataFrame:
    """(source, Date, n, digest): a row for each day of the facts, one for the stores, one for the settings.

    Only stores that have facts count: the others are in no feature. Days are summed before the shuffle.
    """
    held = stores.join(facts.select("Store").distinct(), "Store", "left_semi")
    none = F.lit(None).cast("date")
    settings = facts.sparkSession.range(1).select(
        F.lit("settings"), none, F.lit(1), F.xxhash64(F.lit(repr(spec))).cast("decimal(38,0)")
    )
    days = facts.groupBy("Date").agg(*_digest(facts)).select(F.lit("facts").alias("source"), "Date", "n", "digest")
    return days.union(held.agg(*_digest(held)).select(F.lit("stores"), none, "n", "digest")).union(settings)


def last_record(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest record of the table at ``path``; None where there is no table."""
    try:
        records = spark.read.schema(RECORD).parquet(f"{path}/record")
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return records.where(F.col("version") == records.agg(F.max("version")).scalar())


def changed_days(old: DataFrame, new: DataFrame) -> tuple[dt.date, dt.date] | None | bool:
    """First and last changed or added day; None if there is none, True if all has to be built."""
    keyed = [F.col(f"{s}.{c}") for s in "ab" for c in ("source", "Date")]
    same = keyed[0].eqNullSafe(keyed[2]) & keyed[1].eqNullSafe(keyed[3])
    both = old.alias("a").join(new.alias("b"), same, "full")
    differs = ~(F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.digest").eqNullSafe(F.col("b.digest")))
    is_day = F.coalesce("b.source", "a.source") == "facts"
    found = both.agg(
        F.coalesce(F.bool_or(differs & (~is_day | F.isnull("b.source"))), F.lit(False)).alias("all"),
        F.min(F.when(differs & is_day, F.col("b.Date"))).alias("first"),
        F.max(F.when(differs & is_day, F.col("b.Date"))).alias("last"),
    ).first()
    if found["all"]:
        return True
    return None if found["first"] is None else (found["first"], found["last"])


def days_to_build(first: dt.date, last: dt.date, spec: PanelSpec) -> tuple[dt.date, dt.date]:
    """The days whose features may read days ``first``..``last``, as whole months."""
    first -= dt.timedelta(days=spec.look_ahead)
    last += dt.timedelta(days=spec.look_back)
    after = (last.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
    return first.replace(day=1), after - dt.timedelta(days=1)


def refreshed(spark: SparkSession, path: str, facts: DataFrame, stores: DataFrame, spec: PanelSpec) -> DataFrame:
    """The feature table at ``path``, first built or brought up to date with its sources.

    Files lie by split and month, so a scan of a split or of some days reads only theirs, and what is
    built anew takes the place of whole folders. A day that lost all of its facts, other stores or
    other settings make the whole table anew. One refresh of a path at a time.
    """
    new = stage(source_record(facts, stores, spec), "record")
    old = last_record(spark, path)
    days = True if old is None else changed_days(old, new)
    if days is not None:
        span = new.where("source = 'facts'").agg(F.min("Date"), F.max("Date")).first()
        low, high = days_to_build(*((span[0], span[1]) if days is True else days), spec)
        rows = features_between(facts, stores, low, high, spec).drop("Customers")
        mode = "static" if days is True else "dynamic"
        month = (F.year("Date") * 100 + F.month("Date")).alias(MONTH)
        out = rows.select("*", month).repartition(MONTH).write.mode("overwrite").option("partitionOverwriteMode", mode)
        out.partitionBy("split", MONTH).parquet(f"{path}/features")
        version = F.lit(0 if old is None else old.agg(F.max("version")).first()[0] + 1).cast("long").alias("version")
        new.select(version, "source", "Date", "n", "digest").coalesce(1).write.mode("append").parquet(f"{path}/record")
    return spark.read.parquet(f"{path}/features").drop(MONTH)
