"""Categorical encoding by a frozen, ordered vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.operators.ordering import running_totals
from shelfcast.operators.selection import CATEGORICAL
from shelfcast.sources.schemas import VOCABULARY

#: Entries of a column that are broadcast, some 50 bytes each.
SMALL_DOMAIN = 10_000


def _is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)


def build_vocabulary(df: DataFrame, columns: tuple[str, ...] = CATEGORICAL) -> DataFrame:
    """(column, number, text, code): code is the place among the sorted distinct values.

    Values keep their type, so 2 comes before 10. A column may have any number of
    values: places come from a distributed running count.
    """
    entries = []
    for c in columns:
        text = _is_text(df, c)
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                (F.lit(None) if text else F.col(c)).cast("long").alias("number"),
                (F.col(c) if text else F.lit(None)).cast("string").alias("text"),
            )
        )
    values = (
        df.select(F.explode(F.array(*entries)).alias("e"))
        .select("e.*")
        .where(F.isnotnull("number") | F.isnotnull("text"))
        .distinct()
    )
    placed = running_totals(values, ["column", "number", "text"], F.lit(1), "place")
    # One row per categorical column.
    starts = placed.groupBy("column").agg(F.min("place").alias("first"))
    return placed.join(F.broadcast(starts), "column").select(
        "column", "number", "text", (F.col("place") - F.col("first")).alias("code")
    )


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VOCABULARY).parquet(path)


def add_codes(df: DataFrame, vocabulary: DataFrame, columns: tuple[str, ...] = CATEGORICAL) -> DataFrame:
    """Add ``<column>_code``; a value outside the vocabulary gets NULL.

    A column's entries are counted first (one number per categorical column comes back):
    up to SMALL_DOMAIN of them are broadcast, so that a value which nearly all rows share
    moves no rows. Larger domains are joined by size and skew as Spark sees fit.
    """
    sizes = {r["column"]: r["count"] for r in vocabulary.groupBy("column").count().collect()}
    for c in columns:
        key = "text" if _is_text(df, c) else "number"
        lookup = vocabulary.where(F.col("column") == c).select(
            F.col(key).alias(f"_{c}"), F.col("code").alias(f"{c}_code")
        )
        if sizes.get(c, 0) <= SMALL_DOMAIN:
            lookup = F.broadcast(lookup)
        df = df.join(lookup, F.col(c) == F.col(f"_{c}"), "left").drop(f"_{c}")
    return df


def outside_vocabulary(
    df: DataFrame, vocabulary: DataFrame, columns: tuple[str, ...] = CATEGORICAL
) -> DataFrame:
    """Rows per column whose value the vocabulary does not have."""
    coded = add_codes(df.select(*columns), vocabulary, columns)
    counts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count_if(F.isnotnull(c) & F.isnull(f"{c}_code")).alias("rows_outside"),
        )
        for c in columns
    ]
    return (
        coded.agg(F.array(*counts).alias("c"))
        .select(F.explode("c").alias("c"))
        .select("c.column", "c.rows_outside")
    )


def require_known(df: DataFrame, vocabulary: DataFrame, columns: tuple[str, ...] = CATEGORICAL) -> None:
    """Raise if a value is not in the vocabulary."""
    outside = outside_vocabulary(df, vocabulary, columns).where("rows_outside > 0").collect()
    if outside:
        found = ", ".join(f"{r['rows_outside']} of '{r['column']}'" for r in outside)
        raise ValueError(f"values outside the vocabulary: {found}")


def encode(
    df: DataFrame,
    vocabulary: DataFrame,
    columns: tuple[str, ...] = CATEGORICAL,
    strict: bool = True,
) -> DataFrame:
    """Add codes; ``strict`` first counts the values outside and refuses any."""
    if strict:
        require_known(df, vocabulary, columns)
    return add_codes(df, vocabulary, columns)


def vocabulary_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Entries or codes that only one of two vocabularies has; empty when they agree."""
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    only_right = right.exceptAll(left).withColumn("side", F.lit("right"))
    return only_left.unionByName(only_right)
