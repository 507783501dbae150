"""Global order statistics without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.sources.staging import stage

PART, BEFORE = "_part", "_before"


def running_totals(df: DataFrame, order: list[str], weight: Column, name: str) -> DataFrame:
    """Add the running total of ``weight`` over all rows in ``order``.

    Rows are range-partitioned, totalled within their partition, and shifted by the
    total of the partitions before. The only one-task step sees one row per
    partition. ``order`` must identify a row. The range-partitioned rows are staged
    because both passes over them must see the same partitions.
    """
    ranged = df.withColumn("_weight", weight.cast("long")).repartitionByRange(*order)
    staged = stage(ranged.withColumn(PART, F.spark_partition_id()), "ranged")
    totals = staged.groupBy(PART).agg(F.sum("_weight").alias("_total"))
    earlier = Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(PART, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias(BEFORE))
    within = Window.partitionBy(PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        staged.withColumn(name, F.sum("_weight").over(within))
        .join(offsets, PART)
        .withColumn(name, F.col(name) + F.col(BEFORE))
        .drop(PART, BEFORE, "_weight")
    )


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: list[str] | None = None
) -> DataFrame:
    """Exact interpolated quantiles of any number of rows, one output row per group.

    Equal values are counted first, with map-side combining; the order statistics are
    then read off a running total of the counts, so no task holds a whole group.
    """
    by = by or []
    counts = df.where(F.isnotnull(value)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    totals = running_totals(counts, [*by, value], F.col("_n"), "_end")
    extent = totals.groupBy(*by).agg(
        F.sum("_n").alias("_size"), F.min(F.col("_end") - F.col("_n")).alias("_start")
    )
    if by:
        placed = totals.join(extent, by)
    else:
        placed = totals.withColumn("_size", extent.select("_size").scalar()).withColumn(
            "_start", extent.select("_start").scalar()
        )
    end = F.col("_end") - F.col("_start")
    begin = end - F.col("_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((begin <= rank) & (rank < end), F.col(value)))

    wanted = []
    for name, p in probabilities.items():
        position = F.lit(p) * (F.col("_size") - 1)
        wanted += [
            at(F.floor(position)).alias(f"_lo_{name}"),
            at(F.ceil(position)).alias(f"_hi_{name}"),
            F.max(position - F.floor(position)).alias(f"_w_{name}"),
        ]
    picked = placed.groupBy(*by).agg(*wanted)
    values = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
        for n in probabilities
    ]
    return picked.select(*by, *values)
