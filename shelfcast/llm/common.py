"""Small helpers shared by the operators: tables, staged copies, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.sources.staging import stage

__all__ = ["Chunks", "batch_of", "bucket_count", "chunked", "components", "return_to_chunks", "rows_of", "stage", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    """A record batch from row tuples."""
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str, step: int = 256) -> Iterator[tuple]:
    """Rows of the named columns; a few at a time become Python objects."""
    for b in batches:
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            yield from zip(*(part.column(n).to_pylist() for n in names), strict=True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected ``edges`` (a, b).

    The component is its smallest node. Alternates two contractions until nothing moves:
    every node's larger neighbours, then its smaller ones, are tied to the smallest node
    next to it. Each round groups by node with sums that combine before the shuffle (min)
    and a join whose hot keys AQE splits; no adjacency list is gathered. Rounds are cut by
    staged tables.
    """
    links = stage(
        edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u"))
        .where("u < v")
        .distinct(),
        "links",
    )
    while True:
        # Large star: each node's larger neighbours go to its smallest neighbour or itself.
        both = links.union(links.select("u", "v").toDF("v", "u"))
        low = both.groupBy("v").agg(F.min("u").alias("low"))
        low = low.select("v", F.least("v", "low").alias("low"))
        large = (
            both.where("u > v").join(low, "v").select(F.col("u").alias("v"), F.col("low").alias("u"))
        ).where("u < v").distinct()
        # Small star: each node's smaller neighbours, and the node, go to the smallest of them.
        large = stage(large, "large")
        least = large.groupBy("v").agg(F.min("u").alias("low"))
        joined = large.join(least, "v")
        small = joined.select(F.col("u").alias("v"), F.col("low").alias("u")).union(
            joined.select("v", F.col("low").alias("u"))
        )
        small = stage(small.where("u < v").distinct(), "links")
        moved = small.exceptAll(links).limit(1).count() + links.exceptAll(small).limit(1).count()
        links = small
        if not moved:
            break
    stars = links.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return stars.union(stars.select("component", "component").distinct().toDF("node", "component"))


def chunked(docs: DataFrame, path: str, chunk_bits: int) -> DataFrame:
    """``docs`` written to ``path`` with a fixed row number and the chunk it falls in."""
    row = F.monotonically_increasing_id()
    kept = docs.withColumn("row", row).withColumn("chunk", F.shiftright("row", chunk_bits))
    kept.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(kept.schema).parquet(path)


def bucket_count(spark: SparkSession, n_bytes: int) -> int:
    """Buckets for what goes back to the chunks of a table: one for 256 MB of it, the session's number at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_bytes >> 28)


def return_to_chunks(rows: DataFrame, path: str, buckets: int) -> None:
    """Writes ``rows`` (chunk, ..) so that a chunk's are together in a file of its bucket, for ``Chunks`` to read."""
    chunk = F.col("chunk")
    bucket = F.pmod(F.shiftright(chunk, 20) * 31 + chunk.bitwiseAND(F.lit(0xFFFFF)), F.lit(buckets))
    # Buckets are numbers of partitions, so a task writes exactly one.
    numbered = rows.withColumn("bucket", bucket.cast("int"))
    dealt = numbered.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "chunk")
    dealt.write.partitionBy("bucket").parquet(path)


class Chunks:
    """Reads, inside tasks, what ``return_to_chunks`` wrote for one chunk."""

    def __init__(self, path: str, buckets: int):
        self.files, self.base = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.buckets = buckets

    def load(self, chunk: int) -> pa.Table | None:
        bucket = ((chunk >> 20) * 31 + (chunk & 0xFFFFF)) % self.buckets
        place = f"{self.base}/bucket={bucket}"
        if self.files.get_file_info(place).type == pyarrow.fs.FileType.NotFound:
            return None
        return pads.dataset(place, filesystem=self.files, format="parquet").to_table(filter=pads.field("chunk") == chunk)
