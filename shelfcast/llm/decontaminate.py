"""Benchmark decontamination (operator 7): prefix-filtered join with exact windows, DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import stage, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class DecontaminationParams:
    """Words of a window, words of the shingles that are joined, and the most shingle hashes (of
    8 bytes) that are broadcast; more are joined by a shuffle."""

    window: int = 10
    shingle: int = 3
    broadcast_keys: int = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z) words; null has none."""
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_A_WORD)
    return F.array_remove(parts, "")


def _key(words_: Column, start: Column, length: int) -> Column:
    """Hash of ``length`` words from ``start`` (0-based); what it finds is verified word by word."""
    return F.xxhash64(F.lit(length), *[F.get(words_, start + i) for i in range(length)])


def _small(keys: DataFrame, params: DecontaminationParams) -> DataFrame:
    """``keys``, a written column of longs, marked for broadcast if their number is within the bound."""
    return F.broadcast(keys) if keys.count() <= params.broadcast_keys else keys


def _item_windows(benchmark: DataFrame, params: DecontaminationParams) -> tuple[DataFrame, DataFrame]:
    """(windows: window_id, body, size), (owners: window_id, item_id); equal windows are one."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(params.window))
    each = items.select("item_id", "w", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("w") - size)).alias("at"))
    each = each.select("item_id", "size", F.slice("w", F.col("at") + 1, F.col("size")).alias("body"))
    each = each.withColumn("window_id", F.sha2(F.array_join("body", " "), 256))
    owners = each.select("window_id", "item_id").distinct()
    return stage(each.select("window_id", "size", "body").dropDuplicates(["window_id"]), "windows"), stage(owners, "owners")


def _shingles(windows: DataFrame, params: DecontaminationParams) -> DataFrame:
    """(window_id, length, at, key): every shingle of every window."""
    found = []
    for length in range(1, params.shingle + 1):
        fits = F.col("size") >= length if length == params.shingle else F.col("size") == length
        at = windows.where(fits).select("window_id", "body", F.explode(F.sequence(F.lit(0), F.col("size") - length)).alias("at"))
        found.append(at.select("window_id", F.lit(length).alias("length"), "at", _key(F.col("body"), F.col("at"), length).alias("key")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _positions(texts: DataFrame, lengths: list[int]) -> DataFrame:
    """``texts`` (.., w, n_words) with one row for each place and shingle length: at, key."""
    each = texts.where("n_words > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n_words") - 1)).alias("at"))
    at, size = F.col("at"), F.col("n_words")
    if len(lengths) == 1:
        return each.where(at + lengths[0] <= size).select("*", _key(F.col("w"), at, lengths[0]).alias("key"))
    keys = F.array(*[F.when(at + n <= size, _key(F.col("w"), at, n)) for n in lengths])
    return each.select("*", F.explode(keys).alias("key")).where(F.col("key").isNotNull())


def _near(texts: DataFrame, lengths: list[int], needed: DataFrame, params: DecontaminationParams) -> DataFrame:
    """(doc_id, t1, t2, n_words, at, key, left, around): places with a key of ``needed``, and the words around.

    Up to the bound the keys are broadcast and nothing moves. Beyond it a place moves as its hash and
    its text's fingerprint, without words; only places that are found go back to their texts for the
    words around them, and a text moves once.
    """
    left = F.least("at", F.lit(params.window - 1))
    around = F.slice("w", F.col("at") - left + 1, left + params.window)
    columns = ["doc_id", "t1", "t2", "n_words", "at", "key", left.alias("left"), around.alias("around")]
    places = _positions(texts, lengths)
    if needed.count() <= params.broadcast_keys:
        return places.join(F.broadcast(needed), "key").select(*columns)
    moved = places.select(F.col("doc_id").alias("in_id"), F.col("t1").alias("in_1"), F.col("t2").alias("in_2"), "at", "key")
    met = moved.join(needed, "key")
    same = F.col("doc_id").eqNullSafe(F.col("in_id")) & (F.col("t1") == F.col("in_1")) & (F.col("t2") == F.col("in_2"))
    return texts.dropDuplicates(["doc_id", "t1", "t2"]).join(met, same).select(*columns)


def occurrences(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> tuple[DataFrame, DataFrame]:
    """(found: doc_id, t1, t2, at, size, window_id), (owners: window_id, item_id).

    t1 and t2 fingerprint a text, so rows without an id, or that share one, are told apart.
    Shingles of the windows are ordered by how rarely documents hold them. A window is in a
    text only if all its shingles are, so the prefix that has to be joined is its rarest
    shingle. The shingle's place in the window gives the only start it can have in the
    text; windows that would begin before the text or end after it are dropped by length
    and place, and the rest are compared word by word.
    """
    windows, owners = _item_windows(benchmark, params)
    shingles = stage(_shingles(windows, params), "window-shingles")
    lengths = sorted(r.length for r in shingles.select("length").distinct().collect())  # 3 at most
    texts = docs.select("doc_id", *_marks(), words(F.col("text")).alias("w")).withColumn("n_words", F.size("w"))
    found_schema = "doc_id", "t1", "t2"
    if not lengths:
        lengths = [params.shingle]
    # Rarity: a count for each shingle of the benchmark over all documents, summed in the tasks first.
    asked = stage(shingles.select("key").distinct(), "shingle-keys")
    held = _positions(texts.select("w", "n_words"), lengths).select("key")
    counts = held.join(_small(asked, params), "key").groupBy("key").count()
    ranked = shingles.join(counts, "key", "left").fillna(0, ["count"])
    # Windows with a shingle that no document holds are in none.
    prefix = ranked.groupBy("window_id").agg(F.min(F.struct("count", "at", "key")).alias("p")).where("p.count > 0")
    prefix = prefix.join(windows, "window_id").select("window_id", "size", "body", F.col("p.key").alias("key"), F.col("p.at").alias("shift"))
    prefix = stage(prefix, "prefixes")
    needed = stage(prefix.select("key").distinct(), "prefix-keys")
    near = _near(texts, lengths, needed, params)
    start = F.col("at") - F.col("shift")
    found = (
        near.join(prefix, "key")
        .where((start >= 0) & (start + F.col("size") <= F.col("n_words")))
        .where(F.slice("around", F.greatest(F.lit(1), F.col("left") - F.col("shift") + 1), F.col("size")) == F.col("body"))
        .select(*found_schema, start.alias("at"), "size", "window_id")
    )
    return stage(found, "occurrences"), owners


def _marks() -> list[Column]:
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2")]


def contamination(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, for each row of ``docs``.

    Null texts have no words; items without words have no windows; items shorter than a
    window are one. Repeated rows give repeated results. An item whose id is null counts
    for ``n_hit`` but, having no name, neither for ``n_items`` nor the digest. Items with the same
    window all count. Texts are read whole, whatever their length. An empty table of documents
    gives no rows, an empty benchmark no hits. Other columns are ignored.
    """
    hits = _hits(docs, benchmark, params)
    base = docs.select("doc_id", *_marks(), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    same = base["doc_id"].eqNullSafe(hits["h_id"]) & (base["t1"] == hits["h1"]) & (base["t2"] == hits["h2"])
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return base.join(hits, same, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(items), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _hits(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams) -> DataFrame:
    """(h_id, h1, h2, n_hit, items) of contaminated texts."""
    found, owners = occurrences(docs, benchmark, params)
    keys = ["doc_id", "t1", "t2"]
    # Starts of one text, in order: a window hits its words up to where the next one begins.
    spans = found.select(*keys, "at", (F.col("at") + F.col("size")).alias("end")).groupBy(*keys, "at").agg(F.max("end").alias("end"))
    starts = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "end"))).alias("s"))
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["at"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["end"]).alias("to")
    )
    n_hit = F.aggregate("s", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step)["n"]
    items = found.select(*keys, "window_id").distinct().join(owners, "window_id").groupBy(*keys).agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    both = starts.select(*[F.col(k).alias(f"s_{k}") for k in keys], n_hit.alias("n_hit")).join(
        items,
        F.col("s_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("s_t1") == F.col("t1")) & (F.col("s_t2") == F.col("t2")),
    )
    return both.select(F.col("s_doc_id").alias("h_id"), F.col("s_t1").alias("h1"), F.col("s_t2").alias("h2"), "n_hit", "items")


def clean(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, with all their columns.

    Null and empty texts hold none; repeated rows stay or go together.
    """
    found, _ = occurrences(docs, benchmark, params)
    hit = found.select(F.col("doc_id").alias("_hit_id"), F.col("t1").alias("_hit_1"), F.col("t2").alias("_hit_2")).distinct()

    same = docs["doc_id"].eqNullSafe(hit["_hit_id"]) & (F.xxhash64(docs["text"]) == hit["_hit_1"]) & (F.xxhash64(F.lit("second"), docs["text"]) == hit["_hit_2"])
    return docs.join(hit, same, "left_anti")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS body
  FROM (SELECT item_id, w, least(len(w), 10) AS size, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, s.size AS size, array_to_string(list_slice(w, i, i + s.size - 1), ' ') AS body
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN (SELECT DISTINCT size FROM bw) s
  WHERE i + s.size - 1 <= len(w)),
hit AS (SELECT dw.doc_id, dw.i, dw.size, bw.item_id FROM dw JOIN bw ON dw.size = bw.size AND dw.body = bw.body),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""
