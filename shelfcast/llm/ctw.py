"""LM scoring (operator 5): context-tree weighting over bytes, and a word model as a base.

Every byte is eight binary decisions. Each decision has a tree of contexts, the bytes
before it; a node's Krichevsky-Trofimov estimate is mixed with that of its children, so
that all depths weigh in. Counts come from the training documents only.

Documents are cut into chunks. A chunk's distinct words and byte strings go out once, get
their totals or probabilities, and come back to the chunk, so what is shuffled grows with
the distinct entries of chunks and not with the text.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import Chunks, chunked, return_to_chunks, rows_of, stage, table
from shelfcast.sources.staging import stage_path

#: Bytes before a byte that are its context.
DEPTH = 3
#: In no UTF-8 text; stands before the first byte and after the last.
EDGE = 255


@dataclass(frozen=True)
class CtwParams:
    """Documents whose crc32 of the id leaves ``held_out`` modulo ``folds`` are not learned from; rows of a chunk are a power of two."""

    folds: int = 7
    held_out: int = 2
    chunk_bits: int = 13


def grams(text: bytes) -> np.ndarray:
    """Each byte of ``text`` and the end with the DEPTH bytes before it, the byte lowest."""
    padded = np.frombuffer(bytes([EDGE] * DEPTH) + text + bytes([EDGE]), np.uint8).astype(np.uint32)
    n = len(text) + 1
    key = np.zeros(n, np.uint32)
    for i in range(DEPTH + 1):
        key = (key << np.uint32(8)) | padded[i : i + n]
    return key


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0 by Stirling's series from x + 8 on."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    for i in range(8):
        series = series - np.log(x + i)
    return series


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the KT probability of any one sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


def tally(rows: np.ndarray, byte: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(zeros, ones) [size, 256]: counts of each decision (1 to 255) of each of ``size`` contexts."""
    counts = np.zeros((2, size, 256))
    for i in range(8):
        node = (1 << i) | (byte >> (8 - i))
        np.add.at(counts, ((byte >> (7 - i)) & 1, rows, node), n)
    return counts[0], counts[1]


def mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln weighted probability, weight of the own estimate) of nodes whose children's ln sum is ``below``."""
    own = log_kt(zeros, ones)
    return np.logaddexp(own, below) - math.log(2), 1 / (1 + np.exp(np.clip(below - own, -700, 700)))


def estimate(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Probability of a one."""
    return (ones + 0.5) / (zeros + ones + 1.0)


def _deep(keys: np.ndarray, n: np.ndarray):
    """Depths 2 and 3 of the context that ``keys`` share in their two nearest bytes."""
    far, byte = (keys >> 24) & 255, keys & 255
    names, rows = np.unique(far, return_inverse=True)
    z3, o3 = tally(rows, byte, n, len(names))
    z2, o2 = z3.sum(0), o3.sum(0)
    total, weight = mixed(z2, o2, log_kt(z3, o3).sum(0))
    return rows, byte, z3, o3, z2, o2, total, weight


def _summary(group: pd.DataFrame) -> pd.DataFrame:
    """What depth 1 needs of a depth-2 context: its counts and weighted probability for each decision."""
    keys = group["gram"].to_numpy()
    *_, z2, o2, total, _ = _deep(keys, group["n"].to_numpy().astype(float))
    node = np.flatnonzero(z2 + o2)
    near = int(keys[0] >> 8) & 255
    return pd.DataFrame({"near": near, "node": node, "zeros": z2[node], "ones": o2[node], "total": total[node]})


def probabilities(counted: DataFrame) -> DataFrame:
    """(gram, log10p) of every gram of ``counted`` (gram, n), those with n = 0 too.

    A group has two context bytes in common, so it has 2**16 grams at most. The driver
    holds depths 0 and 1: 255 decisions for 256 bytes and for none.
    """
    pair = F.shiftright("gram", 8).bitwiseAND(F.lit(0xFFFF))
    grouped = counted.withColumn("pair", pair)
    deep = grouped.groupBy("pair").applyInPandas(_summary, "near int, node int, zeros double, ones double, total double")
    upper = deep.groupBy("near", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "total")]).toPandas()
    z1, o1, below1 = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    for into, name in ((z1, "zeros"), (o1, "ones"), (below1, "total")):
        into[upper["near"], upper["node"]] = upper[name]
    total1, weight1 = mixed(z1, o1, below1)
    own1 = estimate(z1, o1)
    z0, o0 = z1.sum(0), o1.sum(0)
    _, weight0 = mixed(z0, o0, total1.sum(0))
    own0 = estimate(z0, o0)

    def final(group: pd.DataFrame) -> pd.DataFrame:
        keys = group["gram"].to_numpy()
        rows, byte, z3, o3, z2, o2, _, weight2 = _deep(keys, group["n"].to_numpy().astype(float))
        near = int(keys[0] >> 8) & 255
        one = weight2 * estimate(z2, o2) + (1 - weight2) * estimate(z3, o3)
        one = weight1[near] * own1[near] + (1 - weight1[near]) * one
        one = weight0 * own0 + (1 - weight0) * one
        log10p = np.zeros(len(keys))
        for i in range(8):
            p = one[rows, (1 << i) | (byte >> (8 - i))]
            log10p += np.log10(np.where((byte >> (7 - i)) & 1, p, 1 - p))
        return pd.DataFrame({"gram": keys, "log10p": log10p})

    return stage(grouped.groupBy("pair").applyInPandas(final, "gram long, log10p double"), "probabilities")


ENTRIES = pa.schema([("chunk", pa.int64()), ("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])


def _counted(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts, by a plain sort."""
    values = np.sort(np.concatenate(found))
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[first], np.diff(np.append(first, len(values)))


class Tally:
    """Counts of grams: a bounded part at a time is sorted and counted."""

    PART = 4_000_000

    def __init__(self):
        self.raw, self.size, self.done = [], 0, []

    def add(self, found: np.ndarray) -> None:
        self.raw.append(found)
        self.size += len(found)
        if self.size > self.PART:
            self.fold()

    def fold(self) -> None:
        if self.raw:
            self.done.append(_counted(self.raw))
            self.raw, self.size = [], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        if not self.done:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        gram, which = np.unique(np.concatenate([g for g, _ in self.done]), return_inverse=True)
        return gram, np.bincount(which, np.concatenate([n for _, n in self.done]), len(gram)).astype(np.int64)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's distinct words and grams, with counts of its training documents."""
    current, words, learned, other = None, Counter(), Tally(), Tally()

    def flush():
        chunk_of = lambda n: pa.array(np.full(n, current, np.int64))
        found, counts = list(words), np.fromiter(words.values(), np.int64, len(words))
        for i in range(0, len(found), 50_000):
            part = found[i : i + 50_000]
            yield pa.record_batch([chunk_of(len(part)), pa.array(part, pa.binary()), pa.nulls(len(part), pa.int64()), pa.array(counts[i : i + 50_000])], schema=ENTRIES)
        gram, n = learned.total()
        rest = np.setdiff1d(other.total()[0], gram, assume_unique=True)
        gram, n = np.concatenate([gram, rest]).astype(np.int64), np.concatenate([n, np.zeros(len(rest), np.int64)])
        yield pa.record_batch([chunk_of(len(gram)), pa.nulls(len(gram), pa.binary()), pa.array(gram), pa.array(n)], schema=ENTRIES)

    for chunk, held, text in rows_of(batches, "chunk", "held_out", "text"):
        if chunk != current:
            if current is not None:
                yield from flush()
            current, words, learned, other = chunk, Counter(), Tally(), Tally()
        raw = (text or "").encode().lower()
        if held:
            words.update(dict.fromkeys(raw.split(), 0))
        else:
            words.update(raw.split())
        (other if held else learned).add(grams(raw))
    if current is not None:
        yield from flush()


SCORES = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())]
)


def scored(docs: DataFrame, params: CtwParams = CtwParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte, a row for each document.

    ``score`` is the log10 probability that the trees give the lower-cased bytes and the
    end; ``bits_per_byte`` the code length of the same, spread over the bytes and the end.
    A null text is empty; a null id counts as empty text for the folds. Repeated rows are
    learned and scored each for itself; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % params.folds
    root = stage_path(spark, "ctw")
    kept = chunked(docs.select("doc_id", "text", (fold == params.held_out).alias("held_out")), f"{root}/docs", params.chunk_bits)
    entries = stage(kept.select("chunk", "held_out", "text").mapInArrow(_entries, "chunk long, word binary, gram long, n long"), "entries")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    # A word's total is summed beside its rows, one for each chunk.
    whole = Window.partitionBy("word")
    words = entries.where("word is not null").select(
        "chunk", "word", F.sum("n").over(whole).alias("n"), (F.row_number().over(whole.orderBy("chunk")) == 1).alias("first")
    )
    return_to_chunks(words, f"{root}/words", buckets)
    totals = spark.read.schema("chunk long, word binary, n long, first boolean").parquet(f"{root}/words")
    once = F.col("first") & (F.col("n") > 0)
    sums = totals.agg(F.sum(F.when(once, F.col("n"))).alias("n"), F.count(F.when(once, 1)).alias("v")).first()
    ends = kept.where("not held_out").count()
    n_train, n_distinct = (sums.n or 0) + ends, sums.v + (ends > 0)

    keyed = entries.where("gram is not null").select("chunk", "gram", "n")
    model = probabilities(keyed.groupBy("gram").agg(F.sum("n").alias("n")))
    return_to_chunks(keyed.select("chunk", "gram").join(model, "gram"), f"{root}/grams", buckets)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts, keys, logs = None, {}, None, None
        of_words, of_grams = Chunks(f"{root}/words", buckets), Chunks(f"{root}/grams", buckets)
        known_end, smooth = int(ends > 0), math.log10(n_train + n_distinct + 1)
        for b in batches:
            rows = []
            for chunk, doc_id, held, text in rows_of([b], "chunk", "doc_id", "held_out", "text"):
                if chunk != current:
                    current, counts = chunk, {}
                    got = of_words.load(chunk)
                    if got is not None:
                        counts = dict(zip(got["word"].to_pylist(), got["n"].to_pylist(), strict=True))
                    got = of_grams.load(chunk)
                    order = np.argsort(got["gram"].to_numpy())
                    keys, logs = got["gram"].to_numpy()[order].astype(np.uint32), got["log10p"].to_numpy()[order]
                raw = (text or "").encode().lower()
                c = np.array([*map(counts.__getitem__, raw.split()), ends], float)
                found = np.sort(grams(raw))  # sorted, as nearby keys are found faster
                total = float(logs[np.searchsorted(keys, found)].sum())
                known = int((c[:-1] > 0).sum()) + known_end
                rows.append((doc_id, held, len(c), known, n_train, float(np.log10(c + 1).sum() - len(c) * smooth), total, -total / math.log10(2) / len(found)))
            columns = list(zip(*rows, strict=True)) or [[] for _ in SCORES]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, SCORES, strict=True)], SCORES)

    return kept.mapInArrow(
        score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
