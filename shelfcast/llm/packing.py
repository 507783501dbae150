"""Best-fit packing (operator 2): vector best-fit over a histogram of lengths.

What a piece needs of each capacity follows from its length, so pieces of a length are
alike and the search runs over at most ``tokens`` lengths with their counts. It is exact
best-fit decreasing, bin by bin, done for many bins at once; the pieces are then dealt to
the places found by their rank within their length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import stage, table


@dataclass(frozen=True)
class PackingParams:
    """Capacities of a sequence and how a bin is chosen.

    ``attention`` bounds the sum of squared lengths. ``rule`` is ``norm`` (least weighted
    norm of what stays free) or ``dot`` (greatest weighted product of need and free room);
    needs are shares of the capacities. With the default capacities tokens bind first:
    1024 documents fill 1024 tokens, and squares sum to 1024 squared at most.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1e-6, 1e-6)
    rule: str = "norm"
    end_id: int = 2
    tokenizer: str = "byte_bpe_50k"


def encoder(name: str):
    """text -> ids of the tokenizer file ``name``.json.

    The same vocabulary and splitting as ranks give the same ids several times faster; a
    text with the string of a special token, which that form lacks, goes to the file itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(s in text for s in special):
            return full.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, params: PackingParams) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: only the first of several pieces is shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(params.tokenizer)
        for b in batches:
            found = ([], [], [], [], [])
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), params.end_id], "<u4")
                edges = [0, *range(len(ids) % params.tokens or params.tokens, len(ids) + 1, params.tokens)]
                for i, (a, z) in enumerate(zip(edges, edges[1:], strict=False)):
                    for column, value in zip(found, (doc_id, i, a, z - a, zlib.crc32(ids[a:z].tobytes())), strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(found, PIECES, strict=True)], PIECES)

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], params: PackingParams) -> np.ndarray:
    """Segments (length, first rank, count, first bin, per bin, offset) that place every piece.

    Lengths go from long to short. The best bin takes pieces of the length until one of
    its capacities is met, as it stays the best while it fills; bins in the same state are
    filled in one step. Without a bin that fits, new ones are opened.
    """
    full = np.array([params.tokens, params.documents, params.attention], float)
    weights = np.array(params.weights)
    state = np.zeros((0, 3))  # free room of each run of bins
    runs: list[tuple[int, int]] = []  # first bin and number of bins of each run
    segments, opened = [], 0
    for length in sorted(counts, reverse=True):
        need, left, rank = np.array([length, 1, length * length], float), counts[length], 0
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens exceeds a capacity")
        while left:
            fits = (state >= need).all(1)
            if fits.any():
                if params.rule == "dot":
                    score = -(weights * need * state / full**2).sum(1)
                else:
                    score = (weights * ((state - need) / full) ** 2).sum(1)
                best = int(np.argmin(np.where(fits, score, np.inf)))
                room, (first, bins) = state[best], runs[best]
                state = np.delete(state, best, 0)
                runs.pop(best)
            else:
                room, first, bins = full, opened, left
            per = int((room // need).min())
            used = min(bins, left // per)
            done = [(first, used, per)] if used else []
            if used < bins and left - used * per:
                done.append((first + used, 1, left - used * per))
            if not fits.any():
                bins = sum(n for _, n, _ in done)
                opened += bins
            for at, n, each in done:
                segments.append((length, rank, n * each, at, each, params.tokens - int(room[0])))
                rank += n * each
                left -= n * each
                runs.append((at, n))
                state = np.vstack([state, room - each * need])
            spare = bins - sum(n for _, n, _ in done)
            if spare:
                runs.append((first + bins - spare, spare))
                state = np.vstack([state, room])
            open_ = state[:, 0] > 0
            state, runs = state[open_], [r for r, o in zip(runs, open_, strict=True) if o]
    return np.array(segments, np.int64).reshape(-1, 6)


def pack(docs: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row for each piece.

    A null or empty text is one piece of the end id. Repeated rows are packed each for
    itself; other columns are ignored; an empty table gives no rows. Texts of any length are
    cut into pieces, all of which are packed; pieces of one length are interchangeable and
    dealt in the order they were written. The driver sees one
    count for each length, ``tokens`` at most. Ranks come from counts per written
    partition and length, so no length, however common, is gathered.
    """
    cut = pieces(docs, params).withColumn("row", F.monotonically_increasing_id())
    cut = stage(cut, "pieces").withColumn("part", F.shiftright("row", 33))
    held = stage(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r.length: r.n for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = best_fit(counts, params)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = held.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("part", "length").orderBy("row")
    ranked = cut.withColumn("at", F.row_number().over(within)).join(first, ["part", "length"])
    ranked = ranked.select(*PIECES.names, (F.col("first") + F.col("at") - 1).alias("rank"))
    wide = np.int64(1) << 48
    order = np.argsort(segments[:, 0] * wide + segments[:, 1])
    length, rank, _, first_bin, per, offset = segments[order].T
    keys = length * wide + rank

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, n * wide + r, "right") - 1
            nth = r - rank[at]
            places = first_bin[at] + nth // per[at], offset[at] + nth % per[at] * n
            yield pa.record_batch([*(b.column(c) for c in PIECES.names), *map(pa.array, places)], [*PIECES.names, "sequence_id", "offset"])

    return ranked.mapInArrow(deal, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
