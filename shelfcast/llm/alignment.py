"""Cross-tokenizer alignment (operator 13): groups of tokens between the cuts that two tokenizers share.

Both tokenizers' ends are known as byte places. An interval is divided at the common end nearest
its middle, found by bisecting the other tokenizer's ends from the middle outwards, and both halves
are divided again; an interval without a common end inside is a group. All intervals of a block of
texts are divided in step.

A blank after something else is a cut in both tokenizers, so texts are taken apart there first and
each distinct stretch of a block is encoded and divided once. How often two ids are linked is
counted over all blocks; the counts come back to the blocks that need them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import stage, table
from shelfcast.llm.tokens import by_bytes, byte_ranks


@dataclass(frozen=True)
class AlignmentParams:
    """``first`` is a byte-level vocabulary (``.tiktoken``), ``second`` a sentencepiece model.

    ``block_bytes`` of text share one table of linked ids and are taken apart and encoded by
    ``slice_bytes``; a task remembers about ``remembered`` stretches between blocks.
    """

    first: str = "byte_bpe_50k.tiktoken"
    second: str = "piece_bpe_32k.model"
    block_bytes: int = 8 << 20
    slice_bytes: int = 1 << 19
    remembered: int = 300_000


#: A blank that follows something else, up to the next such blank. (White space in Python's sense
#: includes that of both tokenizers.)
STRETCH = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")


def shared_groups(a_ends: np.ndarray, b_ends: np.ndarray, intervals: np.ndarray) -> np.ndarray:
    """Groups (a_low, a_high, b_low, b_high) of the ``intervals`` (same columns), in order.

    The ends ascend over all intervals; both sides of an interval end at the same place.
    """
    leaves = []
    while len(intervals):
        inside = (intervals[:, 1] - intervals[:, 0] > 1) & (intervals[:, 3] - intervals[:, 2] > 1)
        leaves.append(intervals[~inside])
        intervals = intervals[inside]
        middle = (intervals[:, 0] + intervals[:, 1] - 1) // 2
        cut_a = np.full(len(intervals), -1)
        cut_b = np.full(len(intervals), -1)
        open_, near, far = np.arange(len(intervals)), 0, 1
        while len(open_):
            # Ends next to the middle first, then twice as many, on both sides by turns.
            turn = np.arange(near, far)
            away = (turn + 1) // 2 * np.where(turn % 2, 1, -1)
            place = middle[open_, None] + away
            valid = (place >= intervals[open_, 0, None]) & (place < intervals[open_, 1, None] - 1)
            end = a_ends[np.where(valid, place, 0)]
            other = np.searchsorted(b_ends, end)
            hit = valid & (b_ends[np.minimum(other, len(b_ends) - 1)] == end)
            first = hit.argmax(1)
            found = hit[np.arange(len(open_)), first]
            at = np.flatnonzero(found)
            cut_a[open_[at]], cut_b[open_[at]] = place[at, first[at]], other[at, first[at]]
            # Once every end has been tried the interval has no cut.
            more = ~found & (far <= 2 * (intervals[open_, 1] - intervals[open_, 0]))
            open_, near, far = open_[more], far, 2 * far
        cut = cut_a >= 0
        leaves.append(intervals[~cut])
        low, high = intervals[cut].copy(), intervals[cut].copy()
        low[:, 1], low[:, 3] = cut_a[cut] + 1, cut_b[cut] + 1
        high[:, 0], high[:, 2] = cut_a[cut] + 1, cut_b[cut] + 1
        intervals = np.concatenate([low, high])
    groups = np.concatenate(leaves) if leaves else np.zeros((0, 4), np.int64)
    return groups[np.argsort(groups[:, 0], kind="stable")]


def links(a_ends: np.ndarray, b_ends: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (a, b) of all pairs in the ``groups`` whose bytes overlap, in order.

    Each stretch between neighbouring ends of either side lies in one token of both, and two tokens
    share one such stretch at most; the last one of a group ends on both sides.
    """
    last = np.zeros(len(b_ends), bool)
    last[groups[:, 3] - 1] = True
    ends = np.concatenate([a_ends, b_ends[~last]])
    ends.sort()
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


def _ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of each pair, one after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


class Aligner:
    """Encodes stretches, divides them into groups and remembers the results."""

    def __init__(self, params: AlignmentParams):
        import public_tokenizers
        import sentencepiece

        self.first = byte_ranks(public_tokenizers.path(params.first))
        self.second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(params.second))
        self.blank = self.second.piece_to_id("▁")
        a_bytes = [b""] * (self.first.max_token_value + 1)
        for token in range(len(a_bytes)):
            try:
                a_bytes[token] = self.first.decode_single_token_bytes(token)
            except KeyError:  # a number without an entry
                continue
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"pieces of {params.second} reach over blanks")
        b_bytes = [
            bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.bytes = a_bytes, b_bytes
        self.lengths = tuple(np.array([len(x) for x in side], np.int64) for side in self.bytes)
        # Ids with what follows them in a group, for the listing of groups.
        self.listed = [f"{i}{mark}" for i in range(len(a_bytes)) for mark in ",|"]
        self.b_listed = len(self.listed)
        self.listed += [f"{i}{mark}" for i in range(len(b_bytes)) for mark in ",;"]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.counts = np.zeros((0, 3), np.int64)  # tokens of A and B, groups
        self.pairs = np.zeros(0, np.int64)
        self.firsts = np.zeros(1, np.int64)

    def learn(self, stretches: list[str]) -> None:
        """Encode and divide ``stretches``, which are new; a negative count marks lost bytes."""
        a_ids = [self.first.encode_ordinary(s) for s in stretches]
        # The model puts the first blank back, but not before nothing.
        b_ids = self.second.encode([s[1:] for s in stretches], num_threads=1)
        b_ids = [ids if s != " " else [self.blank] for s, ids in zip(stretches, b_ids, strict=True)]
        good = np.array(
            [
                b"".join([self.bytes[0][i] for i in a]) == b"".join([self.bytes[1][i] for i in b]) == s.encode()
                for s, a, b in zip(stretches, a_ids, b_ids, strict=True)
            ],
            bool,
        )
        a_ids, b_ids = ([x if g else [] for x, g in zip(side, good, strict=True)] for side in (a_ids, b_ids))
        sizes = np.array([[len(a), len(b)] for a, b in zip(a_ids, b_ids, strict=True)], np.int64).reshape(-1, 2)
        highs = np.cumsum(sizes, 0)
        lows = highs - sizes
        a = np.fromiter((i for x in a_ids for i in x), np.int64, int(sizes[:, 0].sum()))
        b = np.fromiter((i for x in b_ids for i in x), np.int64, int(sizes[:, 1].sum()))
        a_ends, b_ends = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        groups = shared_groups(a_ends, b_ends, np.stack([lows[:, 0], highs[:, 0], lows[:, 1], highs[:, 1]], 1)[good])
        n_groups = np.zeros(len(stretches), np.int64)
        np.add.at(n_groups, np.searchsorted(highs[:, 0], groups[:, 0], "right"), 1)
        of_a, of_b = links(a_ends, b_ends, groups)
        n_links = (sizes.sum(1) - n_groups) * good
        # Tokens in the order of the listing: a group's from A, then those from B.
        a_last, b_last = np.zeros(len(a), bool), np.zeros(len(b), bool)
        a_last[groups[:, 1] - 1] = True
        b_last[groups[:, 3] - 1] = True
        order = np.empty(len(a) + len(b), np.int64)
        order[_ragged(groups[:, 0] + groups[:, 2], groups[:, 1] - groups[:, 0])] = 2 * a + a_last
        order[_ragged(groups[:, 1] + groups[:, 2], groups[:, 3] - groups[:, 2])] = self.b_listed + 2 * b + b_last
        marks = list(map(self.listed.__getitem__, order.tolist()))
        edges = highs.sum(1).tolist()
        for s, low, high in zip(stretches, [0, *edges], edges, strict=False):
            self.known[s] = len(self.texts)
            self.texts.append("".join(marks[low:high]))
        counts = np.concatenate([sizes, n_groups[:, None]], 1)
        counts[~good] = -1
        self.counts = np.concatenate([self.counts, counts])
        self.pairs = np.concatenate([self.pairs, a[of_a] << 32 | b[of_b]])
        self.firsts = np.concatenate([self.firsts, self.firsts[-1] + np.cumsum(n_links)])

    def codes(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The number of each stretch of each text; unknown ones are learnt first."""
        new = dict.fromkeys(s for t in texts for s in t if s not in self.known)
        if new:
            self.learn(list(new))
        return [np.fromiter(map(self.known.__getitem__, t), np.int32, len(t)) for t in texts]

    def taken(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[str]]:
        """Stretch numbers and digest of the groups of each text; none for a text without tokens."""
        parts = [STRETCH.findall(" " + t) if t and "▁" not in t else [] for t in texts]
        codes = self.codes(parts)
        # A stretch that lost bytes: the text is tried as a whole.
        odd = [k for k, c in enumerate(codes) if (self.counts[c, 0] < 0).any()]
        for k, c in zip(odd, self.codes([[" " + texts[k]] for k in odd]), strict=True):
            codes[k] = c[self.counts[c, 0] >= 0]
        digests = [hashlib.sha256("".join(map(self.texts.__getitem__, c.tolist()))[:-1].encode()).hexdigest() if len(c) else "" for c in codes]
        return codes, digests


BLOCKS = pa.schema(
    [
        ("block", pa.int64()), ("is_table", pa.bool_()), ("doc_id", pa.int64()),
        ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
        ("groups_sha256", pa.string()), ("stretches", pa.list_(pa.int32())),
        ("pairs", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("members", pa.list_(pa.int32())),
    ]
)
BLOCK_TYPES = (
    "block long, is_table boolean, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "stretches array<int>, pairs array<long>, n array<long>, sizes array<int>, members array<int>"
)


def _block_rows(aligner: Aligner, block: int, ids: list[int | None], codes: list[np.ndarray], digests: list[str]) -> pa.RecordBatch:
    """A row for each document, with its stretches, and one for the block's linked ids."""
    used, inside = np.unique(np.concatenate([np.zeros(0, np.int32), *codes]), return_inverse=True)
    times = np.bincount(inside, minlength=len(used))
    sizes = aligner.firsts[used + 1] - aligner.firsts[used]
    pairs, members = np.unique(aligner.pairs[_ragged(aligner.firsts[used], sizes)], return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    np.add.at(n, members, np.repeat(times, sizes))
    edges = np.cumsum([len(c) for c in codes])
    totals = np.array([aligner.counts[c].sum(0) for c in codes], np.int64).reshape(-1, 3)
    found = np.split(inside.astype(np.int32), edges[:-1])
    rows, none = len(ids), lambda x: [None] * x
    columns = (
        [block] * (rows + 1), [False] * rows + [True], [*ids, None],
        [*totals[:, 0].tolist(), None], [*totals[:, 1].tolist(), None], [*totals[:, 2].tolist(), None],
        [*(totals[:, 0] + totals[:, 1] - totals[:, 2]).tolist(), None], [*digests, None], [*found, None],
        [*none(rows), pairs], [*none(rows), n], [*none(rows), sizes.astype(np.int32)], [*none(rows), members.astype(np.int32)],
    )
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, BLOCKS, strict=True)], BLOCKS)


def _blocks(batches: Iterator[pa.RecordBatch], number: int, params: AlignmentParams) -> Iterator[pa.RecordBatch]:
    """The rows of the blocks of a task, which are counted from ``number``."""
    aligner = Aligner(params)
    ids, codes, digests, held = [], [], [], 0
    for b in batches:
        for start, rows in by_bytes(b.column("text"), params.slice_bytes):
            part = b.slice(start, rows)
            ids += part.column("doc_id").to_pylist()
            texts = part.column("text").to_pylist()
            held += sum(len(t or "") for t in texts)
            # Of the texts only numbers and digests are kept until the block is full.
            for kept, new in zip((codes, digests), aligner.taken(texts), strict=True):
                kept += new
            if held >= params.block_bytes:
                yield _block_rows(aligner, number, ids, codes, digests)
                number, ids, codes, digests, held = number + 1, [], [], [], 0
                if len(aligner.known) > params.remembered:
                    aligner.forget()
    if ids:
        yield _block_rows(aligner, number, ids, codes, digests)


def aligned(docs: DataFrame, params: AlignmentParams = AlignmentParams()) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256; one row for each document.

    Texts that are null or empty, or whose bytes either tokenizer does not give back, have no tokens:
    zeros and an empty digest. Repeated rows count each for itself; of the ids linked most often with
    an id of the second tokenizer all ties are best. An empty table gives no rows; other columns are
    not read. A long text is a block of its own; a stretch without blanks is encoded whole.

    Links are summed per block before they are shuffled; the highest counts have a row for each id of
    the second tokenizer at most (32,000), which is broadcast.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _blocks(batches, TaskContext.get().partitionId() << 32, params)

    rows = stage(docs.select("doc_id", "text").mapInArrow(blocks, BLOCK_TYPES), "aligned")
    tables = rows.where("is_table").select("block", F.posexplode(F.arrays_zip("pairs", "n")).alias("at", "p"))
    tables = tables.select("block", "at", F.col("p.pairs").alias("pair"), "p.n")
    counts = stage(tables.groupBy("pair").agg(F.sum("n").alias("total")), "link-counts")
    second = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = counts.groupBy(second.alias("b")).agg(F.max("total").alias("most"))
    judged = counts.withColumn("b", second).join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    values = tables.join(judged, "pair").select(F.col("block").alias("for_block"), "at", "total", "best")

    def settle(documents: pa.Table, values: pa.Table) -> pa.Table:
        held = documents.column("is_table").to_numpy(zero_copy_only=False)
        own = documents.filter(pa.array(~held)).combine_chunks()
        shared = documents.filter(pa.array(held))
        sizes, members = (shared.column(c)[0].values.to_numpy() for c in ("sizes", "members"))
        pair_values = np.zeros((2, values.num_rows), np.int64)
        at = values.column("at").to_numpy()
        pair_values[0, at] = values.column("best").to_numpy(zero_copy_only=False)
        pair_values[1, at] = values.column("total").to_numpy()
        # Sums over each stretch's links, then over each document's stretches, from running sums.
        edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        running = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(pair_values[:, members], 1)], 1)
        stretch = running[:, edges[1:]] - running[:, edges[:-1]]
        listed = pa.concat_arrays(own.column("stretches").chunks) if own.num_rows else pa.array([], pa.list_(pa.int32()))
        codes, ends = listed.flatten().to_numpy(), np.cumsum(listed.value_lengths().to_numpy(), dtype=np.int64)
        running = np.concatenate([np.zeros((2, 1), np.int64), np.cumsum(stretch[:, codes], 1)], 1)
        sums = running[:, ends] - running[:, np.concatenate([[0], ends[:-1]]).astype(np.int64)]
        columns = {c: own.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(columns | {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": own.column("groups_sha256")})

    kept = rows.select("block", "is_table", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "stretches", "sizes", "members")
    return kept.groupBy("block").cogroup(values.groupBy("for_block")).applyInArrow(
        settle, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )


def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
