"""SimHash near-dedup (operator 6): fingerprints linked through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import components, stage, table


@dataclass(frozen=True)
class SimHashParams:
    """Shingle length in words, largest bit distance, and sizes of the index.

    The 64 bits are cut into ``blocks``; ``blocks - max_bits`` of them agree between any
    two fingerprints that link, so every such choice of blocks is a masked pattern under
    which a link is found. ``bucket`` is the number of fingerprints one task indexes;
    larger buckets are dealt over salted pairs of parts.
    """

    words: int = 4
    max_bits: int = 4
    blocks: int = 6
    bucket: int = 20_000
    seed: int = 42


def fingerprint(text: str | None, params: SimHashParams) -> int:
    """64-bit fingerprint, as a signed number: a bit is set if over half the shingle hashes have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends]
    k = min(params.words, len(words))
    hash64, seed = xxhash.xxh64_intdigest, params.seed
    hashes = np.fromiter(
        (hash64(joined[a : b - 1], seed) for a, b in zip(starts, ends[k - 1 :], strict=False)), np.uint64
    )
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprint(docs: DataFrame, name: str, params: SimHashParams = SimHashParams()) -> DataFrame:
    """``docs`` and a long column of fingerprints."""
    out = type(docs.schema)([*docs.schema.fields]).add(name, "long")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t, params) for t in b.column("text").to_pylist()], pa.int64())
            yield b.append_column(name, fps)

    return docs.mapInArrow(add, out)


def gray_rank(fp: Column) -> Column:
    """Place of a fingerprint in the Gray sequence: each bit is the parity of those above."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def masks(params: SimHashParams) -> list[int]:
    """The masks under which linked fingerprints agree, as signed numbers."""
    cuts = [round(64 * i / params.blocks) for i in range(params.blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    found = [sum(c) for c in combinations(parts, params.blocks - params.max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


class GrayIndex:
    """Hierarchical index over fingerprints sorted by Gray rank.

    Neighbours in Gray order share bits. Every node holds the bits on which all below it
    agree, less those that its parent holds already; a search carries the differences met
    so far and leaves out a whole node once they exceed the bound.
    """

    FAN = 16

    def __init__(self, items: np.ndarray):
        self.items = items
        low, high = items.copy(), items.copy()  # AND and OR of what is below
        self.levels = [(low, high)]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            at = np.arange(0, len(low), self.FAN)
            self.levels.append((np.bitwise_and.reduceat(low, at), np.bitwise_or.reduceat(high, at)))
        self.nodes = []
        for i, (low, high) in enumerate(self.levels):
            shared = ~(low ^ high)
            if i + 1 < len(self.levels):
                above_low, above_high = self.levels[i + 1]
                shared &= np.repeat(above_low ^ above_high, self.FAN)[: len(low)]
            self.nodes.append((low, shared))

    def spanning(self, max_bits: int, block: int = 256) -> list[tuple[int, int]]:
        """Places (a, b) of a forest that connects all items linked within ``max_bits``.

        Nodes whose items are all tied to the query already are left out, so a dense
        group costs one block of queries and not its square.
        """
        n, top = len(self.items), len(self.nodes) - 1
        owner, edges = np.arange(n), []
        for start in range(0, n, block):
            queries = np.arange(start, min(start + block, n))
            uniform = self._uniform(owner)
            for s in range(0, len(queries), 64):
                q = queries[s : s + 64]
                node = np.zeros(len(q), np.int64)
                spent = np.zeros(len(q), np.int64)
                for level in range(top, -1, -1):
                    pattern, shared = self.nodes[level]
                    spent = spent + np.bitwise_count((self.items[q] ^ pattern[node]) & shared[node])
                    open_ = (spent <= max_bits) & (uniform[level][node] != owner[q])
                    q, node, spent = q[open_], node[open_], spent[open_]
                    if level and len(q):
                        size = len(self.nodes[level - 1][0])
                        q, spent = np.repeat(q, self.FAN), np.repeat(spent, self.FAN)
                        node = (node[:, None] * self.FAN + np.arange(self.FAN)).ravel()
                        inside = node < size
                        q, node, spent = q[inside], node[inside], spent[inside]
                pairs = np.unique(np.stack([owner[q], owner[node]], 1), axis=0) if len(q) else ()
                parent: dict[int, int] = {}

                def root(x: int) -> int:
                    while parent.get(x, x) != x:
                        parent[x] = parent.get(parent[x], parent[x])
                        x = parent[x]
                    return x

                # Component names are places of items, so a pair of names has to be replaced
                # by a pair of items that are linked: any two of the two components will do.
                for a, b in np.asarray(pairs).tolist():
                    ra, rb = root(a), root(b)
                    if ra != rb:
                        parent[max(ra, rb)] = min(ra, rb)
                        edges.append((a, b))
                if parent:
                    names = np.array(sorted(parent))
                    renamed = np.array([root(x) for x in names.tolist()])
                    at = np.searchsorted(names, owner)
                    at[at == len(names)] = 0
                    owner = np.where(names[at] == owner, renamed[at], owner)
                    uniform = self._uniform(owner)
        return edges

    def _uniform(self, owner: np.ndarray) -> list[np.ndarray]:
        """Per level, the component of all items below a node, or -1."""
        found = [owner]
        for _ in self.nodes[1:]:
            below = found[-1]
            at = np.arange(0, len(below), self.FAN)
            low, high = np.minimum.reduceat(below, at), np.maximum.reduceat(below, at)
            found.append(np.where((low == high) & (low >= 0), low, -1))
        return found


def _links(params: SimHashParams):
    """Spanning links of every bucket in a stream sorted by bucket and Gray rank."""

    def one(fps: np.ndarray) -> np.ndarray:
        items = np.unique(fps) if len(fps) < 2 else fps[np.concatenate([[True], fps[1:] != fps[:-1]])]
        edges = GrayIndex(items).spanning(params.max_bits)
        return items[np.array(edges, np.int64).reshape(-1, 2)]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def work(bucket: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            found = []
            first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]).any(1)]))
            sizes = np.diff(np.append(first, len(bucket)))
            # Buckets of two, most by far, are compared together; larger ones by their index.
            twos = first[sizes == 2]
            near = np.bitwise_count(fps[twos] ^ fps[twos + 1]) <= params.max_bits
            found.append(np.stack([fps[twos][near], fps[twos + 1][near]], 1))
            for a, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                found.append(one(fps[a : a + n]))
            pairs = np.concatenate(found).view(np.int64)
            yield pa.record_batch({"a": pairs[:, 0], "b": pairs[:, 1]})

        for b in batches:
            bucket = np.stack([b.column(n).to_numpy() for n in ("mask", "pattern", "salt")], 1)
            fps = b.column("fp").to_numpy().view(np.uint64)
            if not len(fps):
                continue
            if held and (held[-1][0][-1] != bucket[0]).any():
                yield from work(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = []
            last = len(bucket) - 1
            while last and (bucket[last - 1] == bucket[-1]).all():
                last -= 1
            if last and held:
                yield from work(np.concatenate([*(h[0] for h in held), bucket[:last]]), np.concatenate([*(h[1] for h in held), fps[:last]]))
                held = []
            elif last:
                yield from work(bucket[:last], fps[:last])
            held.append((bucket[last:], fps[last:]))
        if held:
            yield from work(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return find


def linked(fps: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(a, b): links between distinct fingerprints that give the same groups as all links.

    Every fingerprint goes to one bucket for each masked pattern. Buckets over the bound
    are cut into parts by a hash, and every pair of parts becomes a bucket of its own.
    """
    found = masks(params)
    keyed = fps.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("pattern")) for i, m in enumerate(found)])).alias("k")
    ).select("fp", "k.mask", "k.pattern")
    sizes = keyed.groupBy("mask", "pattern").count()
    large = stage(
        sizes.where(F.col("count") > params.bucket).select("mask", "pattern", F.ceil(F.col("count") / params.bucket).cast("int").alias("parts")),
        "large-buckets",
    )
    salted = keyed.join(large, ["mask", "pattern"], "left")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("part")) * F.col("parts") + F.greatest(j, F.col("part")))
    dealt = (
        salted.withColumn("part", part)
        .withColumn("salt", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(others)))
        .select(F.col("mask").cast("long").alias("mask"), "pattern", F.col("salt").cast("long").alias("salt"), "fp")
    )
    sorted_ = dealt.repartition("mask", "pattern", "salt").sortWithinPartitions("mask", "pattern", "salt", gray_rank(F.col("fp")))
    return sorted_.mapInArrow(_links(params), "a long, b long")


def _grouped(prints: DataFrame, params: SimHashParams) -> DataFrame:
    """(fp, component_id) of the staged (doc_id, fp)."""
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "fingerprints")
    named = components(linked(distinct.select("fp"), params))
    tied = distinct.join(named, distinct["fp"] == named["node"]).groupBy("component").agg(F.min("low").alias("component_id"))
    tied = named.join(tied, "component").select(F.col("node").alias("fp"), F.col("component_id").alias("tied"))
    grouped = distinct.join(tied, "fp", "left").select("fp", F.when(F.col("tied").isNull(), F.col("low")).otherwise(F.col("tied")).alias("component_id"))
    # Written, so that the join with the documents stands alone and AQE can split a common fingerprint.
    return stage(grouped, "groups")


def near_duplicates(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    A text without words has fingerprint zero and links like any other; a text with fewer
    words than a shingle is one shingle. Documents of equal fingerprint are one node, so
    thousands of copies cost one. A null doc_id never names a component, unless all ids of
    it are null. Repeated rows give repeated results; other columns are ignored.
    """
    prints = stage(with_fingerprint(docs.select("doc_id", "text"), "fp", params).select("doc_id", "fp"), "prints")
    return prints.join(_grouped(prints, params), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, params: SimHashParams = SimHashParams()) -> DataFrame:
    """The row of smallest doc_id of each component, with all its columns.

    Of rows with that doc_id, null ids last, the one with the least text hash and then the
    first written stays, so repeated rows leave one. An empty table gives an empty one; texts
    are hashed whole, whatever their length. Columns of any name are kept. The documents are
    written once with their fingerprint and a row number; what stays is picked by that number.
    """
    taken, names = {c.lower() for c in docs.columns}, []
    for name in ("fp", "row", "text_hash"):
        while name in taken:
            name += "_"
        names.append(name)
    fp, row, text = names
    marked = with_fingerprint(docs, fp, params).withColumn(row, F.monotonically_increasing_id()).withColumn(text, F.xxhash64("text"))
    marked = stage(marked, "marked")
    prints = marked.select("doc_id", F.col(fp).alias("fp"), F.col(row).alias("row"), F.col(text).alias("text_hash"))
    order = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), "text_hash", "row")
    grouped = _grouped(prints.select("doc_id", "fp"), params)
    first = prints.join(grouped, "fp").groupBy("component_id").agg(F.min(order).alias("x")).select(F.col("x.row").alias(row))
    return marked.join(first, row, "left_semi").select(*docs.columns)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
