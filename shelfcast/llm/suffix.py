"""Suffix-array dedup (operator 1): repeated byte strings by a distributed merge sort of suffixes.

Suffixes are sorted at anchors only, places that equal texts have in common: the least
hashes of a window. Each chunk of documents sorts its suffixes into a run without
repeats, front-codes it, and deals it out by range. A range merges its runs with a loser
tree that goes by the prefixes known to be shared and compares bytes only behind them.
The neighbours in the merged order give the longest repeat that starts at each anchor; a
second sort, of the texts read backwards, gives the longest that ends there. Repeats so
short that neither decides them are sorted the same way in a third.

Before a sort, hashes of the strings that a repeat must hold are counted, so suffixes that
nothing can equal are not sent. Hashes only rule out; every repeat is read off the order.

Texts are dealt to chunks by their least hash, which texts that share much have in common: so
a chunk has most copies of a suffix and sends it once, however many chunks there are.
"""

from __future__ import annotations

import bisect
import hashlib
import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelfcast.llm.common import Chunks, bucket_count, return_to_chunks, rows_of, stage, table
from shelfcast.sources.staging import stage_path


@dataclass(frozen=True)
class SuffixParams:
    """Bytes of a repeat, bytes hashed at an anchor, rows of a chunk (a power of two), sizes of what a task holds and merges, and rows of a part of the texts.

    Only the ranges between tasks are fitted on a sample, of ``sample_per_part`` suffixes for
    each of them, from ``sample_docs`` documents at least; they decide where a suffix is
    merged and not what is found.
    """

    length: int = 200
    gram: int = 100
    chunk_bits: int = 13
    hashes_per_part: int = 1_000_000
    suffixes_per_part: int = 100_000
    sample_docs: int = 2_000
    sample_per_part: int = 32
    held_bytes: int = 1 << 25
    run_places: int = 1 << 19
    rows_per_part: int = 6_000

    @property
    def window(self) -> int:
        """Gram places in a string of ``length``; one of them at least is an anchor."""
        return self.length - self.gram + 1

    @property
    def reach(self) -> int:
        """Bytes of a suffix that matter at most: past the next anchor by ``length``."""
        return self.length + self.window


FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
HASH_BITS = 48


class Hasher:
    """Hashes of all strings of one length inside a text, from running sums modulo 2**64."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        while len(self.up) < n:
            m = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(FACTOR, m, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(INVERSE, m, 1 << 64))])

    def strings(self, raw: np.ndarray, size: int) -> np.ndarray:
        n = len(raw) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._grow(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.down[: len(raw)], out=sums[1:])
        h = (sums[size:] - sums[:n]) * self.up[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h >> np.uint64(64 - HASH_BITS)


def sliding(values: np.ndarray, width: int, pick: Callable) -> np.ndarray:
    """``pick`` (minimum or maximum) of every ``width`` neighbours."""
    out, done = values, 1
    while 2 * done <= width:
        out, done = pick(out[:-done], out[done:]), 2 * done
    rest = width - done
    return pick(out[:-rest], out[rest:]) if rest else out


#: Starts of strings handled at once.
BLOCK = 1 << 18


def blocks(raw: np.ndarray, hasher: Hasher, params: SuffixParams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(start, hashes of grams, least hash of each string of ``length``) of bounded parts of a text."""
    for start in range(0, len(raw) - params.length + 1, BLOCK):
        h = hasher.strings(raw[start : start + BLOCK + params.length - 1], params.gram)
        yield start, h, sliding(h, params.window, np.minimum)


def stretches(raw: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the longest stretches of one byte that have ``least`` bytes or more."""
    step = max(1, least // 3)
    few = raw[::step]
    if not ((few[2:] == few[1:-1]) & (few[1:-1] == few[:-2])).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.concatenate([[0], np.flatnonzero(raw[1:] != raw[:-1]) + 1, [len(raw)]])
    long = np.diff(edges) >= least
    return edges[:-1][long], edges[1:][long]


def anchors(raw: np.ndarray, hasher: Hasher, params: SuffixParams) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes): every place that holds the least hash of some string of ``length``.

    Of a stretch of one byte longer than ``length`` only the first and the last gram are
    anchors: a string that holds neither lies inside, and starts one byte on too.
    """
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    blocked = len(raw) - params.length + 1 > BLOCK
    found = stretches(raw, params.length + 1) if blocked else None
    for start, h, low in blocks(raw, hasher, params):
        pad = np.zeros(params.window - 1, np.uint64)
        at = np.flatnonzero(h == sliding(np.concatenate([pad, low, pad]), params.window, np.maximum))
        # In a text of one block a stretch shows as more anchors side by side than a string has grams.
        if found is None and len(at) > params.window and (at[params.window :] - at[: -params.window] == params.window).any():
            found = stretches(raw, params.length + 1)
        if found is not None and len(found[0]):
            firsts, ends = found
            which = np.maximum(np.searchsorted(firsts, at + start, "right") - 1, 0)
            at = at[(at + start <= firsts[which]) | (at + start >= ends[which] - params.gram)]
        places.append(at + start)
        hashes.append(h[at])
    places, hashes = np.concatenate(places), np.concatenate(hashes)
    if blocked:
        places, first = np.unique(places, return_index=True)
        hashes = hashes[first]
    return places, hashes


def prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix of two strings known to share ``start`` bytes."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[start:n], "big") ^ int.from_bytes(b[start:n], "big")
    return n - (x.bit_length() + 7) // 8


def merge(runs: list[list[tuple[bytes, int, bool]]]) -> list[list[int]]:
    """For each suffix (rest, prefix shared with its predecessor in the run, met twice in the run): the longest prefix it shares with another.

    A loser tree. ``known[i]`` is what the front suffix of run i shares with the suffix put
    out last; along the path of the winner all losers share theirs with the same suffix, so
    the larger number wins unread, and equal ones are compared from there on.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    found = [[0] * len(r) for r in runs]
    front: list[bytes | None] = [r[0][0] if r else None for r in runs] + [None] * (size - k)
    known, at, tree = [0] * size, [0] * size, [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        x, y = front[a], front[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        shared = prefix(x, y, known[a])
        if x[shared : shared + 1] <= y[shared : shared + 1]:
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    row = list(range(size))
    first = size
    while len(row) > 1:
        first //= 2
        for i in range(0, len(row), 2):
            row[i], tree[first + i // 2] = play(row[i], row[i + 1])
        row = row[::2]
    winner, last = row[0], None
    while front[winner] is not None:
        i, shared = at[winner], known[winner]
        text, twice = front[winner], runs[winner][i][2]
        if last is not None and shared > found[last[0]][last[1]]:
            found[last[0]][last[1]] = shared
        found[winner][i] = len(text) if twice else shared
        last = winner, i
        at[winner] = i = i + 1
        if i < len(runs[winner]):
            rest, known[winner], _ = runs[winner][i]
            front[winner] = text[: known[winner]] + rest
        else:
            front[winner] = None
        node = (size + winner) // 2
        while node:
            winner, tree[node] = play(winner, tree[node])
            node //= 2
    return found


def least_gram(raw: np.ndarray, hasher: Hasher, params: SuffixParams) -> int:
    """The least hash of all grams of a text; -1 of a text too short to have one."""
    starts = range(0, len(raw) - params.gram + 1, BLOCK)
    return min((int(hasher.strings(raw[a : a + BLOCK + params.gram - 1], params.gram).min()) for a in starts), default=-1)


#: Texts of one least hash that a task deals to its part, texts it deals together after them, and hashes it remembers.
TOGETHER, LUMP, REMEMBERED = 8, 256, 1 << 17


def by_likeness(docs: DataFrame, path: str, rows: int, total: int, params: SuffixParams) -> DataFrame:
    """``docs`` written to ``path`` with a fixed row number and the chunk it falls in, alike texts side by side.

    A text goes to the part of its least hash. Where a task meets more than ``TOGETHER`` texts of one
    hash, the others go by lumps to any parts, so a large group of copies lies in no part alone.
    Where a text lies decides what is sent and not what is found.
    """
    parts = max(1, rows // params.rows_per_part, total // params.held_bytes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, met, task = Hasher(), Counter(), TaskContext.get().partitionId()
        for b in (b for b in batches if b.num_rows):
            keys, to = [], []
            for (text,) in rows_of([b], "text"):
                key = least_gram(np.frombuffer((text or "").encode(), np.uint8), hasher, params)
                if len(met) > REMEMBERED:
                    met.clear()
                n = met[key]
                met[key] += 1
                keys.append(key)
                to.append(hash((key,) if n < TOGETHER else (key, task, n // LUMP)) % parts)
            keyed = pa.record_batch([pa.array(keys, pa.int64()), *b.columns], ["key", *b.schema.names])
            order = np.argsort(to, kind="stable")
            used, first = np.unique(np.array(to)[order], return_index=True)
            blobs = []
            for some in np.split(order, first[1:]):
                packed = pa.BufferOutputStream()
                with pa.ipc.new_stream(packed, keyed.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
                    out.write_batch(keyed.take(pa.array(some)))
                blobs.append(packed.getvalue().to_pybytes())
            yield pa.record_batch({"part": pa.array(used, pa.int32()), "data": pa.array(blobs, pa.binary())})

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column("data"):
                yield from pa.ipc.open_stream(data.as_buffer())

    dealt = docs.mapInArrow(deal, "part int, data binary").repartitionById(parts, F.col("part")).select("data")
    found = dealt.mapInArrow(unpacked, StructType([StructField("key", LongType()), *docs.schema.fields])).sortWithinPartitions("key").drop("key")
    kept = found.withColumn("row", F.monotonically_increasing_id()).withColumn("chunk", F.shiftright("row", params.chunk_bits))
    kept.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(kept.schema).parquet(path)


# What a task asks about one document (row, bytes, values): places, hashes there, and marks.
Ask = Callable[[int, bytes, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
# Makes an Ask for a chunk, inside a task.
Asked = Callable[[int], Ask]


def _by_chunk(batches: Iterator[pa.RecordBatch], params: SuffixParams) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """(chunk, [(row, bytes)]) of the texts long enough to hold a string of ``length``.

    A chunk of more than ``held_bytes`` comes in parts; each is a run of its own.
    """
    current, held, size = None, [], 0
    for row, chunk, text in rows_of(batches, "row", "chunk", "text"):
        raw = (text or "").encode()
        if len(raw) < params.length:
            continue
        if held and (chunk != current or size + len(raw) > params.held_bytes):
            yield current, held
            held, size = [], 0
        current = chunk
        held.append((row, raw))
        size += len(raw)
    if held:
        yield current, held


def beside(places: np.ndarray) -> np.ndarray:
    """(place, the one before, the one after) of ascending places; far away where there is none."""
    far = np.array([1 << 40])
    return np.stack([places, np.concatenate([-far, places])[:-1], np.concatenate([places, far])[1:]], 1)


def _parts_of(rows: list[tuple[int, bytes]], places: list[np.ndarray], most: int) -> Iterator[list[tuple[int, bytes, np.ndarray]]]:
    """(row, bytes, places with their neighbours) in lists of ``most`` places at most."""
    held, size = [], 0
    for (row, raw), here in zip(rows, places, strict=True):
        at = 0
        while at < len(here):
            some = here[at : at + most - size]
            held.append((row, raw, some))
            at, size = at + len(some), size + len(some)
            if size == most:
                yield held
                held, size = [], 0
    if held:
        yield held


def count(docs: DataFrame, path: str, asked: Asked, marked: bool, parts: int, buckets: int, params: SuffixParams) -> None:
    """Returns to each chunk those of its hashes that the table has twice or more; if ``marked``, and that carry a mark anywhere."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _by_chunk(batches, params):
            ask, hashes, marks = asked(chunk), [np.zeros(0, np.uint64)], [np.zeros(0, bool)]
            for row, raw in rows:
                _, h, m = ask(row, raw, np.frombuffer(raw, np.uint8))
                hashes.append(h)
                marks.append(m)
            own, which, n = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            # The two lowest bits tell what the chunk alone knows: a mark, and that it has the hash twice.
            mark = (np.bincount(which, np.concatenate(marks), len(own)) > 0).astype(np.uint64)
            coded = (own << np.uint64(2)) | (mark << np.uint64(1)) | (n > 1).astype(np.uint64)
            part = (own * np.uint64(parts) >> np.uint64(HASH_BITS)).astype(np.int64)
            cuts = np.searchsorted(part, np.arange(parts + 1))
            used = np.flatnonzero(np.diff(cuts))
            blobs = [zstandard.compress(np.diff(coded[cuts[i] : cuts[i + 1]], prepend=np.uint64(0)).tobytes(), 1) for i in used]
            yield pa.record_batch({"part": pa.array(used, pa.int32()), "chunk": pa.array([chunk] * len(used), pa.int64()), "data": pa.array(blobs, pa.binary())})

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        coded = [np.cumsum(np.frombuffer(zstandard.decompress(d), np.uint64)) for d in group["data"]]
        every = np.concatenate(coded)
        own, n = np.unique(every >> np.uint64(2), return_counts=True)
        twice = np.union1d(own[n > 1], every[(every & np.uint64(1)).astype(bool)] >> np.uint64(2))
        wanted = np.intersect1d(twice, every[(every & np.uint64(2)).astype(bool)] >> np.uint64(2)) if marked else twice
        out = []
        for c in coded:
            h = c >> np.uint64(2)
            out.append(h[np.isin(h, wanted, assume_unique=True)].tobytes())
        kept = pd.DataFrame({"chunk": group["chunk"], "data": out})
        return kept[kept["data"].str.len() > 0]

    dealt = docs.select("row", "chunk", "text").mapInArrow(deal, "part int, chunk long, data binary")
    # Parts are numbers of partitions, so tasks get as many parts each.
    return_to_chunks(dealt.repartitionById(buckets, F.col("part")).groupBy("part").applyInPandas(pick, "chunk long, data binary"), path, buckets)


def loaded(path: str, buckets: int, chunk: int) -> np.ndarray:
    """The hashes that ``count`` returned to a chunk, sorted."""
    got = Chunks(path, buckets).load(chunk)
    if got is None:
        return np.zeros(0, np.uint64)
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(d, np.uint64) for d in got["data"].to_pylist())]))


def among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in the sorted ``wanted``."""
    if not len(wanted):
        return np.zeros(len(values), bool)
    at = np.searchsorted(wanted, values)
    at[at == len(wanted)] = 0
    return wanted[at] == values


@dataclass(frozen=True)
class Reading:
    """What is compared at a place of a text, given the places beside it, and the suffixes that begin the ranges.

    Such a suffix is sent to the range it ends too. So each suffix meets both its neighbours,
    wherever the order is cut: between any two strings, however much they share.
    """

    cut: Callable[[bytes, int, int, int], bytes]
    splitters: list[bytes]


STRIDE = 1 << 24


def sort(docs: DataFrame, hash_path: str, path: str, asked: Asked, readings: list[Reading], buckets: int, params: SuffixParams) -> None:
    """Returns to each chunk (reading, row, place, longest repeat) of the places whose hash ``count`` gave it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _by_chunk(batches, params):
            wanted = loaded(hash_path, buckets, chunk)
            if not len(wanted):
                continue
            ask, places = asked(chunk), []
            for row, raw in rows:
                at, h, _ = ask(row, raw, np.frombuffer(raw, np.uint8))
                places.append(beside(at)[among(h, wanted)])
            for some in _parts_of(rows, places, params.run_places):
                for reading, how in enumerate(readings):
                    parts, blobs = _run(some, how)
                    numbers = pa.array([reading * STRIDE + p for p in parts], pa.int32())
                    yield pa.record_batch({"part": numbers, "chunk": pa.array([chunk] * len(parts), pa.int64()), "data": pa.array(blobs, pa.binary())})

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        packed = [_arrays(zstandard.decompress(d)) for d in group["data"]]
        longest = merge([_unpacked(p) for p in packed])
        out = []
        for p, m in zip(packed, longest, strict=True):
            out.append(zstandard.compress(pickle.dumps((p[4], p[5], np.repeat(np.array(m, np.int32), p[3]))), 1))
        return pd.DataFrame({"chunk": group["chunk"], "reading": group["part"].astype("int64") // STRIDE, "data": out})

    runs = docs.select("row", "chunk", "text").mapInArrow(run, "part int, chunk long, data binary")
    return_to_chunks(runs.repartitionById(buckets, F.col("part")).groupBy("part").applyInPandas(merged, "chunk long, reading long, data binary"), path, buckets)


def _run(some: list[tuple[int, bytes, np.ndarray]], how: Reading) -> tuple[list[int], list[bytes]]:
    """The sorted suffixes of these places without repeats: ranges, and a front-coded slice for each."""
    found: dict[bytes, list[tuple[int, int]]] = {}
    for row, raw, here in some:
        for p, before, after in here.tolist():
            found.setdefault(how.cut(raw, p, before, after), []).append((row, p))
    parts, slices, last = [], [], b""
    for text in sorted(found):
        part = bisect.bisect_right(how.splitters, text)
        for to in (part - 1, part) if part and how.splitters[part - 1] == text else (part,):
            if not parts or parts[-1] != to:
                parts.append(to)
                slices.append([])
                last = b""
            shared = prefix(last, text)
            slices[-1].append((text[shared:], shared, found[text]))
            last = text
    return parts, [zstandard.compress(_packed(s), 3) for s in slices]


def _packed(entries: list[tuple[bytes, int, list[tuple[int, int]]]]) -> bytes:
    """A front-coded slice: numbers of places and suffixes, rows and places of each, lengths of the rests, shared prefixes, rests joined."""
    held = [x for _, _, places in entries for x in places]
    return b"".join(
        [
            np.array([len(held), len(entries), *(r for r, _ in held)], np.int64).tobytes(), np.array([p for _, p in held], np.int32).tobytes(),
            np.array([len(rest) for rest, _, _ in entries] + [n for _, n, _ in entries] + [len(places) for _, _, places in entries], np.int32).tobytes(),
            *(rest for rest, _, _ in entries),
        ]
    )


def _arrays(packed: bytes) -> tuple:
    """Rests, their lengths, shared prefixes, copies of each suffix, and their rows and places."""
    held, n = np.frombuffer(packed, np.int64, 2).tolist()
    at = 16 + 8 * held
    places, lengths, shared, copies = np.split(np.frombuffer(packed, np.int32, held + 3 * n, at), [held, held + n, held + 2 * n])
    return packed[at + 4 * (held + 3 * n) :], lengths, shared, copies, np.frombuffer(packed, np.int64, held, 16), places


def _unpacked(packed: tuple) -> list[tuple[bytes, int, bool]]:
    rests, lengths, shared, copies, _, _ = packed
    ends = np.cumsum(lengths).tolist()
    return [(rests[a:b], n, c > 1) for a, b, n, c in zip([0, *ends], ends, shared.tolist(), copies.tolist(), strict=False)]


def results(path: str, buckets: int, chunk: int, reading: int = 0) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """row -> (places, longest repeats) of one chunk."""
    got = Chunks(path, buckets).load(chunk)
    parts = [] if got is None else [pickle.loads(zstandard.decompress(d)) for r, d in zip(got["reading"].to_pylist(), got["data"].to_pylist(), strict=True) if r == reading]
    if not parts:
        return {}
    row, place, longest = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((place, row))
    row, place, longest = row[order], place[order], longest[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1])])
    if not new.all():  # a suffix that begins a range was merged in two
        at = np.flatnonzero(new)
        row, place, longest = row[at], place[at], np.maximum.reduceat(longest, at)
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    ends = [*first[1:], len(row)]
    return {int(row[a]): (place[a:b].astype(np.int64), longest[a:b].astype(np.int64)) for a, b in zip(first, ends, strict=True)}


def _marked(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True where some [start, end) lies over a place of n."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, ends, -1)
    return np.cumsum(change[:n]) > 0


def spans_of(ahead, behind, exact, params: SuffixParams) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the repeats of ``length`` or more that the sorts found for a document."""
    starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for found, backwards in ((ahead, False), (behind, True), (exact, False)):
        if found is not None:
            place, longest = (x[found[1] >= params.length] for x in found)
            start = place + params.gram - longest if backwards else place
            starts.append(start)
            ends.append(start + longest)
    return np.concatenate(starts), np.concatenate(ends)


def owned(raw: np.ndarray, ahead, behind, hasher: Hasher, params: SuffixParams):
    """(first starts, ends, hashes, known): runs of strings of ``length`` that may repeat, one run for each anchor.

    Equal strings have their least hash at the same distance. The anchor with it must
    repeat to the string's end and, with its gram, back to the string's start.
    """
    n = len(raw) - params.length + 1
    a, z = spans_of(ahead, behind, None, params)
    known = _marked(n, a, z - params.length + 1)
    place, longest = ahead
    back = np.zeros(len(place), np.int64)
    if behind is not None:
        at = np.minimum(np.searchsorted(behind[0], place), len(behind[0]) - 1)
        back = np.where(behind[0][at] == place, behind[1][at], 0)
    firsts, lasts, hashes = [], [], []
    for start, h, low in blocks(raw, hasher, params):
        inside = np.flatnonzero((place >= start) & (place < start + len(h)))
        if not len(inside):
            continue
        # Strings next to each other with one least hash are a run.
        run = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        stop, value = np.append(run[1:], len(low)), low[run]
        own = h[place[inside] - start]
        order = np.argsort(own, kind="stable")
        # An anchor belongs to every run of its hash that it can reach; a hash may have several anchors.
        left, right = np.searchsorted(own[order], value), np.searchsorted(own[order], value, "right")
        times = right - left
        which = np.repeat(np.arange(len(run)), times)
        anchor = inside[order[np.repeat(left - np.cumsum(times) + times, times) + np.arange(times.sum())]]
        p = place[anchor]
        first = np.maximum.reduce([run[which] + start, p - params.window + 1, p + params.gram - back[anchor]])
        last = np.minimum.reduce([stop[which] + start, p + 1, p - params.length + longest[anchor] + 1])
        some = first < last
        firsts.append(first[some])
        lasts.append(last[some])
        hashes.append(value[which[some]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *firsts]), np.concatenate([none, *lasts]), np.concatenate([np.zeros(0, np.uint64), *hashes]), known


RESULT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int64()))])


def repeated_bytes(docs: DataFrame, params: SuffixParams = SuffixParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed (starts and ends by turns), a row for each document.

    Removed is every byte under a string of ``length`` bytes that starts in another place
    too, in any document. A null text is empty; texts shorter than ``length`` keep all.
    Repeated rows repeat each other; of equal strings all go, none is favoured. Texts are read
    whole: a task holds ``held_bytes`` of them, or one longer text, and sorts ``run_places``
    suffixes at once. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    root = stage_path(spark, "suffixes")
    docs = docs.select("doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n")).first()
    total, rows = size["bytes"] or 0, max(1, size["n"])
    kept = by_likeness(docs, f"{root}/docs", rows, total, params)
    buckets = bucket_count(spark, total)
    parts = min(1 << 15, max(1, round(total * 2 / (params.window + 1) / params.hashes_per_part)))

    def at_anchors(chunk: int) -> Ask:
        hasher = Hasher()

        def ask(row: int, raw: bytes, values: np.ndarray):
            places, hashes = anchors(values, hasher, params)
            return places, hashes, np.zeros(len(places), bool)

        return ask

    # Strings that start behind the next anchor are that one's to find, and those that end before the last one's end its.
    def ahead(raw: bytes, p: int, before: int, after: int) -> bytes:
        return raw[p : min(p + params.reach, after + params.length)]

    def behind(raw: bytes, p: int, before: int, after: int) -> bytes:
        end = p + params.gram
        return raw[max(0, end - params.reach, before + params.gram - params.length) : end][::-1]

    grams_path, both_path, open_path, strings_path, exact_path = (f"{root}/{n}" for n in ("grams", "both", "open", "strings", "exact"))
    count(kept, grams_path, at_anchors, False, parts, buckets, params)
    forward, backward = _splitters(kept, rows, total, grams_path, buckets, (ahead, behind), params)
    sort(kept, grams_path, both_path, at_anchors, [Reading(ahead, forward), Reading(behind, backward)], buckets, params)
    nothing = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)

    def still_open(chunk: int) -> Ask:
        """The hashes of anchors, marked where one owns a string that is not known to repeat and may."""
        hasher, one, two = Hasher(), results(both_path, buckets, chunk, 0), results(both_path, buckets, chunk, 1)

        def ask(row: int, raw: bytes, values: np.ndarray):
            if row not in one:
                return nothing
            first, last, hashes, known = owned(values, one[row], two.get(row), hasher, params)
            sums = np.concatenate([[0], np.cumsum(~known)])
            return first, hashes, sums[last] > sums[first]

        return ask

    def open_strings(chunk: int) -> Ask:
        """The strings of such anchors, in any document, marked where they are not known to repeat."""
        hasher, one, two = Hasher(), results(both_path, buckets, chunk, 0), results(both_path, buckets, chunk, 1)
        wanted = loaded(open_path, buckets, chunk)

        def ask(row: int, raw: bytes, values: np.ndarray):
            if row not in one or not len(wanted):
                return nothing
            first, last, hashes, known = owned(values, one[row], two.get(row), hasher, params)
            some = among(hashes, wanted)
            if not some.any():
                return nothing
            starts = np.flatnonzero(_marked(len(known), first[some], last[some]))
            found = [np.zeros(0, np.uint64)]
            for a in range(0, len(known), BLOCK):
                inside = starts[(starts >= a) & (starts < a + BLOCK)]
                if len(inside):
                    found.append(hasher.strings(values[a : a + BLOCK + params.length - 1], params.length)[inside - a])
            return starts, np.concatenate(found), ~known[starts]

        return ask

    count(kept, open_path, still_open, True, parts, buckets, params)
    count(kept, strings_path, open_strings, True, parts, buckets, params)
    sort(kept, strings_path, exact_path, open_strings, [Reading(lambda raw, p, before, after: raw[p : p + params.length], forward)], buckets, params)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for b in batches:
            out = []
            for doc_id, row, chunk, text in rows_of([b], "doc_id", "row", "chunk", "text"):
                if chunk != current:
                    current, held = chunk, [results(*x) for x in ((both_path, buckets, chunk, 0), (both_path, buckets, chunk, 1), (exact_path, buckets, chunk, 0))]
                raw = (text or "").encode()
                starts, ends = spans_of(*(h.get(row) for h in held), params)
                if len(raw) > params.length:
                    first, last = stretches(np.frombuffer(raw, np.uint8), params.length + 1)
                    if len(first):
                        starts, ends = np.concatenate([starts, first]), np.concatenate([ends, last])
                if not len(starts):
                    out.append((doc_id, len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), []))
                    continue
                gone = _marked(len(raw), starts, ends)
                edges = np.flatnonzero(np.diff(gone.astype(np.int8), prepend=0, append=0))
                rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                out.append((doc_id, len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(rest).hexdigest(), edges.tolist()))
            columns = list(zip(*out, strict=True)) or [[] for _ in RESULT]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, RESULT, strict=True)], RESULT)

    return kept.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>")


def _splitters(kept: DataFrame, rows: int, total: int, hash_path: str, buckets: int, cuts: tuple, params: SuffixParams) -> list[list[bytes]]:
    """Suffixes of each reading that begin the ranges, up to 32,768; the driver gets these and not the sample.

    The sample is of suffixes that are sorted, so copies and common passages weigh as much
    in it as in the merge. It grows with the number of ranges.
    """
    anchored = total * 2 / (params.window + 1)
    ranges = min(1 << 15, max(1, round(anchored / params.suffixes_per_part)))
    if ranges == 1:
        return [[] for _ in cuts]
    wanted = ranges * params.sample_per_part
    share = max(1, rows // max(params.sample_docs, wanted // 16))
    step = max(1, int(anchored / share / wanted))
    some = kept.where((F.pmod(F.xxhash64("row"), F.lit(share)) == 0) & (F.octet_length("text") >= params.length))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for chunk, held in _by_chunk(batches, params):
            hashes, found = loaded(hash_path, buckets, chunk), [[] for _ in cuts]
            for row, raw in held:
                places, h = anchors(np.frombuffer(raw, np.uint8), hasher, params)
                for place in beside(places)[among(h, hashes)][row % step :: step].tolist():
                    for of, cut in zip(found, cuts, strict=True):
                        of.append(cut(raw, *place))
            which = np.repeat(np.arange(len(cuts)), [len(f) for f in found])
            yield pa.record_batch({"reading": pa.array(which, pa.int64()), "suffix": pa.array([t for f in found for t in f], pa.binary())})

    sample = stage(some.select("row", "chunk", "text").mapInArrow(sampled, "reading long, suffix binary"), "sample")
    every = max(1, sample.count() // (len(cuts) * ranges))

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = every - every // 2
        for b in batches:
            at = np.arange((-seen) % every, b.num_rows, every)
            seen += b.num_rows
            yield b.take(pa.array(at))

    ordered = sample.repartitionByRange(max(2, ranges // 64), "reading", "suffix").sortWithinPartitions("reading", "suffix")
    chosen: list[set[bytes]] = [set() for _ in cuts]
    for r in ordered.mapInArrow(thinned, sample.schema).collect():
        chosen[r.reading].add(bytes(r.suffix))
    return [sorted(c) for c in chosen]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents")).drop("removed")
