"""Periodic run detection (operator 12): longest common extensions over a difference cover.

Only the suffixes at places whose remainder lies in a difference cover are sorted. Any two places
are in step with two sorted ones after a few words, so the longest common extension of any two is
a few word comparisons and one range minimum over the sorted suffixes' common prefixes. A harmonic
grid (steps in proportion to the period) puts a place in every run of every period.

Several documents are searched at once: words that occur nowhere else part them, so that nothing
extends from one into the next.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import table
from shelfcast.llm.tokens import by_bytes

#: Remainders whose differences give every remainder of the modulus.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (1, 5, 11, 24, 25, 27)}


@dataclass(frozen=True)
class RunParams:
    """A run has at least ``least_words`` words and ``least_repeats`` periods.

    ``modulus`` picks the difference cover; ``batch_bytes`` of text are searched together, and
    ``grid_places`` of the grid at once.
    """

    least_words: int = 24
    least_repeats: int = 3
    modulus: int = 13
    batch_bytes: int = 1 << 20
    grid_places: int = 1 << 20


class Extensions:
    """Longest common extensions of places in the word numbers ``x``."""

    def __init__(self, x: np.ndarray, modulus: int):
        v, cover = modulus, np.array(COVERS[modulus])
        top = int(x.max(initial=0)) + 1
        self.v, self.size = v, len(x)
        # Words that occur once end the sequence, so that nothing is equal beyond it.
        self.x = x = np.concatenate([x, np.arange(top, top + 2 * v)])
        chosen = np.isin(np.arange(self.size + v) % v, cover)
        places = np.flatnonzero(chosen)
        self.index = np.full(len(x) + 1, -1, np.int32)
        self.index[places] = np.arange(len(places))
        levels = self._sorted(places, top + 2 * v)
        self.rank = levels[-1]
        self._minima(self._common(places, levels))
        # How far two places of given remainders must go to be both in the cover.
        inside = np.isin(np.arange(2 * v) % v, cover)
        steps = np.arange(v)
        both = inside[(steps[:, None, None] + steps) % v] & inside[(steps[None, :, None] + steps) % v]
        self.delta = both.argmax(2).astype(np.int32)

    def _sorted(self, places: np.ndarray, top: int) -> list[np.ndarray]:
        """Ranks of the sampled suffixes by their first v, 2v, 4v .. words, until all differ."""
        bits = int(top).bit_length()
        per = 63 // bits
        keys = []
        for first in range(0, self.v, per):
            key = np.zeros(len(places), np.int64)
            for t in range(first, min(first + per, self.v)):
                key = (key << bits) | self.x[places + t]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(places), bool)
        for key in keys:
            ordered = key[order]
            new[1:] |= ordered[1:] != ordered[:-1]
        levels, step = [self._ranks(order, new)], self.v
        while len(places) and levels[-1].max() + 1 < len(places):
            rank = levels[-1].astype(np.int64)
            after = self.index[np.minimum(places + step, len(self.index) - 1)]
            key = rank * (len(places) + 1) + np.where(after < 0, 0, rank[after] + 1)
            order = np.argsort(key, kind="stable")
            ordered = key[order]
            new = np.zeros(len(places), bool)
            new[1:] = ordered[1:] != ordered[:-1]
            levels.append(self._ranks(order, new))
            step *= 2
        return levels

    @staticmethod
    def _ranks(order: np.ndarray, new: np.ndarray) -> np.ndarray:
        rank = np.empty(len(order), np.int32)
        rank[order] = np.cumsum(new)
        return rank

    def _common(self, places: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
        """Common words of each sampled suffix and the next one in order."""
        ordered = np.empty_like(places)
        ordered[self.rank] = places
        a, b = ordered[:-1], ordered[1:]
        shared = np.zeros(len(a), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            i = self.index[np.minimum(a + shared, len(self.index) - 1)]
            j = self.index[np.minimum(b + shared, len(self.index) - 1)]
            same = (i >= 0) & (j >= 0) & (levels[k][i] == levels[k][j])
            shared[same] += self.v << k
        return shared + self._compared(a + shared, b + shared, np.full(len(a), self.v))

    def _minima(self, common: np.ndarray) -> None:
        self.table = [common.astype(np.int32)]
        width = 1
        while 2 * width <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def _compared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and ``b`` on, word by word, at most ``most``."""
        equal = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        t = 0
        while len(live):
            live = live[self.x[a[live] + t] == self.x[b[live] + t]]
            t += 1
            equal[live] = t
            live = live[most[live] > t]
        return equal

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from ``a`` and from ``b`` on; ``a`` lies before ``b`` everywhere."""
        steps = self.delta[a % self.v, b % self.v].astype(np.int64)
        equal = self._compared(a, b, steps)
        far = np.flatnonzero(equal == steps)
        i = self.rank[self.index[a[far] + steps[far]]]
        j = self.rank[self.index[b[far] + steps[far]]]
        low, width = np.minimum(i, j), np.abs(i - j)
        least = np.zeros(len(far), np.int64)
        level = np.frexp(width.astype(float))[1] - 1
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            minima = self.table[k]
            least[at] = np.minimum(minima[low[at]], minima[low[at] + width[at] - (1 << int(k))])
        equal[far] += least
        return equal


def runs_of(texts: list[np.ndarray], params: RunParams = RunParams()) -> list[np.ndarray]:
    """For each sequence of word numbers its runs (start, length, period), by start, then period.

    A run is a longest stretch with a smallest period that is long enough. The word numbers of all
    sequences are of one vocabulary.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    top = max((int(t.max()) + 1 for t in texts if len(t)), default=0)
    parted = [part for k, t in enumerate(texts) for part in (t, np.array([top + k], np.int64))]
    firsts = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
    x = np.concatenate(parted).astype(np.int64) if parted else np.zeros(0, np.int64)
    largest = sizes // params.least_repeats * (sizes >= params.least_words)
    owner = np.repeat(np.arange(len(texts)), largest)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(largest) - largest, largest) + 1
    # Words equal to the one a period later: so many in a row has a run at least.
    least = np.maximum(np.maximum(params.least_words - period, (params.least_repeats - 1) * period), 1)
    step = (least + 1) // 2
    places = -(-(sizes[owner] - period) // step)
    found, extensions = [], None
    ends = np.cumsum(places)
    start = 0
    while start < len(owner):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + params.grid_places, "right")))
        part = np.arange(start, stop)
        pair = np.repeat(part, places[part])
        at = (np.arange(len(pair)) - np.repeat(ends[part] - places[part] - before, places[part])) * step[pair]
        place = firsts[owner[pair]] + at
        same = np.flatnonzero(x[place] == x[place + period[pair]])
        start = stop
        if not len(same):
            continue
        if extensions is None:
            extensions = Extensions(x, params.modulus)
        pair, at, place = pair[same], at[same], place[same]
        ahead = extensions.of(place, place + period[pair])
        long = ahead >= least[pair] - step[pair] + 1
        pair, at, place, ahead = pair[long], at[long], place[long], ahead[long]
        # The first place of the grid in a run stands for it.
        covered = np.zeros(len(pair), bool)
        covered[1:] = (pair[1:] == pair[:-1]) & (place[:-1] + ahead[:-1] >= place[1:])
        pair, at, place, ahead = pair[~covered], at[~covered], place[~covered], ahead[~covered]
        q, low, high = period[pair], np.zeros(len(pair), np.int64), np.minimum(step[pair] - 1, at)
        while (low < high).any():
            middle = (low + high + 1) // 2
            back = place - middle
            reached = extensions.of(back, back + q) >= middle
            low, high = np.where(reached, middle, low), np.where(reached, high, middle - 1)
        kept = low + ahead >= least[pair]
        found.append(np.stack([owner[pair], at - low, low + ahead + q, q], 1)[kept])
    rows = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    # A run is also found with multiples of its period: the smallest counts.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)])]
        rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    cuts = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[a:z, 1:] for a, z in zip(cuts, cuts[1:], strict=False)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of ``n`` words no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(change[:-1]) == 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def periodic_runs(docs: DataFrame, params: RunParams = RunParams(), rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period), collapsed; one row for each document.

    ``collapsed`` holds the words that no run holds after its first period, joined by blanks.
    ``rewrite`` may change a document's words before the search. Null and empty texts have no words,
    no runs and an empty ``collapsed``. Repeated rows are searched each for itself; runs with the
    same start are ordered by period; an empty table gives no rows; other columns are not read. A
    long text is searched whole, by itself: the memory needed grows with its words, some 100 bytes
    each. Nothing is shuffled.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text")
            for start, rows in by_bytes(texts, params.batch_bytes):
                ids = b.column("doc_id").slice(start, rows)
                words = [(t or "").encode().split() for t in texts.slice(start, rows).to_pylist()]
                if rewrite is not None:
                    words = [rewrite(i, w) for i, w in zip(ids.to_pylist(), words, strict=True)]
                seen: dict[bytes, int] = {}
                numbers = [np.fromiter((seen.setdefault(w, len(seen)) for w in ws), np.int64, len(ws)) for ws in words]
                runs = runs_of(numbers, params)
                collapsed = [
                    b" ".join([w for w, k in zip(ws, kept_words(len(ws), r).tolist(), strict=True) if k] if len(r) else ws).decode()
                    for ws, r in zip(words, runs, strict=True)
                ]
                listed = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x.tolist()] for x in runs]
                columns = [ids, pa.array(map(len, words), pa.int64()), pa.array(listed, pa.list_(RUN)), pa.array(collapsed, pa.string())]
                yield pa.record_batch(columns, ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(
        search, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    )


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with a period put into every document whose id's checksum divides by 10.

    A document without an id is left as it is.
    """
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _greatest(runs: Column) -> Column:
    """The run with the greatest length / period, compared as whole numbers; the first of equal ones."""
    more = lambda best, r: r.length * best.period > best.length * r.period
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    return F.aggregate(runs, none, lambda best, r: F.when(best.isNull() | more(best, r), r).otherwise(best))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    best = found.withColumn("best", _greatest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
