import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from shelfcast.llm import periods


def plain_runs(words, least=24, repeats=3):
    """Every longest stretch of every period, kept with its smallest period."""
    best = {}
    for q in range(1, len(words) // repeats + 1):
        start = 0
        while start < len(words) - q:
            end = start
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            if end > start and end + q - start >= max(least, repeats * q):
                best.setdefault((start, end + q - start), q)
            start = end + 1
    return sorted((s, n, q) for (s, n), q in best.items())


def cases():
    rng = random.Random(5)
    yield []
    yield [1]
    yield [7] * 200
    yield [1, 2] * 40 + [2, 1] * 30
    for letters in (1, 2, 3, 40):
        for n in (23, 24, 60, 300):
            yield [rng.randrange(letters) for _ in range(n)]
    for _ in range(40):
        words = [rng.randrange(500) for _ in range(rng.randrange(1, 200))]
        for _ in range(rng.randrange(4)):
            unit = [rng.randrange(6) for _ in range(rng.randrange(1, 40))]
            at = rng.randrange(len(words) + 1)
            words[at:at] = (unit * 8)[: rng.randrange(1, 8 * len(unit) + 1)]
        yield words
    a, b = [0], [0, 1]
    while len(b) < 400:  # words in which many periods end and begin
        a, b = b, b + a
    yield b


@pytest.mark.parametrize("modulus", periods.COVERS)
@pytest.mark.parametrize("grid", [1 << 20, 50])
def test_runs_against_every_stretch(modulus, grid):
    given = list(cases())
    params = periods.RunParams(modulus=modulus, grid_places=grid)
    found = periods.runs_of([np.array(w, np.int64) for w in given], params)
    assert [[tuple(r) for r in runs.tolist()] for runs in found] == [plain_runs(w) for w in given]


@pytest.mark.parametrize("modulus", periods.COVERS)
def test_cover_gives_every_difference(modulus):
    cover = periods.COVERS[modulus]
    assert {(a - b) % modulus for a in cover for b in cover} == set(range(modulus))


def test_extensions_against_word_by_word():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 2, 300), np.tile(rng.integers(0, 5, 9), 30), rng.integers(0, 2, 100)])
    a, b = np.sort(rng.integers(0, len(x), (2, 3000)), 0)
    a, b = a[a < b], b[a < b]
    found = periods.Extensions(x, 13).of(a, b)
    for i, j, n in zip(a, b, found, strict=True):
        k = 0
        while j + k < len(x) and x[i + k] == x[j + k]:
            k += 1
        assert n == k


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is not None and h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    milli = None if top[0] is None else 1000 * top[1] // top[2]
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *top, milli, digest(listed), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_against_plain_rows(spark):
    sf = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{sf}/documents.parquet").collect()
    short = {r.doc_id: plain_row(r.doc_id, r.text) for r in given if len(r.text or "") < 12_000}
    found = {r.doc_id: tuple(r) for r in periods.op12_periodic_runs(spark, sf).collect()}
    assert len(found) == len(given) and len(short) > 150
    assert {i: found[i] for i in short} == short
    assert sum(r[1] > 0 for r in found.values()) > 10


def test_odd_rows(spark):
    long = "one two three " * 30_000
    rows = [(1, None), (2, ""), (None, "a " * 30), (3, " \t\n"), (4, long), (4, long), (5, "é ü " * 20 + "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 runs", "2 length", "3 collapsed")
    found = sorted(periods.periodic_runs(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [(r.doc_id, r.n_words, [tuple(x) for x in r.runs]) for r in found] == [
        (1, 0, []), (2, 0, []), (3, 0, []), (4, 90_000, [(0, 90_000, 3)]), (4, 90_000, [(0, 90_000, 3)]),
        (5, 41, [(0, 40, 2)]), (None, 30, [(0, 30, 1)]),
    ]
    assert [r.collapsed for r in found] == ["", "", "", "one two three", "one two three", "é ü x", "a"]
    assert periods.periodic_runs(docs.limit(0)).count() == 0
