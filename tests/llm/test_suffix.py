import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from shelfcast.llm import suffix


def plain(docs, length):
    """Every string of ``length`` in a dictionary."""
    raws = [(i, (t or "").encode()) for i, t in docs]
    counts = Counter(r[k : k + length] for _, r in raws for k in range(len(r) - length + 1))
    out = []
    for i, r in raws:
        gone = np.zeros(len(r), bool)
        for k in range(len(r) - length + 1):
            if counts[r[k : k + length]] > 1:
                gone[k : k + length] = True
        n_spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        out.append((i, len(r), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rnd = random.Random(3)
    text = lambda n: "".join("".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9))) for _ in range(n))
    passages = [text(rnd.randint(20, 90)) for _ in range(6)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            part = rnd.choice(passages) if rnd.random() < 0.5 else text(rnd.randint(1, 80))
            if rnd.random() < 0.4:
                a = rnd.randrange(len(part))
                part = part[a : a + rnd.randint(30, 400)]
            parts.append(part)
        docs.append((i, "".join(parts)))
    return docs + [(100, None), (101, "ab" * 500), (102, "x" * 700), (103, "x" * 199), (104, docs[5][1]), (105, docs[5][1][:-3])]


@pytest.mark.parametrize(
    "params",
    [
        suffix.SuffixParams(),
        suffix.SuffixParams(chunk_bits=3, hashes_per_part=50, suffixes_per_part=40),
        suffix.SuffixParams(length=60, gram=20, chunk_bits=2),
        suffix.SuffixParams(suffixes_per_part=10, sample_per_part=400, held_bytes=1_500, run_places=7),
    ],
)
def test_against_a_dictionary_of_strings(spark, params):
    docs = corpus()
    got = suffix.repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string"), params).collect()
    assert sorted(tuple(r)[:5] for r in got) == plain(docs, params.length)


def test_stretches_of_one_byte(spark):
    docs = [(n, "x" * n) for n in (199, 200, 201, 202, 300, 301, 302, 403)]
    docs += [(1000 + n, f"left {n % 3} " + "x" * n + f" right {n % 2}") for n in (99, 100, 101, 150, 199, 200, 201, 202, 299, 450, 451)]
    docs += [(2000, "y" * 250 + "x" * 500 + "y" * 250), (2001, "z" + "x" * 200 + "y" * 201), (2002, "xy" * 300), (2003, "q" * 300_000)]
    got = suffix.repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:5] for r in got) == plain(docs, 200)
    places, _ = suffix.anchors(np.frombuffer(b"q" * 300_000, np.uint8), suffix.Hasher(), suffix.SuffixParams())
    assert places.tolist() == [0, 300_000 - 100]


def test_ranges_part_strings_with_a_long_common_start(spark):
    rnd = random.Random(9)
    start = "".join(rnd.choice("abcdefgh") for _ in range(260))
    docs = [(i, start + "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 120)))) for i in range(80)]
    docs += [(100 + i, "pre " * i + start[: rnd.randint(150, 260)] + docs[i][1][260:]) for i in range(20)]
    params = suffix.SuffixParams(chunk_bits=3, suffixes_per_part=20, sample_per_part=200)
    seen = []
    original = suffix._splitters
    try:
        suffix._splitters = lambda *x: seen.append(original(*x)) or seen[-1]
        got = suffix.repeated_bytes(spark.createDataFrame(docs, "doc_id long, text string"), params).collect()
    finally:
        suffix._splitters = original
    assert sorted(tuple(r)[:5] for r in got) == plain(docs, 200)
    assert any(suffix.prefix(a, b) >= 100 for found in seen[0] for a, b in zip(found, found[1:], strict=False))


def test_a_text_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(suffix, "BLOCK", 64)
    params, hasher = suffix.SuffixParams(length=60, gram=20), suffix.Hasher()
    raw = np.frombuffer("".join(t or "" for _, t in corpus()).encode(), np.uint8)
    small = suffix.anchors(raw, hasher, params)
    monkeypatch.setattr(suffix, "BLOCK", 1 << 20)
    whole = suffix.anchors(raw, hasher, params)
    assert (small[0] == whole[0]).all() and (small[1] == whole[1]).all()


def test_merge_finds_the_longest_shared_prefix():
    rnd = random.Random(5)
    texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(200)]
    runs, coded = [sorted(set(texts[i::7])) for i in range(7)], []
    for run in runs:
        coded.append([(t[suffix.prefix(p, t) :], suffix.prefix(p, t), False) for p, t in zip([b"", *run], run, strict=False)])
    found = suffix.merge(coded)
    every = [(i, t) for i, run in enumerate(runs) for t in run]
    for i, run in enumerate(runs):
        for t, n in zip(run, found[i], strict=True):
            assert n == max(suffix.prefix(t, o) for j, o in every if (j, o) != (i, t))


def test_suffixes_end_with_the_strings_of_the_next_anchor(spark, monkeypatch):
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    docs = spark.createDataFrame([(i, passage[:2500] if i % 2 else passage[400:]) for i in range(4)], "doc_id long, text string")
    readings, sort = [], suffix.sort
    monkeypatch.setattr(suffix, "sort", lambda *a: (readings.append(a[4]), sort(*a)))
    found = {r.doc_id: r.removed for r in suffix.repeated_bytes(docs).collect()}
    assert found == {0: [0, 2600], 1: [0, 2500], 2: [0, 2600], 3: [0, 2500]}
    params, raw = suffix.SuffixParams(), passage.encode()
    places = suffix.beside(suffix.anchors(np.frombuffer(raw, np.uint8), suffix.Hasher(), params)[0])[1:-1].tolist()
    ahead, behind = ([how.cut(raw, *p) for p in places] for how in readings[0])
    for (p, before, after), a, b in zip(places, ahead, behind, strict=True):
        assert a == raw[p : after + params.length] and b[::-1] == raw[max(0, before + params.gram - params.length) : p + params.gram]
    assert sum(map(len, ahead)) < 0.9 * params.reach * len(places) and suffix._arrays(suffix._packed([(b"ab", 3, [(1 << 40, 5), (2, 6)])]))[3].tolist() == [2]


def test_copies_come_to_one_chunk_and_large_groups_are_spread(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(400))
    firsts = [text() for _ in range(60)]
    docs = [(i * 4 + k, t) for k in range(4) for i, t in enumerate(firsts)] + [(1000 + i, None if i % 2 else "same " * 60) for i in range(1200)]
    params = suffix.SuffixParams(chunk_bits=10, rows_per_part=100)
    kept = suffix.by_likeness(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), f"file://{tmp_path}/docs", len(docs), 0, params)
    rows = kept.collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((i, t or "") for i, t in docs) and len({r.row for r in rows}) == len(docs)
    chunks = {}
    for r in rows:
        chunks.setdefault(r.text, set()).add(r.chunk)
    assert all(len(chunks[t]) == 1 for t in firsts) and len({c for t in firsts for c in chunks[t]}) > 5
    assert len(chunks["same " * 60]) > 1 and len(chunks[None]) > 1
