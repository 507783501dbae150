import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfcast.llm import packing


def bins_of(segments):
    bins = {}
    for length, _, count, first, per, offset in segments.tolist():
        for i in range(count):
            bins.setdefault(first + i // per, []).append((offset + i % per * length, length))
    return bins


def one_by_one(lengths, params):
    """Vector best-fit decreasing, piece by piece."""
    full, weights, bins = np.array([params.tokens, params.documents, params.attention], float), np.array(params.weights), []
    for n in sorted(lengths, reverse=True):
        need = np.array([n, 1, n * n], float)
        fits = [i for i, b in enumerate(bins) if (b >= need).all()]
        if not fits:
            bins.append(full - need)
            continue
        score = (lambda b: (weights * ((b - need) / full) ** 2).sum()) if params.rule == "norm" else (lambda b: -(weights * need * b / full**2).sum())
        best = min(fits, key=lambda i: score(bins[i]))
        bins[best] = bins[best] - need
    return len(bins)


@pytest.mark.parametrize(
    "params", [packing.PackingParams(), packing.PackingParams(documents=3), packing.PackingParams(documents=4, attention=600_000, weights=(1, 1, 1)), packing.PackingParams(documents=5, weights=(1, 0.5, 0.5), rule="dot")]
)
def test_capacities_hold_and_bins_are_as_few_as_one_by_one(params):
    lengths = np.random.default_rng(0).integers(1, 770, 800)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    bins = bins_of(packing.best_fit(counts, params))
    assert sum(map(len, bins.values())) == len(lengths) and sorted(bins) == list(range(len(bins)))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()]
        assert sum(n for _, n in places) <= params.tokens and len(places) <= params.documents and sum(n * n for _, n in places) <= params.attention
    assert len(bins) <= 1.01 * one_by_one(lengths.tolist(), params) + 1


def test_pieces_are_those_of_the_tokenizer(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000, "a <|endoftext|> b"), (1001, None), (1002, "x" * 9000 + " y" * 3000)]
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, bins = {}, {}
    for r in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in rows:
        ids = [*full.encode(text or "", add_special_tokens=False).ids, 2]
        pieces = sorted(got[doc_id])
        assert [p for p, *_ in pieces] == list(range(len(pieces))) and all(n == 1024 for _, _, n, _ in pieces[1:])
        assert sum(n for _, _, n, _ in pieces) == len(ids)
        for _, a, n, crc in pieces:
            assert crc == zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()] and sum(n for _, n in places) <= 1024
    tokens = sum(n for p in bins.values() for _, n in p)
    assert len(bins) <= -(-tokens // 1024) + 2
