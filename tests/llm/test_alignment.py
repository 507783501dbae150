import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfcast.llm import alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides():
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def byte_of():
    """Character -> byte of the byte-level alphabet."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_tokens(sides, text):
    """[(id, bytes)] of both tokenizers over the whole text; two empty lists where bytes are lost."""
    first, second = sides
    if not text:
        return [], []
    alphabet = byte_of()
    e = first.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
    b = []
    for i in second.encode(text):
        p = second.id_to_piece(i)
        b.append((i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    same = b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole
    return (a, b) if same else ([], [])


def plain_alignment(a, b):
    """Groups and links, token by token."""
    def spans(side):
        at = 0
        for i, x in side:
            yield i, at, at + len(x)
            at += len(x)

    a, b = list(spans(a)), list(spans(b))
    cuts = sorted({z for _, _, z in a} & {z for _, _, z in b})
    groups, low = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, s, z in side if low <= s and z <= cut) for side in (a, b)))
        low = cut
    pairs = [(i, j) for i, s, z in a for j, t, y in b if s < y and t < z]
    return groups, pairs


def plain_rows(sides, rows):
    found = []
    for doc_id, text in rows:
        a, b = plain_tokens(sides, text)
        found.append((doc_id, len(a), len(b), *plain_alignment(a, b)))
    count = Counter(p for *_, pairs in found for p in pairs)
    most = {}
    for (_, j), n in count.items():
        most[j] = max(most.get(j, 0), n)
    return sorted(
        (
            (i, n_a, n_b, len(g), len(p), sum(count[x] == most[x[1]] for x in p), sum(count[x] for x in p), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for i, n_a, n_b, g, p in found
        ),
        key=str,
    )


def as_rows(df):
    names = "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


ODD = [
    "", " ", "  ", "a", "a ", " a", "a  ", "a\n  b", "a\n b \n\n  c\t d", "x▁y", "▁ ▁", "tab\there", "<s> </s><unk> <0x0A> <|endoftext|>",
    "é é ﬁ ½  　 x", "​﻿ \u0085 \x1c y\x1c  z", "日本語のテキスト、です。 中文", "😀😀 👩‍👩‍👧", "it's they'll 've", "a" * 700, "ab" * 400 + " " * 50 + "12345678901234567890",
    "nul \x00 in \x01\x02 text", "\r\n\r\n  x\r y", "ａｂｃ　ＡＢＣ",
]


def test_rows_against_plain_rows(spark, sides):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 4000]
    rows = given[:120] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(2000, None), (None, "no id"), (5, "twice "), (5, "twice ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 block", "2 n", "3 pair").repartition(3)
    want = plain_rows(sides, rows)
    assert sum(r[1] > 0 for r in want) > 130 and sum(r[1] == 0 for r in want) >= 3
    for params in (alignment.AlignmentParams(), alignment.AlignmentParams(block_bytes=5000, remembered=50)):
        assert as_rows(alignment.aligned(docs, params)) == want
    assert alignment.aligned(docs.limit(0)).count() == 0


def test_division_against_all_cuts():
    rng = np.random.default_rng(3)
    for share in (0.02, 0.3, 0.9):
        a_ends, b_ends, intervals, at, a_low, b_low = [], [], [], 0, 0, 0
        for size in rng.integers(1, 400, 60):
            ends = [np.flatnonzero(rng.random(size) < share) + 1 for _ in range(2)]
            ends = [np.union1d(e, [size]) + at for e in ends]
            intervals.append((a_low, a_low + len(ends[0]), b_low, b_low + len(ends[1])))
            a_ends.append(ends[0]), b_ends.append(ends[1])
            at, a_low, b_low = at + size, a_low + len(ends[0]), b_low + len(ends[1])
        a, b = np.concatenate(a_ends), np.concatenate(b_ends)
        groups = alignment.shared_groups(a, b, np.array(intervals))
        cuts = np.intersect1d(a, b)
        assert (a[groups[:, 1] - 1] == cuts).all() and (b[groups[:, 3] - 1] == cuts).all()
        assert (groups[1:, 0] == groups[:-1, 1]).all() and (groups[1:, 2] == groups[:-1, 3]).all()
        of_a, of_b = alignment.links(a, b, groups)
        assert len(of_a) == len(a) + len(b) - len(groups) and len(set(zip(of_a, of_b, strict=True))) == len(of_a)


def test_a_long_text_without_cuts_or_blanks(spark, sides):
    rng = random.Random(2)
    text = "".join(rng.choice("ab日é") for _ in range(60_000))
    rows = [(1, text), (2, text[:3000])]
    found = {r.doc_id: r for r in alignment.aligned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    a, b = plain_tokens(sides, text[:3000])
    groups, pairs = plain_alignment(a, b)
    assert (found[2].n_a, found[2].n_b, found[2].n_groups, found[2].n_links) == (len(a), len(b), len(groups), len(pairs))
    assert found[1].n_links == found[1].n_a + found[1].n_b - found[1].n_groups > 0


def test_a_block_is_encoded_by_slices(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(100)) for _ in range(300)]
    batch = pa.record_batch({"doc_id": pa.array(range(300), pa.int64()), "text": texts})
    asked, learn = [], alignment.Aligner.learn
    monkeypatch.setattr(alignment.Aligner, "learn", lambda self, new: (asked.append(sum(map(len, new))), learn(self, new)))

    def rows(params):
        return [b.to_pylist() for b in alignment._blocks(iter([batch]), 7, params)]

    found = rows(alignment.AlignmentParams(slice_bytes=10_000))
    assert len(found) == 1 and len(found[0]) == 301 and len(asked) > 20 and max(asked) <= 10_000 + 300
    assert rows(alignment.AlignmentParams(slice_bytes=1 << 30)) == found
