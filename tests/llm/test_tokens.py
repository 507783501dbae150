import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from shelfcast.llm import tokens

SF = "/root/testdata/sf0.01"
ODD = [
    "", " ", "a <|endoftext|> b", "<|endoftext|>" * 3, "x<|endoftext|>y \n\n  z", "é é ﬁ   　x \x1c,\x1c \u0085.",
    "x" * 90_000 + " y" * 30_000, "12345 " * 9000 + "abc123" * 9000, "日本語、テキスト。" * 9000, "\n" * 50_000 + " a", "word,word;" * 9000,
    "_,_,_," * 9000, "½5Ⅷ1²3" * 9000, "it's 'til they'll've " * 5000, ("text " * 400 + "<|endoftext|>") * 30,
]


@pytest.fixture(scope="module")
def full():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_a_whole_table_and_odd_texts(spark, full):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)]
    want = [(i, len(t.encode()), len(full.encode(t, add_special_tokens=False).ids)) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for params in (tokens.TokenCountParams(), tokens.TokenCountParams(piece_chars=64, batch_bytes=10_000)):
        found = tokens.token_counts(docs, params).collect()
        assert sorted(tuple(r)[:3] for r in found) == sorted(want)
        assert all(r.over_limit == (r.n_tokens > 1024) for r in found) and any(r.over_limit for r in found)


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_other_files(spark, name):
    rows = [(i, t) for i, t in enumerate(ODD) if len(t) < 60_000]
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        want = [len(ids) for ids in sentencepiece.SentencePieceProcessor(model_file=path).encode([t for _, t in rows])]
    else:
        other = Tokenizer.from_file(path)
        want = [len(other.encode(t, add_special_tokens=False).ids) for _, t in rows]
    found = tokens.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), tokens.TokenCountParams(name)).collect()
    assert [r.n_tokens for r in sorted(found)] == want


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "twice"), (3, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 n_tokens", "2 n_bytes")
    found = sorted((tuple(r) for r in tokens.token_counts(docs).collect()), key=str)
    assert [r[:2] for r in found] == [(1, 0), (2, 0), (3, 5), (3, 5), (None, 5)] and [r[2] for r in found[:2]] == [0, 0]
    assert tokens.token_counts(docs.limit(0)).count() == 0


def test_slices_hold_about_as_many_bytes():
    import pyarrow as pa

    texts = pa.array(["a" * 10] * 50 + [None] + ["b" * 500] + ["c"] * 100)
    slices = list(tokens.by_bytes(texts, 100))
    assert sum(n for _, n in slices) == len(texts) and [a for a, _ in slices][1:] == [a + n for a, n in slices][:-1]
    assert all(sum(len(t or "") for t in texts.slice(a, n).to_pylist()) <= 100 or n == 1 for a, n in slices)
