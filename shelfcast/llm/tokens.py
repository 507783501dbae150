"""Token counts (operator 11): lengths only, from batches of about equal bytes.

Texts are cut where no token can cross, so a long text never becomes one list of ids, and the
pieces are encoded in batches that hold about the same number of bytes whatever the texts' lengths.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.llm.common import table


@dataclass(frozen=True)
class TokenCountParams:
    """``tokenizer`` is a file that ``public_tokenizers.path`` finds: ``.json`` or ``.model``.

    ``piece_chars`` is the length from which a text is cut, ``batch_bytes`` what is encoded at once,
    ``limit`` the tokens above which a text is over the limit.
    """

    tokenizer: str = "byte_bpe_50k.json"
    limit: int = 1024
    piece_chars: int = 32 << 10
    batch_bytes: int = 1 << 20


#: Places where byte-level pre-tokenization always cuts: before a blank or line end after something
#: else, before a sign after a letter or digit, between an ASCII letter and a digit. No special
#: token's string holds such a place (``counter`` makes sure).
SAFE = re.compile(r"(?<=\S)(?=[ \n])|(?<=[^\W_])(?=[,.;:!?。，、！？：；])|(?<=[A-Za-z])(?=[0-9])")


def pieces(text: str, size: int, cut: re.Pattern[str] | None = SAFE) -> Iterator[str]:
    """``text`` in pieces of at least ``size`` characters that tokenize as they do together.

    A stretch without a safe place stays whole.
    """
    start = 0
    while cut is not None and len(text) - start > size:
        found = cut.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def byte_ranks(path: str):
    """The byte-level vocabulary beside the tokenizer file ``path``, with the library's own splitting."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def counter(name: str) -> tuple[Callable[[list[str]], list[int]], re.Pattern[str] | None]:
    """texts -> numbers of tokens for the tokenizer ``name``, and where its texts may be cut.

    A byte-level file with its ranks beside it is encoded from these, which gives the same ids several
    times faster; texts with a special token's string go through the file. Other files are encoded
    whole: their normalisers may look across any place.
    """
    import public_tokenizers

    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], None
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(path)
    full.no_truncation()
    full.no_padding()

    def plainly(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in full.encode_batch(texts, add_special_tokens=False)]

    special = [t.content for t in full.get_added_tokens_decoder().values()]
    byte_level = full.normalizer is None and type(full.pre_tokenizer).__name__ == "ByteLevel"
    if not byte_level or full.pre_tokenizer.add_prefix_space or any(SAFE.search(s) for s in special):
        return plainly, None
    ranks = path.removesuffix(".json") + ".tiktoken"
    if not os.path.exists(ranks):
        return plainly, SAFE
    fast = byte_ranks(ranks)

    def count(texts: list[str]) -> list[int]:
        marked = [any(s in t for s in special) for t in texts]
        own = iter(plainly([t for t, m in zip(texts, marked, strict=True) if m]))
        return [next(own) if m else len(fast.encode_ordinary(t)) for t, m in zip(texts, marked, strict=True)]

    return count, SAFE


def by_bytes(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of a text column that hold about ``most`` bytes, or one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, stop - start
        start = stop


def token_counts(docs: DataFrame, params: TokenCountParams = TokenCountParams()) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row for each document.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows are counted each for itself; ties do
    not arise; an empty table gives no rows; columns other than doc_id and text are not read. A long
    text is cut at safe places and only its running count is kept. Nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, cut = counter(params.tokenizer)
        for b in batches:
            texts = b.column("text")
            n_tokens = np.zeros(b.num_rows, np.int64)
            waiting, owners, held = [], [], 0

            def encode() -> None:
                nonlocal waiting, owners, held
                np.add.at(n_tokens, owners, lengths(waiting))
                waiting, owners, held = [], [], 0

            for start, rows in by_bytes(texts, params.batch_bytes):
                for row, text in enumerate(texts.slice(start, rows).to_pylist(), start):
                    for piece in pieces(text or "", params.piece_chars, cut):
                        waiting.append(piece)
                        owners.append(row)
                        held += len(piece)
                        if held >= params.batch_bytes:
                            encode()
            if waiting:
                encode()
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            yield pa.record_batch([b.column("doc_id"), n_bytes, pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])

    found = docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return found.withColumn("over_limit", F.col("n_tokens") > params.limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
