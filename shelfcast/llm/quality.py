"""Quality rules (operator 8): repetition rules and divergence from language references."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfcast.llm.common import batch_of, stage, table

# The white space between words, and the symbols counted.
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MARKS = ".,;:!?'\"-()"
# Character classes: 0 lower, 1 upper, 2 digit, 3 space, 4 punctuation, 5 other ASCII, 6 non-ASCII.
CLASSES = 7


@dataclass(frozen=True)
class QualityRules:
    """Thresholds. Distances are Jensen-Shannon distances (base 2, from 0 to 1)."""

    min_words: int = 10
    max_repeat_percent: int = 20
    common_words: int = 50
    guard_chars: int = 300
    guard_words: int = 60
    max_class_distance: float = 0.3
    max_word_distance: float = 0.6
    max_languages: int = 256


@dataclass
class Reference:
    classes: np.ndarray
    words: list[bytes]
    shares: np.ndarray = field(repr=False)


MEASURES = pa.schema(
    [
        ("doc_id", pa.int64()),
        *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("class_distance", pa.float64()),
        ("word_distance", pa.float64()),
    ]
)
MEASURES_SQL = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
)


def _class_table() -> np.ndarray:
    classes = np.full(129, 5, np.int64)
    classes[ord("a") : ord("z") + 1] = 0
    classes[ord("A") : ord("Z") + 1] = 1
    classes[ord("0") : ord("9") + 1] = 2
    classes[[ord(c) for c in SPACE]] = 3
    classes[[ord(c) for c in MARKS]] = 4
    classes[128] = 6
    return classes


def class_counts(text: str, classes: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.bincount(classes[np.minimum(points, 128)], minlength=CLASSES)


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two distributions."""
    middle = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / middle), 0.0).sum()
        b = np.where(q > 0, q * np.log2(q / middle), 0.0).sum()
    return math.sqrt(max(0.0, (a + b) / 2))


def repeat_words(words: list[bytes], width: int = 5) -> int:
    """Words inside windows of ``width`` words that the text has twice or more."""
    if len(words) <= width:
        return 0
    windows = list(zip(*(words[i:] for i in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + width - max(end, i)
            end = i + width
    return covered


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language, class and word counts of one task's texts; the dictionary is bounded by flushing."""
    classes, schema = _class_table(), pa.schema([("lang", pa.string()), ("class", pa.int32()), ("word", pa.binary()), ("n", pa.int64())])
    words: dict[str | None, Counter] = {}
    chars: dict[str | None, np.ndarray] = {}

    def flush():
        rows = [(lang, None, w, n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, k, None, int(n)) for lang, c in chars.items() for k, n in enumerate(c)]
        words.clear()
        chars.clear()
        for i in range(0, len(rows), 50_000):
            yield batch_of(schema, rows[i : i + 50_000])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            words.setdefault(lang, Counter()).update(text.encode().lower().split())
            chars[lang] = chars.get(lang, 0) + class_counts(text, classes)
        if sum(map(len, words.values())) > 500_000:
            yield from flush()
    yield from flush()


def references(docs: DataFrame, rules: QualityRules) -> dict[str | None, Reference]:
    """Histograms of each language over all documents.

    Counts are summed in the tasks and again before the shuffle. What reaches the driver is
    ``max_languages`` times (``common_words`` + 7) numbers at most; documents of further
    languages are compared with the nearest reference.
    """
    counts = docs.select("lang", "text").mapInArrow(_count, "lang string, class int, word binary, n long")
    counts = counts.groupBy("lang", "class", "word").agg(F.sum("n").alias("n"))
    counts = stage(counts, "language-counts")
    totals = (
        counts.where("class is null").groupBy("lang").agg(F.sum("n").alias("total"))
        .orderBy(F.desc("total"), "lang").limit(rules.max_languages).collect()
    )
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = (
        counts.where("class is null").withColumn("rank", F.row_number().over(by_count))
        .where(F.col("rank") <= rules.common_words)
    )
    kept = {r.lang for r in totals}
    common: dict = {lang: [] for lang in kept}
    listed = [x for x in kept if x is not None]
    wanted = F.col("lang").isin(listed) if listed else F.lit(False)
    if None in kept:
        wanted = wanted | F.col("lang").isNull()
    for r in top.where(wanted).orderBy("lang", "rank").collect():
        common[r.lang].append((bytes(r.word), r.n))
    chars: dict = {lang: np.zeros(CLASSES) for lang in kept}
    for r in counts.where(F.col("class").isNotNull() & wanted).collect():
        chars[r.lang][r["class"]] = r.n
    return {
        r.lang: Reference(
            chars[r.lang] / max(1.0, chars[r.lang].sum()),
            [w for w, _ in common[r.lang]],
            np.array([n for _, n in common[r.lang]] + [r.total - sum(n for _, n in common[r.lang])]) / r.total,
        )
        for r in totals
    }


def measure(doc_id, lang, text: str | None, refs: dict, rules: QualityRules, classes: np.ndarray) -> tuple:
    """One document's row of MEASURES."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line.strip():
            dup += line in seen
            seen.add(line)
    repeated = repeat_words(words)
    failed = len(words) < rules.min_words or 100 * repeated > rules.max_repeat_percent * len(words)
    by_class, by_word = 0.0, 0.0
    passed = True
    if refs:
        own = class_counts(text, classes)
        total, low = own.sum(), Counter(raw.lower().split())
        judged_chars, judged_words = total >= rules.guard_chars, len(words) >= rules.guard_words
        first = [refs[lang]] if lang in refs else []
        for i, ref in enumerate([*first, *refs.values()]):
            a = distance(own / total, ref.classes) if judged_chars else 0.0
            b = 0.0
            if judged_words:
                found = [low.get(w, 0) for w in ref.words]
                b = distance(np.array([*found, len(words) - sum(found)]) / len(words), ref.shares)
            ok = a <= rules.max_class_distance and b <= rules.max_word_distance
            if i == 0 or ok:
                by_class, by_word, passed = a, b, ok
            if ok:
                break
    spaces = sum(text.count(c) for c in SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    return doc_id, len(words), len(text) - spaces, symbols, dup, repeated, failed, passed and not failed, by_class, by_word


def quality(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per document with the counts, the base rules and the verdict.

    A document fails the base rules with too few words or too many words in repeated
    five-word windows. It fails the method if its character classes or its common words
    are further (Jensen-Shannon) from its language's reference than the thresholds, and
    so are they from every other reference; texts shorter than the guards pass. A null
    text has no words; a null or missing language is one more language. Common words of
    equal count are taken in byte order; texts are judged whole, whatever their length.
    Repeated rows are judged each for itself; an empty table gives no rows; other columns
    are ignored.
    """
    docs = docs.select("doc_id", "text", docs["lang"] if "lang" in docs.columns else F.lit(None).cast("string").alias("lang"))
    refs = references(docs, rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _class_table()
        for b in batches:
            columns = (b.column(n).to_pylist() for n in ("doc_id", "lang", "text"))
            yield batch_of(MEASURES, [measure(*row, refs, rules, classes) for row in zip(*columns, strict=True)])

    return docs.mapInArrow(judge, MEASURES_SQL)


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that ``quality`` keeps, with all their columns."""
    named = docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string"))
    refs = references(named, rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = _class_table()
        for b in batches:
            langs = b.column("lang").to_pylist() if "lang" in b.schema.names else [None] * b.num_rows
            texts = b.column("text").to_pylist()
            kept = [measure(None, lang, t, refs, rules, classes)[7] for lang, t in zip(langs, texts, strict=True)]
            yield b.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(judge, docs.schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
