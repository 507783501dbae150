"""The whole quality query against a plain version: counts, references, distances, verdict."""

import math
import re
from collections import Counter, defaultdict

from shelfcast.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RULES = quality.QualityRules()


def char_class(c):
    if not c.isascii():
        return "other alphabet"
    if c in " \t\n\x0b\f\r":
        return "space"
    kinds = (("lower", c.islower()), ("upper", c.isupper()), ("digit", c.isdigit()), ("mark", c in ".,;:!?'\"-()"))
    return next((name for name, is_so in kinds if is_so), "other")


def lower(word):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def divergence(p, q):
    def half(x, y):
        return sum(v * math.log2(v / ((v + y.get(k, 0)) / 2)) for k, v in x.items() if v)

    return math.sqrt(max(0, (half(p, q) + half(q, p)) / 2))


def shares(counts, common=None):
    total = sum(counts.values())
    if common is None:
        return {k: n / total for k, n in counts.items()}
    rest = total - sum(counts[w] for w in common)
    return {w: counts[w] / total for w in common} | {None: rest / total}


def counted(text):
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return words, (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside), failed)


def plain(rows):
    """doc_id, counts, base_failed and the verdict, or None where a distance is too near its bound to tell."""
    chars, words = defaultdict(Counter), defaultdict(Counter)
    for _, lang, text in rows:
        chars[lang].update(map(char_class, text or ""))
        words[lang].update(map(lower, WORD.findall(text or "")))
    refs = {}
    for lang in words:
        if words[lang]:
            common = sorted(words[lang], key=lambda w: (-words[lang][w], w.encode()))[: RULES.common_words]
            refs[lang] = shares(chars[lang]), common, shares(words[lang], common)
    for doc_id, _, text in rows:
        text = text or ""
        own_words, numbers = counted(text)
        found = []
        for by_class, common, by_word in refs.values():
            a = divergence(shares(Counter(map(char_class, text))), by_class) if len(text) >= RULES.guard_chars else 0
            b = divergence(shares(Counter(map(lower, own_words)), common), by_word) if len(own_words) >= RULES.guard_words else 0
            found.append(max(a - RULES.max_class_distance, b - RULES.max_word_distance))
        near = not found or min(found) <= 0
        yield doc_id, *numbers, near and not numbers[-1], bool(found) and abs(min(found)) < 1e-9


def held(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "lang", "text").collect()]
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    got = sorted((tuple(r[n] for n in names) for r in quality.quality(docs).collect()), key=str)
    want = sorted(plain(rows), key=str)
    assert len(got) == len(want)
    assert all(g == w[:-1] or (w[-1] and g[:-1] == w[:-2]) for g, w in zip(got, want, strict=True))
    return got


def test_whole_table_against_a_plain_version(spark):
    got = held(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    rejected = [r for r in got if not r[-1]]
    assert any(not r[-2] for r in rejected) and any(r[-2] for r in rejected) and len(rejected) < len(got) / 2


def test_odd_rows_against_a_plain_version(spark):
    prose = "the cat sat on the mat and the dog lay by the door of the old house while rain fell. "
    varied = " ".join(f"{w}{i}" for i in range(9) for w in ("alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"))
    rows = [
        (1, "en", prose + varied), (1, "en", prose + varied), (2, None, varied.upper()), (3, "en", None), (4, None, ""),
        (5, "xx", "#$%&|<> " * 80), (6, "en", "line a b\nline a b\n\n \nline a b\x0b\nZ" + varied), (7, "fr", "é à\x85ü " * 150),
        (8, "fr", " \n\t" * 200), (9, "en", "one two three four five six seven eight nine ten"), (10, "de", "İ ſ K " * 5 + varied),
    ]
    got = held(spark, spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert len(got) == 11
    assert quality.quality(spark.createDataFrame([], "doc_id long, lang string, text string")).collect() == []
