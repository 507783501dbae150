"""Personal data (operator 4): plain patterns, and offset-preserving deobfuscation.

A transducer rewrites disguised writing (look-alike letters, spelled digits, at/dot
words) and keeps for every character it puts out the source characters it stands for.
The patterns are run over what it puts out and their spans are mapped back.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from shelfcast.llm.common import batch_of, table

KINDS = ("email", "ip", "card", "phone")

# The patterns of the contract. A number's run of digits is entered at its
# first digit only; entering later can't match if that failed, and takes quadratic time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "α": "a", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X", "ı": "i", "ɑ": "a", "ɡ": "g", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
    "․": ".", "。": ".", "﹫": "@",
}
# Digits spelled in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
INVISIBLE = "​‌‍⁠﻿­"

# Letters that stand for digits.
DIGIT_LETTERS = {"l": "1", "I": "1", "O": "0", "o": "0"}
# The words for at with the word for dot that goes with each where neither is bracketed.
# "at" and "point" are no pair, as "at some point in" is prose.
WORD_PAIRS = {"at": "punkt", "arobase": "point", "arroba": "punto"}

_DIGIT = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_DOT = r"(?:dot|point|punkt|punto)"
_GAP = r"[ \t-]{1,3}"
_BLANK = r"[ \t]{1,3}"
_AT_WORD = r"(?:at|arobase|arroba)"
_NUMBER = rf"(?:{_DIGIT}|[0-9]++)"
#: Digits, spelled or written, count from four on; a run without any word is left as it is.
SPELLED_RUN = re.compile(rf"(?i)(?<!\w)(?:plus{_GAP}|\+)?{_NUMBER}(?:{_GAP}(?:{_DOT}{_GAP})?{_NUMBER}){{3,}}(?!\w)")
SPELLED_PART = re.compile(rf"(?i)plus|\+|{_DOT}|{_DIGIT}|[0-9]")
DIGIT_LIKE = re.compile(r"(?<![A-Za-z0-9])(?=[lIOo]*[0-9])(?=[0-9]*[lIOo])[0-9lIOo]+(?![A-Za-z0-9])")
BRACKETED = re.compile(
    rf"(?i)[ \t]{{0,3}}[\[({{<][ \t]{{0,3}}(?:({_AT_WORD}|@)|({_DOT}|\.))[ \t]{{0,3}}[\])}}>][ \t]{{0,3}}"
    rf"|(?<=\w){_BLANK}(?:_(?:({_AT_WORD})|({_DOT}))_|\*(?:({_AT_WORD})|({_DOT}))\*){_BLANK}(?=\w)"
)
BARE_AT = re.compile(rf"(?i)(?<=\w)[ \t]{{1,3}}{_AT_WORD}[ \t]{{1,3}}(?=[A-Za-z0-9-]{{1,63}}(?:[ \t]{{1,3}}dot[ \t]{{1,3}}|\.)[A-Za-z0-9-])")
BARE_DOT = re.compile(r"(?i)(?<=\w)[ \t]{1,3}dot[ \t]{1,3}(?=\w)")
WORDED = re.compile(
    r"(?i)(?<=[A-Za-z0-9_%+-])(?:"
    + "|".join(rf"(?:{_BLANK}{at}{_BLANK}|@)[A-Za-z0-9-]++(?:{_BLANK}{dot}{_BLANK}[A-Za-z0-9-]++)+" for at, dot in WORD_PAIRS.items())
    + ")"
)
WORDED_AT = re.compile(rf"(?i)@|{_BLANK}{_AT_WORD}{_BLANK}")
WORDED_DOT = re.compile(rf"(?i){_BLANK}(?:{'|'.join(WORD_PAIRS.values())}){_BLANK}")
WORDED_LAST = re.compile(rf"(?i)(?<=[A-Za-z0-9_%+-]){_BLANK}(?:{'|'.join(WORD_PAIRS.values())}){_BLANK}\Z")
FOREIGN = re.compile("[^\\x00-\\xac\\xae-\\u0130\\u0132-\\u024f]|\\xad")


@lru_cache(maxsize=1 << 16)
def plain(char: str) -> str:
    """The ASCII letter, digit or mark that ``char`` looks like; nothing if it can't be seen; else itself."""
    if char in INVISIBLE:
        return ""
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    form = unicodedata.normalize("NFKC", char)
    return form if len(form) == 1 and form.isascii() and form.isprintable() else char


class Tape:
    """A text with, for each character, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, None, None

    def rewrite(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> None:
        """Put ``edits`` (start, end, [(character, start, end)]), in order and apart, in place of what is there."""
        if not edits:
            return
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        parts, starts, ends, at = [], [], [], 0
        for a, b, out in edits:
            parts.append(self.text[at:a])
            starts += self.start[at:a]
            ends += self.end[at:a]
            for char, x, y in out:
                parts.append(char)
                starts.append(self.start[x])
                ends.append(self.end[y - 1])
            at = b
        self.text = "".join([*parts, self.text[at:]])
        self.start, self.end = starts + self.start[at:], ends + self.end[at:]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.start is None else (self.start[a], self.end[b - 1])


def _worded(text: str) -> list[tuple[int, int, list[tuple[str, int, int]]]]:
    """Edits of addresses whose at and dots are bare words: the domain's, then those of the local part, back to its start."""
    edits, free = [], 0
    for m in WORDED.finditer(text):
        at = WORDED_AT.match(text, m.start())
        own = [(*at.span(), "@")] + [(*d.span(), ".") for d in WORDED_DOT.finditer(text, at.end(), m.end())]
        start = m.start()
        while True:
            while start > free and text[start - 1] in LOCAL_CHARS:
                start -= 1
            # The widest dot word with its blanks: 3 + 5 + 3 characters, and the one before.
            low = max(free, start - 12)
            dot = WORDED_LAST.search(text[low:start])
            if not dot:
                break
            own.insert(0, (low + dot.start(), low + dot.end(), "."))
            start = low + dot.start()
        edits += [(a, b, [(char, a, b)]) for a, b, char in own]
        free = m.end()
    return edits


def normalised(text: str) -> Tape:
    """The transducers, one after the other."""
    tape = Tape(text)
    if not text.isascii():
        found = []
        for m in FOREIGN.finditer(text):
            char = plain(m[0])
            if char != m[0]:
                found.append((m.start(), m.end(), [(char, m.start(), m.end())] if char else []))
        tape.rewrite(found)
    letters = [i for m in DIGIT_LIKE.finditer(tape.text) for i in range(*m.span()) if tape.text[i] in DIGIT_LETTERS]
    tape.rewrite([(i, i + 1, [(DIGIT_LETTERS[tape.text[i]], i, i + 1)]) for i in letters])
    runs = []
    for m in SPELLED_RUN.finditer(tape.text):
        out, words = [], False
        for p in SPELLED_PART.finditer(tape.text, *m.span()):
            word = p[0].lower()
            words = words or word.isalpha()
            out.append((SPELLED.get(word) or ("+" if word == "plus" else "." if word.isalpha() else word), *p.span()))
        if words:
            runs.append((*m.span(), out))
    tape.rewrite(runs)
    tape.rewrite([(*m.span(), [("@" if m[1] or m[3] or m[5] else ".", *m.span())]) for m in BRACKETED.finditer(tape.text)])
    if "dot" in tape.text.lower() or "@" in tape.text or "." in tape.text:
        tape.rewrite([(*m.span(), [("@", *m.span())]) for m in BARE_AT.finditer(tape.text)])
        tape.rewrite([(*m.span(), [(".", *m.span())]) for m in BARE_DOT.finditer(tape.text)])
    lower = tape.text.lower()
    if any(word in lower for word in WORD_PAIRS.values()):
        tape.rewrite(_worded(tape.text))
    return tape


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the local part of a match is all of the run before its @."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = max(free, at)
        at = text.find("@", max(free, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def detect(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((3, *m.span()))
    return found


def spans(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans). A deobfuscated span is added if it holds a character that no base span of its kind does."""
    text = text or ""
    base = detect(text)
    tape = normalised(text)
    if tape.start is None:
        return base, base
    added = set()
    for kind, a, b in detect(tape.text):
        a, b = tape.source(a, b)
        inside = sum(max(0, min(b, y) - max(a, x)) for k, x, y in base if k == kind)
        if inside < b - a:
            added.add((kind, a, b))
    return base, sorted({*base, *added})


def redact(text: str | None) -> str | None:
    """``text`` with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if not text:
        return text
    _, found = spans(text)
    parts, at = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            parts += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*parts, text[at:]])


def _written(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


FOUND = pa.schema(
    [("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]
)


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            base, every = spans(text)
            counts = [sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))]
            rows.append((doc_id, *counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(every), len(every) - len(base)))
        yield batch_of(FOUND, rows)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, spans (all), n_added.

    Offsets are code points, ends exclusive. A null text is empty; a text of any length is
    read whole, in time linear in its length. Matches that start together can only be of
    different kinds, and all are given. Repeated rows are answered each for itself; an empty
    table gives no rows; other columns are ignored.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text``; ``n_chars``, if there, follows; null stays null."""

    def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [redact(t) for t in b.column("text").to_pylist()]
            names = b.schema.names
            columns = list(b.columns)
            columns[names.index("text")] = pa.array(texts, b.schema.field("text").type)
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(change, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
