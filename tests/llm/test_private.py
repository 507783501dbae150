import random
import re

import pytest

from shelfcast.llm import private

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    found = [(0, *m.span()) for m in EMAIL.finditer(text)]
    found += [(1, *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    found += [(2, *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and private._luhn(digits(m))]
    return found + [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@pytest.mark.parametrize("alphabet", ["a@.1", "1.2 ", "+1 -(.)9", "a.@-é1", "0 -"])
def test_base_against_the_patterns(alphabet):
    rnd = random.Random(1)
    for _ in range(8000):
        text = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        assert private.detect(text) == plain(text), text


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to jane (at) mail [dot] example (dot) com now", "email", "jane (at) mail [dot] example (dot) com"),
        ("to john dot doe at mail dot example dot com", "email", "john dot doe at mail dot example dot com"),
        ("call plus four nine one five one two three four five six seven now", "phone", "plus four nine one five one two three four five six seven"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one"),
        ("an ip one nine two dot one six eight dot zero dot one end", "ip", "one nine two dot one six eight dot zero dot one"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("ｊoe＠mail．com", "email", "ｊoe＠mail．com"),
        ("at 10[.]0[.]0[.]1", "ip", "10[.]0[.]0[.]1"),
        ("an jane (at) mail punkt de bitte", "email", "jane (at) mail punkt de"),
        ("an eva punkt roth at mail punkt example punkt de", "email", "eva punkt roth at mail punkt example punkt de"),
        ("écrire à jane arobase mail point fr", "email", "jane arobase mail point fr"),
        ("a juan punto perez arroba correo punto es", "email", "juan punto perez arroba correo punto es"),
        ("bob _at_ mail _dot_ com", "email", "bob _at_ mail _dot_ com"),
        ("bob *at* mail *dot* com", "email", "bob *at* mail *dot* com"),
        ("ring plus 49 one five one two three four.", "phone", "plus 49 one five one two three four"),
        ("ring +49 one five 1 two three four.", "phone", "+49 one five 1 two three four"),
        ("ring +4l5l234567O now", "phone", "+4l5l234567O"),
        ("card 4111-1111-1111-1lll ok", "card", "4111-1111-1111-1lll"),
        ("ip 192 punkt 168 punkt 0 punkt 1", "ip", "192 punkt 168 punkt 0 punkt 1"),
        ("ip 1O.2.3.4", "ip", "1O.2.3.4"),
    ],
)
def test_disguises_map_back(text, kind, span):
    _, found = private.spans(text)
    assert (kind, span) in [(private.KINDS[k], text[a:b]) for k, a, b in found]
    assert private.redact(text).count(f"[{kind.upper()}]") == 1


def test_clean_prose_is_left_alone():
    for text in ("We met at noon, at the house. Un deux trois.", "Look at this: one two three.", "Ça été à l’école; über äöü", "It ended at some point in May, at one point of four.",
                 "look_at_me.py and a _at_ sign", "Der Punkt ist: at punkt de", "10l of 2 3 4 5 oil, O2 and I 5", "arobase point", None, ""):
        assert private.spans(text) == ([], [])
        assert private.redact(text) == text


@pytest.mark.parametrize("text", ["1" * 100_000, "a@" * 30_000, "+1 " * 30_000, "one " * 30_000, "a dot " * 20_000, " " * 100_000,
                                  "1 2 one " * 20_000, "l" * 100_000, "l1" * 50_000 + "a", "a punkt " * 20_000, "a at b punkt " * 10_000, "a@" + "b punkt " * 20_000, "@" + "a" * 100_000])
def test_long_texts_take_linear_time(text):
    private.spans(text)
