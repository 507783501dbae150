import random

from shelfcast.llm import chat

NAMES = "pair_id part turn role rendered start train_start train_end is_paired".split()
SCHEMA = "conv_id long, turn int, role string, text string"


def shown(role, text):
    head = f"<|im_start|>{(role or '').replace('<|', '< |')}\n"
    return head, f"{(text or '').replace('<|', '< |')}<|im_end|>"


def plain(rows):
    """Turn by turn over sorted sets."""
    low = lambda x: (x is not None, x or 0) if not isinstance(x, str) else (True, x)
    sides, found = {}, []
    for conv, turn, role, text in rows:
        pair = None if conv is None else conv // 2
        sides.setdefault(pair, [{}, {}])[0 if conv is None else conv % 2].setdefault(turn, set()).add((role, text))
    for pair, two in sides.items():
        turns = sorted({*two[0], *two[1]}, key=low)
        fork = next((i for i, t in enumerate(turns) if two[0].get(t) != two[1].get(t)), len(turns))
        for part, side, own in (("prompt", 0, turns[:fork]), ("chosen", 0, turns[fork:]), ("rejected", 1, turns[fork:])):
            start = 0
            for t in own:
                order = lambda r: ((r[0] is not None, r[0] or ""), (r[1] is not None, r[1] or ""))
                for role, text in sorted(two[side].get(t, ()), key=order):
                    head, body = shown(role, text)
                    learnt = part != "prompt" and role == "assistant"
                    spans = (start + len(head), start + len(head) + len(body)) if learnt else (None, None)
                    found.append((pair, part, t, role, f"{head}{body}\n", start, *spans, bool(two[0]) and bool(two[1])))
                    start += len(head) + len(body) + 1
    return sorted(found, key=str)


def got(spark, rows, **params):
    turns = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 part", "2 pair_id", "3 block", "4 start")
    found = chat.preferences(chat.paired(turns), chat.ChatParams(**params))
    assert found.columns == NAMES
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_prompt_is_shared_and_completions_are_masked(spark):
    rows = [
        (0, 0, "system", "Be <|im_start|> kind"), (0, 1, "user", "Hi"), (0, 2, "assistant", "Hello é"), (0, 3, "user", "x"), (0, 4, "assistant", "y"),
        (1, 0, "system", "Be <|im_start|> kind"), (1, 1, "user", "Hi"), (1, 2, "assistant", "Go"),
    ]
    found = got(spark, rows)
    assert found == plain(rows)
    assert [r[1] for r in found].count("prompt") == 2
    for part, want in (("chosen", ["Hello é<|im_end|>", "y<|im_end|>"]), ("rejected", ["Go<|im_end|>"])):
        own = sorted((r for r in found if r[1] == part), key=lambda r: r[5])
        whole = "".join(r[4] for r in own)
        assert [whole[r[6] : r[7]] for r in own if r[6] is not None] == want


def test_odd_conversations(spark):
    rows = [
        (0, 0, "user", "same"), (0, 1, "assistant", "all"), (1, 0, "user", "same"), (1, 1, "assistant", "all"),  # equal sides
        (2, 0, "user", "alone"), (2, 1, "assistant", None),  # one side
        (5, 0, "user", "rejected alone"),
        (6, None, "system", "first"), (6, 0, None, None), (7, None, "system", "first"), (7, 0, None, ""),  # nulls
        (8, 0, "user", "twice"), (8, 0, "user", "twice"), (8, 0, "assistant", "tie"), (9, 0, "user", "twice"), (9, 0, "assistant", "tie"), (9, 3, "assistant", ""),
        (10, 0, "user", "part"), (10, 0, "assistant", "of a turn"), (11, 0, "user", "part"),
        (None, 0, "user", "no number"), (None, 1, "assistant", "none"), (-3, 0, "user", "below"), (-4, 0, "user", "below"),
    ]
    assert got(spark, rows) == plain(rows)
    assert got(spark, rows, block_turns=1) == plain(rows)
    assert got(spark, rows[:0]) == []


def test_generated_conversations_and_a_very_long_one(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(("user", "assistant")), rng.choice("ab")) for c in range(300) for t in range(rng.randrange(1, 6))]
    rows += [(600 + s, t, "assistant", f"word {t}" if t < 1700 else f"word {t + s}") for s in (0, 1) for t in range(3000)]
    found = got(spark, rows)
    assert found == plain(rows)
    assert sum(r[0] == 300 and r[1] == "prompt" for r in found) == 1700


def test_plan_is_native(spark):
    turns = spark.createDataFrame([(0, 0, "user", "x")], SCHEMA)
    plan = chat.preferences(chat.paired(turns))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
