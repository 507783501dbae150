import numpy as np
import pytest
import xxhash

from shelfcast.llm import simhash


def fingerprints():
    rng = np.random.default_rng(1)
    found = []
    for _ in range(150):
        base = int(rng.integers(0, 2**63))
        found.append(base)
        for _ in range(rng.integers(0, 12)):
            x = base
            for k in rng.integers(0, 64, rng.integers(0, 6)):
                x ^= 1 << int(k)
            found.append(x)
    for _ in range(600):  # one dense group
        x = found[0]
        for k in rng.integers(0, 24, rng.integers(0, 8)):
            x ^= 1 << int(k)
        found.append(x)
    return np.unique(np.array(found, np.uint64))


def groups(fps):
    """Smallest place that each fingerprint reaches, by all pairs."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        new = np.array([label[row].min() for row in near])
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize("bucket", [20_000, 50])
def test_links_give_the_groups_of_all_pairs(spark, bucket):
    fps = fingerprints()
    table = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = simhash.components(simhash.linked(table, simhash.SimHashParams(bucket=bucket))).toPandas()
    name = dict(zip(found.node, found.component, strict=True))
    mine = [name.get(int(x), int(x)) for x in fps.view(np.int64)]
    want = groups(fps).tolist()
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_fingerprint_by_bits():
    text = "The quick  brown\nfox jumps over the lazy dog and the quick brown fox jumps again"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text, simhash.SimHashParams()) % (1 << 64) == want
    short = xxhash.xxh64_intdigest(b"one two", 42)
    assert simhash.fingerprint("One  TWO", simhash.SimHashParams()) % (1 << 64) == short
    assert simhash.fingerprint(None, simhash.SimHashParams()) == simhash.fingerprint(" ", simhash.SimHashParams()) == 0


def test_chains_of_copies_are_one_component(spark):
    rows = [(i, f"text number {i % 3} with words that go on and on for a while") for i in range(30)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_text = {}
    for r in found:
        by_text.setdefault(r.doc_id % 3, set()).add(r.component_id)
    assert all(len(v) == 1 for v in by_text.values())


def test_one_row_of_each_group_stays_whatever_its_columns(spark):
    """Repeated rows, a doc_id with two texts of one fingerprint, null ids, columns named like the own ones."""
    text = "words that go on and on for a while until they end"
    rows = [(7, text, 1, "a", "x"), (3, text.upper(), 2, "b", "y"), (3, text, 3, "c", "z"), (3, text, 3, "c", "z"), (None, text, 4, "d", "u"), (None, "other " * 9 + "plain text", 5, "e", "v"), (None, "other " * 9 + "plain text", 5, "e", "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, FP int, row string, text_hash string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    found = sorted(map(tuple, kept.collect()), key=str)
    assert len(found) == 2 and found[0][0] == 3 and found[1][0] is None and found[0] in rows
    again = simhash.keep_one(docs.repartition(5).orderBy("row")).collect()
    assert sorted(map(tuple, again), key=str) == found


def test_texts_are_hashed_once(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "x") for i in range(50)], "doc_id long, text string, source string")
    plan = simhash.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Aggregate" in plan
