import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from shelfcast.llm import ctw

D = ctw.DEPTH


def steps(text):
    """(context bytes, decision, bit) of every binary decision of a text."""
    b = [255] * D + list(text.encode().lower()) + [255]
    for k in range(D, len(b)):
        for i in range(8):
            yield b[k - D : k], (1 << i) | (b[k] >> (8 - i)), (b[k] >> (7 - i)) & 1


def plain(docs):
    learned = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, nodes = Counter(), defaultdict(lambda: [0, 0])
    for t in learned:
        counts.update([*t.encode().lower().split(), "end"])
        for context, node, bit in steps(t):
            for d in range(D + 1):
                nodes[d, tuple(context[D - d :]), node][bit] += 1
    n, v = sum(counts.values()), len(counts)
    children = defaultdict(list)
    for d, context, node in list(nodes):
        if d:
            children[d - 1, context[1:], node].append((d, context, node))

    def own(s):
        a, b = nodes.get(s, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - 2 * math.lgamma(0.5) - math.lgamma(a + b + 1)

    def weighted(s):
        return own(s) if s[0] == D else np.logaddexp(own(s), below(s)) - math.log(2)

    def below(s):
        return sum(map(weighted, children.get(s, [])))

    def one(context, node, d=0):
        s = d, tuple(context[D - d :]), node
        a, b = nodes.get(s, (0, 0))
        kt = (b + 0.5) / (a + b + 1)
        if d == D:
            return kt
        w = 1 / (1 + math.exp(min(700, below(s) - own(s))))
        return w * kt + (1 - w) * one(context, node, d + 1)

    out = {}
    for i, t in docs:
        tokens = [*t.encode().lower().split(), "end"]
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in tokens)
        score = sum(math.log10(p if bit else 1 - p) for p, bit in ((one(c, node), bit) for c, node, bit in steps(t)))
        out[i] = len(tokens), sum(counts.get(w, 0) > 0 for w in tokens), n, base, score
    return out


def test_against_trees_of_dictionaries(spark):
    docs = list(enumerate(["Hello the the", "abc abc", "", "the Brown fox éà", "the hello"] * 3 + ["only zzz here"]))
    rows = {r.doc_id: r for r in ctw.scored(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, want in plain(docs).items():
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert abs(r.base_score - want[3]) < 1e-9 and abs(r.score - want[4]) < 1e-6


def test_held_out_texts_are_coded_well(spark):
    rows = ctw.op5_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").collect()
    bits = np.mean([r.bits_per_byte for r in rows])
    assert bits < 3.2  # 8 without a model


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.25, 1e3, 1e9])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-9)
