import math
import zlib
from collections import Counter, defaultdict

import pytest

from fieldloom.llm import knlm

TEXTS = ["the cat sat on the mat", "The cat ate", "a dog sat on the cat", None, "", "the the the", "on the mat the dog sat\nand  ate", "b c d e f g", "the cat sat on a log"] * 2 + ["x " * 900]


def brute(train, texts, order):
    """log10 probabilities by dictionaries of word tuples."""
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    sents = [["<s>", *words(t), "</s>"] for t in train]
    counts = {k: Counter() for k in range(1, order + 1)}
    for s in sents:
        for k in range(1, order + 1):
            for i in range(len(s) - k + 1):
                g = tuple(s[i : i + k])
                if k == order and (order > 1 or g != ("<s>",)) or k < order and k > 1 and i == 0:
                    counts[k][g] += 1
    raw = Counter(w for s in sents for w in s[1:])
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    d = {}
    for k, c in counts.items():
        h = Counter(c.values())
        d[k] = knlm._discounts(*(h[i] for i in (1, 2, 3, 4)))
    totals = {k: defaultdict(lambda: [0, 0, 0, 0]) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            t = totals[k][g[:-1]]
            t[0] += n
            t[min(n, 3)] += 1
    n_all, v = sum(raw.values()), len(raw)

    def p(g):
        out = 1 / (v + 1)
        for k in range(1, len(g) + 1):
            tail = g[len(g) - k :]
            t, c = totals[k].get(tail[:-1]), counts[k][tail]
            if t:
                out = max(c - [0, *d[k]][min(c, 3)], 0) / t[0] + sum(x * y for x, y in zip(d[k], t[1:])) / t[0] * out
        return out

    res = []
    for t in texts:
        s = ["<s>", *words(t), "</s>"]
        lm = sum(math.log10(p(tuple(s[max(0, i - order + 1) : i + 1] if order > 1 else s[i : i + 1]))) for i in range(1, len(s)))
        base = sum(math.log10((raw[w] + 0.1) / (n_all + 0.1 * (v + 1))) for w in s[1:])
        res.append((len(s) - 1, sum(raw[w] > 0 for w in s[1:]), n_all, base, lm))
    return res


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(spark, order):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string").repartition(3)
    out = {r.doc_id: r for r in knlm.cross_scored(docs, order=order, every=4).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 0 for i, _ in rows}
    want = brute([t for i, t in rows if not held[i]], [t for _, t in rows], order)
    for (i, _), w in zip(rows, want, strict=True):
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], *w[:3])
        assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-9)


def test_empty_table_and_null_key(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert knlm.cross_scored(empty).collect() == []
    one = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    rows = knlm.cross_scored(one).collect()
    assert [(r.doc_id, r.held_out, r.n_tokens, r.n_known) for r in rows] == [(None, True, 3, 0), (None, True, 1, 0)]
