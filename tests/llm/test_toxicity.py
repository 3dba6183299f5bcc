import math
import random

import numpy as np
import pytest

from fieldloom.llm import toxicity as T
from fieldloom.llm.words import split

CLEAN = [a + b for a in "ba de ki lo mu na pe ri so tu".split() for b in "ban dol kem lir mos".split()]
BAD = ["vilescum", "vilerot", "grobnik"]


def corpus(n, seed):
    r = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = [r.choice(CLEAN) for _ in range(r.choice([3, 20, 60, 150]))]
        if i % 3 == 0:
            for _ in range(1 + len(words) // 40):
                words.insert(r.randrange(len(words) + 1), r.choice(BAD) + r.choice(["", "en", "os"]))
        texts.append(" ".join(words).encode())
        labels.append(int(i % 3 == 0))
    return texts, np.array(labels)


def test_gradients_equal_differences():
    found = split([b"aba cdc efef ghg aba", b"xyx"])
    hashes, one, index = np.unique(found.hashes(), return_index=True, return_inverse=True)
    net = T.Network(hashes[:3], np.unique(T.char_grams(found, one)[1])[::2], dtype=np.float64)
    x = net.inputs(found, one, hashes)
    text, start = T.windows(found.first)
    at = T._words_at(index, start, found.first[text + 1])
    label = np.array([1.0, 0.0])
    _, g = net.gradients(x, at, label)
    rng = np.random.default_rng(0)
    for name, p in net.p.items():
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in p.shape)
            keep, e = p[i], 1e-6
            p[i] = keep + e
            up = net.gradients(x, at, label)[0]
            p[i] = keep - e
            down = net.gradients(x, at, label)[0]
            p[i] = keep
            assert g[name][i] == pytest.approx((up - down) / (2 * e), abs=1e-7), name


def plain_score(net, text):
    """One text, word by word and state by state."""
    sig = lambda v: 1 / (1 + math.exp(-v))
    words, p, h = text.lower().split(), {k: v.astype(float) for k, v in net.p.items()}, T.STATES

    def vector(word):
        (code,) = split([word]).hashes().tolist()
        own = {int(k): i + 1 for i, k in enumerate(net.words.known)}.get(code, 0)
        marked, grams = b"\x02" + word + b"\x03", []
        for n in T.GRAMS:
            for i in range(len(marked) - n + 1):
                code = int.from_bytes(bytes([n]) + marked[i : i + n], "big") & 0xFFFFFFFFFFFFFFFF
                grams.append({int(k): j + 1 for j, k in enumerate(net.grams.known)}.get(code, 0))
        grams = [g for g in grams if g]
        chars = sum((p["char"][g] for g in grams), np.zeros(T.CHAR_DIM)) / math.sqrt(max(1, len(grams)))
        return np.concatenate([p["word"][own], chars])

    def states(vectors, side):
        state, out = [0.0] * h, []
        for v in vectors:
            g, own = v @ p[f"in_{side}"] + p[f"bias_{side}"], np.array(state) @ p[f"state_{side}"]
            z = [sig(g[i] + own[i]) for i in range(h)]
            r = [sig(g[h + i] + own[h + i]) for i in range(h)]
            new = [math.tanh(g[2 * h + i] + r[i] * own[2 * h + i]) for i in range(h)]
            state = [z[i] * state[i] + (1 - z[i]) * new[i] for i in range(h)]
            out.append(state)
        return out

    starts = range(0, max(1, len(words) - T.WINDOW + T.STRIDE), T.STRIDE) if words else []
    best = -math.inf
    for at in starts:
        part = [vector(w) for w in words[at : at + T.WINDOW]]
        part += [np.zeros(T.WORD_DIM + T.CHAR_DIM)] * (T.WINDOW - len(part))
        n = min(T.WINDOW, len(words) - at)
        both = [np.array(a + b) for a, b in zip(states(part, "f"), states(part[::-1], "b")[::-1])]
        weight = [math.exp(np.tanh(s @ p["attend"] + p["attend_bias"]) @ p["query"]) for s in both[:n]]
        pool = sum(w * s for w, s in zip(weight, both)) / sum(weight)
        best = max(best, float(pool @ p["out"] + p["bias"][0]))
    return sig(best - net.threshold) if words else 0.0


def test_scores_equal_plain_loops():
    net = T.fit(*corpus(60, 4), seeds=(3,), first_steps=30, rounds=1, round_steps=10)
    texts = corpus(12, 5)[0] + [b"", b" ", b"one", b"vilescum " * 13, "ünder ñ vilerot".encode()]
    assert np.allclose(net.scores(texts), [plain_score(net, t) for t in texts], atol=1e-4)


def test_whole_texts_are_learned():
    texts, labels = corpus(90, 6)
    filler = b" ".join(c.encode() for c in CLEAN * 30)
    texts = [filler + b" " + t for t in texts]  # what is toxic stands after 9,000 characters
    net = T.fit(texts, labels, seeds=(7,))
    assert (net.scores([filler, filler + b" vilescum grobnik vilerot"]) >= 0.5).tolist() == [False, True]


def test_windows_cover_every_word():
    for n in range(0, 60):
        text, start = T.windows(np.array([0, n]))
        seen = {int(s) + k for s in start for k in range(T.WINDOW) if s + k < n}
        assert seen == set(range(n)) and (len(start) < 2 or (np.diff(start) == T.STRIDE).all())


def test_held_out_accuracy_and_batches_do_not_matter():
    net = T.fit(*corpus(400, 1))
    texts, labels = corpus(300, 2)
    got = net.scores(texts)
    assert ((got >= 0.5) == labels).mean() > 0.98
    alone = np.concatenate([net.scores([t]) for t in texts[:40]])
    assert np.allclose(alone, got[:40], atol=1e-4)


def test_tables(spark):
    texts, labels = corpus(300, 3)
    rows = [(i, t.decode(), "de", 9.0) for i, t in enumerate(texts)]
    odd = [(None, texts[0].decode(), None, None), (900, None, "en", 1.0), (901, "", "en", 1.0), (902, " \n", "en", 1.0), (0, rows[0][1], "de", 9.0), (903, "ba " * 20000 + "vilescum", "de", 1.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    net = T.learned(docs, marks)
    out = T.scored(docs, net).collect()
    assert len(out) == len(rows) + len(odd)
    by = {r.doc_id: r for r in out}
    assert by[900].score == by[901].score == by[902].score == 0.0 and by[903].predicted == 1
    assert all(r.predicted == (r.score >= 0.5) for r in out)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.95
    left = T.clean_documents(docs, net).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted(r.doc_id for r in out if r.doc_id is not None and not r.predicted)
    assert T.scored(docs.limit(0), net).collect() == []
    none = T.learned(docs.limit(0), marks.limit(0))
    assert (none.scores([b"vilescum", b""]) < 0.5).all()
