"""Toxicity of texts by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own vector (words of several sampled texts have one, all others share one) joined to the
summed vectors of its character n-grams. Overlapping windows of words run through a gated recurrent network in
both directions; attention pools a window's states; a text scores as its highest window. Training knows labels
of whole texts only: it first takes any window of a toxic text as toxic, then again and again the windows that
score highest in each text, so that clean texts give their most toxic-looking ones.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .knlm import held_out
from .shared import small
from .words import Index, Words, split, texts_of

WINDOW, STRIDE = 12, 8
STATES, WORD_DIM, CHAR_DIM, ATTEND = 16, 12, 12, 12
#: Bytes of the n-grams.
GRAMS = (3, 5, 7)
#: Bound of the sample that training sees: labelled rows of each label, with their whole texts.
SAMPLE = {1: 1500, 0: 2500}
#: Size of the model's vocabulary: texts of the sample that must hold a word, and distinct words that must hold an
#: n-gram, for it to have a vector of its own; the most vectors of a kind, the most frequent first. All other words
#: share one vector, other n-grams have none.
LEAST_TEXTS, MOST_VECTORS = 5, 60_000
#: Fits that compete on the validation part, a fifth of the sample's rows.
SEEDS, FOLD = (7, 1, 2), 5
#: Share of words whose vectors a training step leaves out.
DROPPED = 0.3
#: A flagged clean text of the validation part weighs as much as this many missed toxic ones, in shares.
CLEAN_WEIGHT = 4.0


def char_grams(found: Words, which: np.ndarray, lengths: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(position in ``which``, code) of each character n-gram of those words, with marks at both ends; a code
    holds the n-gram's bytes and its length."""
    size = found.length[which] + 2
    at = np.cumsum(size) - size
    inner = np.arange(int(size.sum()))
    of = np.repeat(np.arange(len(which)), size)
    pos = inner - at[of]
    byte = np.where(pos == 0, 2, 3).astype(np.uint64)
    mid = (pos > 0) & (pos < size[of] - 1)
    byte[mid] = found.data[found.start[which][of[mid]] + pos[mid] - 1]
    rows, codes = [], []
    for n in lengths:
        here = np.flatnonzero(pos <= size[of] - n)
        code = np.full(len(here), n, np.uint64)
        for i in range(n):
            code = (code << np.uint64(8)) | byte[here + i]
        rows.append(of[here].astype(np.int32))
        codes.append(code)
    return np.concatenate(rows), np.concatenate(codes)


def _common(items: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Items that are held often enough, sorted: the most frequent if there are too many."""
    items, n = items[n >= LEAST_TEXTS], n[n >= LEAST_TEXTS]
    return np.sort(items[np.lexsort((items, -n))[:MOST_VECTORS]])


def _tops(text: np.ndarray, logit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, highest logit of its windows); ``text`` is sorted."""
    new = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    return text[new], np.maximum.reduceat(logit, new)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, first word) of overlapping windows that cover all words of each text."""
    n = np.diff(first)
    count = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return text, first[text] + k * STRIDE


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Inputs:
    """Distinct words: the vector of each, its known n-grams as (owner, id), and their weight."""

    word: np.ndarray
    owner: np.ndarray
    gram: np.ndarray
    weight: np.ndarray


class Network:
    def __init__(self, words: np.ndarray, grams: np.ndarray, seed: int = 7, dtype: type = np.float32) -> None:
        rng = np.random.default_rng(seed)
        put = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(dtype)
        d, h = WORD_DIM + CHAR_DIM, STATES
        self.words, self.grams, self.threshold = Index(words), Index(grams), 0.0
        self.p = {"word": put(len(words) + 1, WORD_DIM, scale=0.1), "char": put(len(grams) + 1, CHAR_DIM, scale=0.1), "attend": put(2 * h, ATTEND, scale=0.3), "attend_bias": put(ATTEND, scale=0.0), "query": put(ATTEND, scale=0.5), "out": put(2 * h, scale=0.5), "bias": put(1, scale=0.0)}
        for side in "fb":
            self.p |= {f"in_{side}": put(d, 3 * h, scale=d**-0.5), f"bias_{side}": put(3 * h, scale=0.0), f"state_{side}": put(h, 3 * h, scale=h**-0.5)}
        self.p["char"][0] = 0

    def inputs(self, found: Words, which: np.ndarray, hashes: np.ndarray) -> Inputs:
        """Of the distinct words at ``which``."""
        parts = []
        for n in GRAMS:
            owner, code = char_grams(found, which, (n,))
            gram = self.grams.find(code)
            parts.append((owner[gram > 0], gram[gram > 0]))
        owner, gram = (np.concatenate(x) for x in zip(*parts, strict=True))
        n = np.bincount(owner, minlength=len(which))
        return Inputs(self.words.find(hashes), owner, gram, (1 / np.sqrt(np.maximum(n, 1))).astype(self.p["word"].dtype))

    def vectors(self, x: Inputs) -> np.ndarray:
        p, out = self.p, np.zeros((len(x.word), WORD_DIM + CHAR_DIM), self.p["word"].dtype)
        out[:, :WORD_DIM] = p["word"][x.word]
        if len(x.owner):
            order = np.argsort(x.owner, kind="stable")
            owner = x.owner[order]
            new = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[new], WORD_DIM:] = np.add.reduceat(p["char"][x.gram[order]], new, axis=0) * x.weight[owner[new], None]
        return out

    def _run(self, gates: np.ndarray, side: str, keep: list | None) -> np.ndarray:
        """States (window, place, state) from the input's part of the gates."""
        n, length, h = len(gates), gates.shape[1], STATES
        out = np.empty((n, length, h), gates.dtype)
        state, u = np.zeros((n, h), gates.dtype), self.p[f"state_{side}"]
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            own = state @ u
            g = gates[:, t]
            zr = _sigmoid(g[:, : 2 * h] + own[:, : 2 * h])
            new = np.tanh(g[:, 2 * h :] + zr[:, h:] * own[:, 2 * h :])
            if keep is not None:
                keep.append((t, state, zr, new, own[:, 2 * h :]))
            state = new + zr[:, :h] * (state - new)
            out[:, t] = state
        return out

    def _pooled(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q = np.tanh(states @ self.p["attend"] + self.p["attend_bias"])
        s = np.where(real, q @ self.p["query"], -1e9)
        a = np.exp(s - s.max(axis=1, keepdims=True))
        a /= a.sum(axis=1, keepdims=True)
        return q, a, np.einsum("nt,nth->nh", a, states)

    def logits(self, table: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Of windows of rows of ``table`` (gates of each distinct word); row -1 stands for no word."""
        h3 = 3 * STATES
        out = np.empty(len(index), table.dtype)
        for at in range(0, len(index), 2048):
            i = index[at : at + 2048]
            gates = table[i]
            states = np.concatenate([self._run(gates[:, :, :h3], "f", None), self._run(gates[:, :, h3:], "b", None)], axis=2)
            out[at : at + 2048] = self._pooled(states, i >= 0)[2] @ self.p["out"] + self.p["bias"]
        return out

    def table(self, vectors: np.ndarray) -> np.ndarray:
        """Gates of each word in both directions, and of no word at the end."""
        full = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])
        return np.concatenate([full @ self.p[f"in_{s}"] + self.p[f"bias_{s}"] for s in "fb"], axis=1)

    def gradients(self, x: Inputs, index: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of windows and its gradients; index: windows of the words of ``x``, -1 for none."""
        p, h, real = self.p, STATES, index >= 0
        vectors = self.vectors(x)
        seen = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), vectors.dtype)])[index]
        kept: dict[str, list] = {"f": [], "b": []}
        runs = [self._run(seen @ p[f"in_{s}"] + p[f"bias_{s}"], s, kept[s]) for s in "fb"]
        states = np.concatenate(runs, axis=2)
        q, a, pool = self._pooled(states, real)
        logit = pool @ p["out"] + p["bias"]
        prob = _sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - label * logit))
        d = ((prob - label) / len(label)).astype(logit.dtype)
        g = {"out": pool.T @ d, "bias": d.sum(keepdims=True)}
        d_pool = d[:, None] * p["out"]
        d_a = np.einsum("nh,nth->nt", d_pool, states)
        d_s = a * (d_a - (a * d_a).sum(axis=1, keepdims=True))
        g["query"] = np.einsum("nt,ntk->k", d_s, q)
        d_q = d_s[:, :, None] * p["query"] * (1 - q * q)
        g["attend"] = np.einsum("nth,ntk->hk", states, d_q)
        g["attend_bias"] = d_q.sum(axis=(0, 1))
        d_states = a[:, :, None] * d_pool[:, None, :] + d_q @ p["attend"].T
        d_seen = np.zeros_like(seen)
        for k, s in enumerate("fb"):
            u, d_u, d_gates, carry = p[f"state_{s}"], np.zeros_like(p[f"state_{s}"]), np.empty(seen.shape[:2] + (3 * h,), seen.dtype), 0
            for t, before, zr, new, own in reversed(kept[s]):
                dh = d_states[:, t, k * h : (k + 1) * h] + carry
                z, r = zr[:, :h], zr[:, h:]
                d_new = dh * (1 - z) * (1 - new * new)
                d_zr = np.concatenate([dh * (before - new), d_new * own], axis=1) * zr * (1 - zr)
                d_own = np.concatenate([d_zr, d_new * r], axis=1)
                d_gates[:, t] = np.concatenate([d_zr, d_new], axis=1)
                d_u += before.T @ d_own
                carry = dh * z + d_own @ u.T
            g[f"state_{s}"], g[f"bias_{s}"] = d_u, d_gates.sum(axis=(0, 1))
            g[f"in_{s}"] = np.einsum("ntd,ntg->dg", seen, d_gates)
            d_seen += d_gates @ p[f"in_{s}"].T
        each = _added(index[real], d_seen[real], len(vectors))
        g["word"] = _added(x.word, each[:, :WORD_DIM], len(p["word"]))
        g["char"] = _added(x.gram, (each[:, WORD_DIM:] * x.weight[:, None])[x.owner], len(p["char"]))
        return loss, g

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Score of each text; 0 for one without a word."""
        found = split(texts)
        out = np.zeros(len(texts))
        if len(found.start):
            text, top = _tops(*self.by_window(found)[:2])
            out[text] = 1 / (1 + np.exp(-(top.astype(np.float64) - self.threshold)))
        return out

    def by_window(self, found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, logit, first word) of each window."""
        hashes, one, index = np.unique(found.hashes(), return_index=True, return_inverse=True)
        table = self.table(self.vectors(self.inputs(found, one, hashes)))
        text, start = windows(found.first)
        return text, self.logits(table, _words_at(index, start, found.first[text + 1])), start


def _added(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows that go to each of ``n`` places."""
    return np.stack([np.bincount(at, c, n) for c in rows.T], axis=1).astype(rows.dtype)


def _words_at(index: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    at = start[:, None] + np.arange(WINDOW)
    return np.where(at < end[:, None], index[np.minimum(at, len(index) - 1)], -1)


class _Adam:
    """Adam; of a table of vectors only the rows that a step touches move."""

    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], touched: dict[str, np.ndarray]) -> None:
        self.n += 1
        fix = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for k, x in g.items():
            at = touched.get(k, slice(None))
            x, m, v = x[at], self.m[k][at], self.v[k][at]
            m = m + 0.1 * (x - m)
            v = v + 0.001 * (x * x - v)
            self.m[k][at], self.v[k][at] = m, v
            self.p[k][at] -= (fix * m / (np.sqrt(v) + 1e-7)).astype(self.p[k].dtype)
        self.p["char"][0] = 0


def _constant(net: Network, toxic: bool) -> Network:
    net.p["bias"][:] = 4.0 if toxic else -4.0
    net.p["out"][:] = 0
    return net


class _Windows:
    """All windows of labelled texts, as places of distinct words; texts themselves are not held."""

    def __init__(self, texts: list[bytes], labels: np.ndarray) -> None:
        found = split(texts)
        hashes, one, index = np.unique(found.hashes(), return_index=True, return_inverse=True)
        held = np.unique(index * len(texts) + found.text) // len(texts)
        self.known = _common(hashes, np.bincount(held, minlength=len(hashes)))
        # n-grams count by the distinct words that hold them
        counts = [np.unique(char_grams(found, one, (n,))[1], return_counts=True) for n in GRAMS]
        self.grams = _common(*(np.concatenate(x) for x in zip(*counts, strict=True)))
        self.whole = Network(self.known, self.grams).inputs(found, one, hashes)
        order = np.argsort(self.whole.owner, kind="stable")
        self.edge = np.searchsorted(self.whole.owner[order], np.arange(len(one) + 1))
        self.sorted_gram = self.whole.gram[order]
        self.text, start = windows(found.first)
        self.at = _words_at(index, start, found.first[self.text + 1]).astype(np.int32)
        self.toxic = labels[self.text] == 1

    def inputs(self, rows: np.ndarray, rng: np.random.Generator) -> tuple[Inputs, np.ndarray]:
        """Of some windows, with a share of their words' own vectors left out."""
        used, local = np.unique(self.at[rows], return_inverse=True)
        local = local.reshape(self.at[rows].shape)
        if used[0] < 0:
            used, local = used[1:], local - 1
        count = self.edge[used + 1] - self.edge[used]
        place = np.repeat(self.edge[used] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        word = np.where(rng.random(len(used)) < DROPPED, 0, self.whole.word[used])
        return Inputs(word, np.repeat(np.arange(len(used)), count), self.sorted_gram[place], self.whole.weight[used]), local


def _trained(w: _Windows, use: np.ndarray, seed: int, first_steps: int, rounds: int, round_steps: int, batch: int) -> Network:
    """A network from the windows of the texts that ``use`` marks."""
    net = Network(w.known, w.grams, seed)
    rng, adam = np.random.default_rng(seed), _Adam(net.p, 0.01)
    mine = np.flatnonzero(use[w.text])
    text, toxic = w.text[mine], w.toxic[mine]
    sides = [mine[~toxic], mine[toxic]]

    def learn(rows: np.ndarray) -> None:
        x, local = w.inputs(rows, rng)
        adam.step(net.gradients(x, local, w.toxic[rows].astype(np.float32))[1], {"word": np.unique(x.word), "char": np.unique(x.gram)})

    for _ in range(first_steps):
        learn(np.concatenate([rng.choice(s, batch // 2) for s in sides]))
    edges = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    for k in range(rounds):
        adam.rate = 0.005 / (k + 1) ** 0.5
        logit = net.logits(net.table(net.vectors(w.whole)), w.at[mine])
        order = np.lexsort((-logit, text))
        rank = np.empty(len(text), np.int64)
        rank[order] = np.arange(len(text)) - np.repeat(edges, np.diff(np.r_[edges, len(text)]))
        hard = np.where(toxic, rank < 1, (rank < 3) & (logit > -6))
        pools = [mine[hard & ~toxic], mine[hard & toxic]]
        for _ in range(round_steps):
            clean = np.concatenate([rng.choice(pools[0], batch // 4) if len(pools[0]) else pools[0], rng.choice(sides[0], batch // 4)])
            learn(np.concatenate([clean, rng.choice(pools[1], batch // 2)]))
    return net


def _judged(top: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """(quality, threshold) of texts' highest logits: the share of toxic texts found less the weighted share of clean
    ones flagged, at its best threshold. Among equally good ones the one nearest 0 is taken."""
    edges = np.unique(top)
    tried = np.r_[0.0, (edges[1:] + edges[:-1]) / 2, edges[-1] + 1]
    found = 1 - np.searchsorted(np.sort(top[toxic]), tried) / max(1, toxic.sum())
    flagged = 1 - np.searchsorted(np.sort(top[~toxic]), tried) / max(1, (~toxic).sum())
    value = found - CLEAN_WEIGHT * flagged
    best = int(np.lexsort((np.abs(tried), -value))[0])
    return float(value[best]), float(tried[best])


def fit(texts: list[bytes], labels: np.ndarray, seeds: tuple[int, ...] = SEEDS, first_steps: int = 300, rounds: int = 3, round_steps: int = 100, batch: int = 256) -> Network:
    """A network from whole-text labels (0 or 1); with one label alone, or none, it finds all texts alike.

    Every ``FOLD``-th text of each label is for validation: the others train a network for each seed, the one that tells the
    validation texts apart best stays, with the threshold that does it. With under two texts of a label there, all texts
    both train and validate.
    """
    labels = np.asarray(labels)
    if not any(t.split() for t in texts):
        return _constant(Network(np.zeros(0, np.uint64), np.zeros(0, np.uint64)), False)
    w = _Windows(texts, labels)
    if w.toxic.all() or not w.toxic.any():
        return _constant(Network(w.known, w.grams), bool(w.toxic.any()))
    place = np.zeros(len(texts), np.int64)
    for value in (0, 1):
        place[labels == value] = np.arange(int((labels == value).sum()))
    check = place % FOLD == FOLD - 1
    sides = lambda use: [len(np.unique(w.text[use[w.text] & (w.toxic == y)])) for y in (False, True)]
    if min(sides(check)) < 2 or min(sides(~check)) < 1:
        check = np.ones(len(texts), bool)
    use = np.ones(len(texts), bool) if check.all() else ~check
    best, rows = None, np.flatnonzero(check[w.text])
    for seed in seeds:
        net = _trained(w, use, seed, first_steps, rounds, round_steps, batch)
        text, top = _tops(w.text[rows], net.logits(net.table(net.vectors(w.whole)), w.at[rows]))
        value, net.threshold = _judged(top, labels[text] == 1)
        if best is None or value > best[0]:
            best = value, net
    return best[1]


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, every: int) -> DataFrame:
    """Labelled whole texts (__h, text, label) for training: rows that are not held out, for each label at most ``SAMPLE`` of them,
    first by a hash of their key. Of several labels of a key the greatest counts; of several rows the text with the least hash."""
    y = labels.select(F.col(key).alias("__key"), F.col(label).cast("int").alias("__y")).where("__y in (0, 1)")
    y = y.where(~held_out("__key", every)).groupBy("__key").agg(F.max("__y").alias("__y")).withColumn("__h", F.xxhash64("__key"))
    some = None
    for value, most in SAMPLE.items():
        part = y.where(F.col("__y") == value).orderBy("__h", "__key").limit(most)
        some = part if some is None else some.union(part)
    rows = docs.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__text")).join(F.broadcast(some), "__key")
    # the least text by hash, then by itself: no order of rows or partitions has a say
    rows = rows.groupBy("__key", "__h", "__y").agg(F.min(F.struct(F.xxhash64("__text").alias("x"), F.col("__text").alias("t"))).alias("__least"))
    return rows.select("__h", F.col("__least.t").alias("text"), F.col("__y").alias("label"))


def _trainer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(((h, y, t) for b in batches for h, t, y in zip(b.column(0).to_pylist(), texts_of(b.column(1)), b.column(2).to_pylist(), strict=True)), key=lambda r: r[:2])
    net = fit([t for _, _, t in rows], np.array([y for _, y, _ in rows], np.int64))
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((net.words.known, net.grams.known, net.p, net.threshold))])], ["net"])


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", every: int = 5) -> Network:
    """A network from the labelled rows that are not held out. One task, on the bounded sample, trains it."""
    rows = sample(docs, labels, key, text, label, every).repartition(1)
    made = rows.mapInArrow(_trainer, "net binary").collect()
    if not made:
        return fit([], np.zeros(0, np.int64))
    words, grams, p, threshold = pickle.loads(made[0][0])
    net = Network(words, grams)
    net.p, net.threshold = p, threshold
    return net


def _scorer(net: Network, column: int, names: list[str], keep_below: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, scores = texts_of(batch.column(column)), []
            part, size = [], 0
            for t in texts:
                part.append(t)
                size += len(t)
                if size > 1 << 20:
                    scores.append(net.scores(part))
                    part, size = [], 0
            scores.append(net.scores(part))
            score = np.concatenate(scores)
            if keep_below is not None:
                yield batch.filter(pa.array(score < keep_below))
            else:
                cols = [*(batch.column(i) for i in range(batch.num_columns) if i != column), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def scored(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text", every: int = 5) -> DataFrame:
    """(key, held_out, score, predicted) for each row of ``docs``.

    A text that is null, empty or without a word scores 0. A null key is passed on and counts as held out. An
    empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("__key"), held_out(key, every).alias("held_out"), F.col(text).alias("__text"))
    names = ["__key", "held_out", "score", "predicted"]
    out = rows.mapInArrow(_scorer(net, 2, names, None), f"__key {rows.schema[0].dataType.simpleString()}, held_out boolean, score double, predicted int")
    return out.withColumnRenamed("__key", key)


def clean_documents(docs: DataFrame, net: Network, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score under ``threshold``."""
    return docs.mapInArrow(_scorer(net, docs.columns.index(text), [], threshold), docs.schema)
