"""Interpolated modified Kneser-Ney language models, counted in Spark and scored from sorted hash arrays.

Tasks count n-grams of word hashes, pack the counts by ranges of the n-gram's own hash, and one task a range
merges them. It writes the range as sorted arrays into the folder that all workers share, where they are mapped
into memory. What a merged n-gram adds to its prefix (total and number of n-grams counted once, twice, more) and
to its suffix (one continuation) goes on to the next order down.

The lower orders count continuations, but n-grams from a text's begin keep their counts (Chen and Goodman 1999;
Heafield et al. 2013). An unknown word gets its share of a uniform distribution.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small, get_array, new_dir, put_array, written
from .words import mix, split, texts_of

BEGIN, END = (np.uint64(x) for x in (0xB5297A4D3F84D5B5, 0x68E31DA4C2B2AE35))
#: Tokens whose counts a task holds before it deals them out.
FLUSH = 2_000_000
#: Counts from here on stand in a table of their own; others take a byte.
_MANY = 255
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _joined(words: list[np.ndarray]) -> np.ndarray:
    """A hash of each n-gram; of a word it is the word's own."""
    key = words[0]
    for w in words[1:]:
        key = mix(key * _STEP + w)
    return key


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): begin, words and end of each text; first[t]:first[t + 1] are those of text t."""
    found = split(texts)
    first = found.first + 2 * np.arange(len(texts) + 1)
    out = np.empty(int(first[-1]), np.uint64)
    inner = np.ones(len(out), bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    out[first[:-1]], out[first[1:] - 1] = BEGIN, END
    out[inner] = found.hashes()
    return out, first


def grams(token: np.ndarray, first: np.ndarray, k: int, only_begin: bool) -> list[np.ndarray]:
    """The k words of each n-gram of order k; ``only_begin``: of those from a text's begin."""
    at = first[:-1] if only_begin else np.arange(max(0, len(token) - k + 1))
    at = at[at + k <= len(token)]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = at[text[at] == text[at + k - 1]]
    return [token[at + i] for i in range(k)]


def _sum_equal(key: np.ndarray, cols: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    order = np.argsort(key)
    key = key[order]
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    added = [np.add.reduceat(x[order], new) if len(new) else x[:0] for x in sums]
    return key[new], [x[order][new] for x in cols], added


def _planes(x: np.ndarray) -> bytes:
    """First bytes of all items, second bytes, and so on: small numbers pack well so."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _packed(level: int, kind: str, key: np.ndarray, hashes: list[np.ndarray], sums: list[np.ndarray], bits: int) -> Iterator[tuple]:
    """Rows (kind, level, shard, blob); key is sorted and its top bits are the shard."""
    edge = np.searchsorted(key, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.int64)
    for shard, (a, b) in enumerate(zip(edge.tolist(), [*edge[1:].tolist(), len(key)], strict=True)):
        if a == b:
            continue
        known, index = np.unique(np.concatenate([x[a:b] for x in hashes]), return_inverse=True)
        index = index.reshape(len(hashes), b - a)
        order = np.lexsort(index[::-1])  # equal first words side by side pack well
        narrow = [x[a:b][order].astype(np.uint32 if x[a:b].max() < 1 << 32 else np.uint64) for x in sums]
        index = np.ascontiguousarray(index[:, order], np.uint32)
        index[0] = np.diff(index[0], prepend=np.uint32(0))
        body = [np.array([b - a, len(known)], np.int64).tobytes(), known.tobytes(), *map(_planes, [*index, *narrow])]
        wide = bytes(x.dtype.itemsize for x in narrow)
        yield kind, level, shard, bytes([len(hashes), len(sums)]) + wide + zstandard.compress(b"".join(body), 1)


def _unpacked(blob: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    hashes, sums = blob[0], blob[1]
    wide, body = blob[2 : 2 + sums], zstandard.decompress(blob[2 + sums :])
    n, known = np.frombuffer(body, np.int64, 2)
    words, at = np.frombuffer(body, np.uint64, known, 16), 16 + 8 * int(known)
    cols = []
    for size in [*[4] * hashes, *wide]:
        planes = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n)
        cols.append(np.ascontiguousarray(planes.T).view(np.uint32 if size == 4 else np.uint64).ravel())
        at += size * int(n)
    cols[0] = np.cumsum(cols[0], dtype=np.uint32)
    return [words[x] for x in cols[:hashes]], [x.astype(np.uint64) for x in cols[hashes:]]


_ROW = "kind string, level int, shard int, blob binary, ones long, twos long, threes long, fours long, types long, tokens long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["kind", "level", "shard", "blob", "ones", "twos", "threes", "fours", "types", "tokens"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), *[pa.int64()] * 6]
    full = [(*r, *[0] * (10 - len(r))) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in full], t) for i, t in enumerate(kinds)], names)


def _counter(order: int, bits: int):
    def dealt(token: list[np.ndarray], first: list[np.ndarray]) -> list[tuple]:
        offset = np.cumsum([0, *(len(t) for t in token)])
        all_first = np.concatenate([*(f[:-1] + o for f, o in zip(first, offset, strict=False)), offset[-1:]])
        whole, out = np.concatenate(token), []
        for k in range(1 if order == 1 else 2, order + 1):
            words = grams(whole, all_first, k, k < order)
            if order == 1:
                words = [w[w != BEGIN] for w in words]
            key, cols, (n,) = _sum_equal(_joined(words), words, [np.ones(len(words[0]), np.uint64)])
            out += _packed(k, "gram", key, cols, [n, n], bits)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, first, held = [], [], 0
        for batch in small(batches):
            t, f = tokens(texts_of(batch.column(0)))
            token, first, held = [*token, t], [*first, f], held + len(t)
            if held >= FLUSH:
                yield _rows(dealt(token, first))
                token, first, held = [], [], 0
        if held:
            yield _rows(dealt(token, first))

    return run


def _merger(level: int, bits: int, folder: str):
    """Merges the packed rows of each shard: n-grams of one order, or the contexts of the order above."""

    def grams_of(shard: int, blobs: list[bytes]) -> list[tuple]:
        parts = [_unpacked(b) for b in blobs]
        words = [np.concatenate([p[0][i] for p in parts]) for i in range(level)]
        key, words, (count, raw) = _sum_equal(_joined(words), words, [np.concatenate([p[1][i] for p in parts]) for i in (0, 1)])
        put_array(folder, f"gram{level}-{shard}.key", key)
        put_array(folder, f"gram{level}-{shard}.count", np.minimum(count, _MANY).astype(np.uint8))
        big = np.flatnonzero(count >= _MANY)
        put_array(folder, f"gram{level}-{shard}.big", np.stack([np.r_[big, len(key)].astype(np.uint64), np.r_[count[big], np.uint64(0)]], axis=1))
        if level == 1:
            put_array(folder, f"gram1-{shard}.raw", raw)
        out = [("sum", level, shard, b"", *(int((count == i).sum()) for i in (1, 2, 3, 4)), len(key), int(raw.sum()))]
        prefix = _joined(words[:-1]) if level > 1 else np.zeros(len(key), np.uint64)
        seen, _, sums = _sum_equal(prefix, [], [count, *((count == i).astype(np.uint64) for i in (1, 2)), (count > 2).astype(np.uint64)])
        out += _packed(level, "context", seen, [seen], sums, bits)
        if level > 1:
            below = words[1:]
            suffix, below, sums = _sum_equal(_joined(below), below, [np.ones(len(key), np.uint64), raw])
            out += _packed(level - 1, "gram", suffix, below, sums, bits)
        return out

    def contexts_of(shard: int, blobs: list[bytes]) -> list[tuple]:
        parts = [_unpacked(b) for b in blobs]
        cat = lambda i, j: np.concatenate([p[i][j] for p in parts])
        key, _, sums = _sum_equal(cat(0, 0), [], [cat(1, j) for j in range(4)])
        put_array(folder, f"context{level}-{shard}.key", key)
        put_array(folder, f"context{level}-{shard}.sums", np.stack(sums, axis=1))
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for kind, shard, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (kind, shard) != now:
                    yield _rows((grams_of if now[0] == "gram" else contexts_of)(now[1], held))
                    held = []
                now = kind, shard
                held.append(blob)
        if held:
            yield _rows((grams_of if now[0] == "gram" else contexts_of)(now[1], held))

    return run


def _merged(packed: DataFrame, level: int, bits: int, folder: str) -> DataFrame:
    rows = packed.select("kind", "shard", "blob").repartition("kind", "shard").sortWithinPartitions("kind", "shard")
    return written(rows.mapInArrow(_merger(level, bits, folder), _ROW), f"lm-level{level}")


@dataclass
class Model:
    """A model's folder and figures; the arrays stay in files."""

    folder: str
    order: int
    bits: int
    tokens: int
    types: int
    discounts: dict[int, list[float]] = field(default_factory=dict)
    shards: dict[str, set[int]] = field(default_factory=dict)

    def find(self, kind: str, key: np.ndarray, cols: list[tuple[str, type, int]]) -> list[np.ndarray]:
        """Columns of the rows of ``key``; zeros where there is none."""
        asked, back = np.unique(key, return_inverse=True)
        out = [np.zeros((len(asked), wide) if wide > 1 else len(asked), np.float64) for _, _, wide in cols]
        edge = np.searchsorted(asked, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else np.zeros(1, np.int64)
        for shard, (a, b) in enumerate(zip(edge.tolist(), [*edge[1:].tolist(), len(asked)], strict=True)):
            if a < b and shard in self.shards.get(kind, ()):
                known = get_array(self.folder, f"{kind}-{shard}.key", np.uint64)
                at = np.minimum(np.searchsorted(known, asked[a:b]), len(known) - 1)
                hit = known[at] == asked[a:b]
                for o, (name, dtype, wide) in zip(out, cols, strict=True):
                    data = get_array(self.folder, f"{kind}-{shard}.{name}", dtype)
                    got = (data.reshape(-1, wide) if wide > 1 else data)[at[hit]].astype(np.float64)
                    if name == "count" and (many := np.flatnonzero(got == _MANY)).size:
                        big = get_array(self.folder, f"{kind}-{shard}.big", np.uint64).reshape(-1, 2)
                        got[many] = big[np.searchsorted(big[:, 0], at[hit][many].astype(np.uint64)), 1]
                    o[a:b][hit] = got
        return [o[back] for o in out]

    def discounted(self, level: int, count: np.ndarray) -> np.ndarray:
        return np.maximum(count - np.array([0.0, *self.discounts[level]])[np.minimum(count, 3).astype(np.int64)], 0)

    def score(self, texts: list[bytes]) -> dict[str, np.ndarray]:
        """n_tokens, n_known, base_score and score of each text."""
        token, first = tokens(texts)
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        at = np.flatnonzero(token != BEGIN)
        count, raw = self.find("gram1", token[at], [("count", np.uint8, 1), ("raw", np.uint64, 1)])
        p = np.full(len(at), 1 / (self.types + 1))
        for k in range(1, self.order + 1):
            has = np.flatnonzero((at - k + 1 >= 0) & (text[np.maximum(at - k + 1, 0)] == text[at]))
            words = [token[at[has] - k + 1 + i] for i in range(k)]
            if k > 1:
                (count,) = self.find(f"gram{k}", _joined(words), [("count", np.uint8, 1)])
            context = _joined(words[:-1]) if k > 1 else np.zeros(len(has), np.uint64)
            (sums,) = self.find(f"context{k}", context, [("sums", np.uint64, 4)])
            known = sums[:, 0] > 0
            total = np.where(known, sums[:, 0], 1)
            left = np.where(known, sums[:, 1:] @ np.array(self.discounts[k]) / total, 1)
            p[has] = self.discounted(k, count) / total + left * p[has]
        base = np.log10((raw + 0.1) / (self.tokens + 0.1 * (self.types + 1)))
        of = text[at]
        add = lambda x: np.bincount(of, x, len(texts))
        return {"n_tokens": np.diff(first) - 1, "n_known": add(raw > 0).astype(np.int64), "base_score": add(base), "score": add(np.log10(p))}


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Of n-grams counted once, twice and more; fixed ones where a count of counts is missing."""
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(x, 0.0), float(i + 1)) for i, x in enumerate((1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3))]


def train(docs: DataFrame, text: str = "text", order: int = 2, shards: int | None = None) -> Model:
    """A model of all whole texts of ``docs``.

    shards: ranges of hashes, a power of two at least; by default it follows spark.sql.shuffle.partitions.
    """
    if order < 1:
        raise ValueError("the order must be 1 at least")
    spark = docs.sparkSession
    bits = max(0, math.ceil(math.log2(shards or max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    folder = new_dir(spark, "lm-arrays")
    packed = docs.select(text).mapInArrow(_counter(order, bits), _ROW)
    if order > 2:
        packed = written(packed, "lm-counts")
    model, above = Model(folder, order, bits, 0, 0), None
    for k in range(order, 0, -1):
        grams_k = packed.where((F.col("kind") == "gram") & (F.col("level") == k)) if k == order or order > 2 else None
        if above is not None:
            grown = above.where((F.col("kind") == "gram") | (F.col("kind") == "context"))
            own = grams_k.unionByName(grown.where("kind = 'gram'")) if grams_k is not None else grown.where("kind = 'gram'")
            _merged(above.where("kind = 'context'"), k + 1, bits, folder)
        else:
            own = grams_k
        above = _merged(own, k, bits, folder)
        sums = above.where("kind = 'sum'")
        got = sums.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("ones", "twos", "threes", "fours", "types", "tokens")), F.collect_set("shard")).first()
        model.discounts[k], model.shards[f"gram{k}"] = _discounts(*got[:4]), set(got[6])
        model.shards[f"context{k}"] = {r[0] for r in above.where("kind = 'context'").select("shard").distinct().collect()}
        if k == 1:
            model.types, model.tokens = int(got[4]), int(got[5])
            _merged(above.where("kind = 'context'"), 1, bits, folder)
    return model


def held_out(key: str, every: int) -> Column:
    """Whether crc32 of the key as text is divisible by ``every``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % every == 0


def scored(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", every: int = 10) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    A null text is empty: it has its end alone. An empty table gives no rows; other columns are ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            got = model.score(texts_of(batch.column(2)))
            n = pa.array(np.full(batch.num_rows, model.tokens, np.int64))
            cols = [pa.array(got[c]) for c in ("n_tokens", "n_known")] + [n] + [pa.array(got[c]) for c in ("base_score", "score")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names)

    rows = docs.select(F.col(key).alias("__key"), held_out(key, every).alias("held_out"), F.col(text).alias("__text"))
    names = ["__key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(run, f"__key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("__key", key)


def cross_scored(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = 2, every: int = 10) -> DataFrame:
    """``scored`` by a model of the rows of ``docs`` that are not held out."""
    return scored(docs, train(docs.where(~held_out(key, every)), text, order), key, text, every)
