"""Sets of word shingles: which texts may be similar, and which are.

Fingerprints of texts whose sets have a Jaccard similarity of 0.8 differ in 10 of 64 bits on average, so Golay keys
alone meet about a quarter of such pairs (half at 0.9). Bands of least hashes find the others: a pair of
similarity 0.8 shares none of 20 bands of 4 with a chance of (1 - 0.8^4)^20 = 2.7e-5, more similar ones with less.
Every candidate is verified on the hashed sets of whole texts; none is left out. Sets lie in files of the shared folder,
once each; rows carry where a set is, so that joins do not move it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import components
from .shared import get_array, new_dir, put_array, small, written
from .words import texts_of

SEED = 42
BANDS, ROWS = 20, 4
#: Pairs of one text that one task verifies.
TOGETHER = 256
#: Members of a block of a large bucket, and shingles of their sets, at most or about.
MEMBERS, SHINGLES = 512, 4_000_000
#: Shingles of the sets of one file, about.
IN_FILE = 4_000_000
#: Where a set is: the file, its first place there, its size.
PLACE = "place struct<file: string, first: bigint, n: bigint>"
_random = np.random.default_rng(SEED)
TIMES = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _random.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


class Forest:
    """Links that would close a circle are left out."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.top(x), self.top(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def hashed_shingles(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 of each word shingle, in order, repeats included; the whole of a shorter text is one, no word gives none."""
    words = text.lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    start = end - length
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(start[: 1 - shingle].tolist(), end[shingle - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes; 0 of none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.ascontiguousarray(hashes[at : at + 65536])
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def band_keys(hashes: np.ndarray) -> list[int]:
    """One key a band, of its number and least hashes; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        block = hashes[at : at + 2048, None] * TIMES + PLUS
        least = np.minimum(least, (block ^ (block >> np.uint64(29))).min(0))
    rows = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(row.tobytes(), band) - (1 << 63) for band, row in enumerate(rows)]


def name_of(members: np.ndarray) -> int:
    """One number for equal sets: the node that stands for them."""
    return xxhash.xxh64_intdigest(members.tobytes(), SEED) - (1 << 63)


def with_sketches(docs: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """(__key, node, fp, bands) of each row with a key: the name of its set of shingles, fingerprint and keys of its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            node, fp, bands = [], [], []
            for t in texts_of(batch.column(1)):
                hashes = hashed_shingles(t, shingle)
                members = np.unique(hashes)
                node.append(name_of(members))
                fp.append(simhash(hashes))
                bands.append(band_keys(members))
            cols = [pa.array(node, pa.int64()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["__key", "node", "fp", "bands"])

    rows = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"__key {rows.schema[0].dataType.simpleString()}, node long, fp long, bands array<long>")


def with_sets(docs: DataFrame, text: str, shingle: int, folder: str) -> DataFrame:
    """(node, place): the sets of texts, sorted as unsigned numbers, put into files of ``folder``. A row comes once its file is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def put() -> pa.RecordBatch:
            name, size = uuid.uuid4().hex, np.array([len(x) for x in held], np.int64)
            put_array(folder, name, np.concatenate(held))
            place = pa.StructArray.from_arrays([pa.array([name] * len(held)), pa.array(np.cumsum(size) - size), pa.array(size)], ["file", "first", "n"])
            return pa.RecordBatch.from_arrays([pa.array([name_of(x) for x in held], pa.int64()), place], ["node", "place"])

        size = 0
        for batch in small(batches):
            for t in texts_of(batch.column(0)):
                held.append(np.unique(hashed_shingles(t, shingle)))
                size += len(held[-1])
                if size >= IN_FILE:
                    yield put()
                    held, size = [], 0
        if held:
            yield put()

    return docs.select(text).mapInArrow(run, f"node long, {PLACE}")


def sets_at(places: pa.Array, folder: str) -> list[np.ndarray]:
    """The sets at (file, first, n)."""
    return [get_array(folder, p["file"], np.uint64)[p["first"] : p["first"] + p["n"]] for p in places.to_pylist()]


def _comparer(least: float, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            fits = []
            for p, q in zip(*(sets_at(batch.column(i), folder) for i in (2, 3)), strict=True):
                n, m = len(p), len(q)
                both = 0
                if min(n, m) >= least * max(n, m):
                    both = int((q[np.minimum(np.searchsorted(q, p), m - 1)] == p).sum()) if m else 0
                fits.append(both >= least * (n + m - both))
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    return run


def sets_of(nodes: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, folder: str) -> DataFrame:
    """(node, place) of ``nodes`` (node), as a written table; the sets are in ``folder``. sets: (node, lead), lead a key of the
    node's texts: only these texts are read again, one for each node."""
    nodes = nodes.select("node").distinct()
    # a key may have several texts, those of other nodes are dropped by name
    lead = sets.join(nodes, "node", "left_semi").select(F.col("lead").alias("__lead")).distinct()
    chosen = docs.join(lead, F.col(key) == F.col("__lead"), "left_semi")
    made = with_sets(chosen, text, shingle, folder).join(nodes, "node", "left_semi")
    return written(made.groupBy("node").agg(F.min("place").alias("place")), "similar-sets")


def verified(pairs: DataFrame, found: DataFrame, least: float, folder: str) -> DataFrame:
    """The ``pairs`` (a, b) of nodes whose sets (node, place) in ``folder`` are similar enough, as a written table.

    A node of many pairs is dealt to several tasks.
    """
    pairs = written(pairs, "similar-pairs")
    load = pairs.groupBy(F.col("a").alias("node")).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("tasks"))
    left = found.join(load, "node").select(F.col("node").alias("a"), F.col("place").alias("x"), F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("part"))
    dealt = pairs.join(load.withColumnRenamed("node", "a"), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("part"))
    both = dealt.join(found.select(F.col("node").alias("b"), F.col("place").alias("y")), "b").join(left, ["a", "part"]).select("a", "b", "x", "y")
    return written(both.mapInArrow(_comparer(least, folder), "a long, b long"), "similar-links")


def banded_pairs(sets: DataFrame) -> DataFrame:
    """(band, node) of the buckets that several nodes share; sets: (node, bands)."""
    buckets = sets.select("node", F.explode("bands").alias("band"))
    shared = buckets.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("band", "a")
    return written(buckets.join(shared, "band"), "similar-buckets")


def open_members(buckets: DataFrame, tied: DataFrame) -> DataFrame:
    """(band, node, part) of the buckets whose members are in several components so far, as a written table."""
    part = buckets.select("band", "node").join(tied, "node", "left").select("band", "node", F.coalesce("component", "node").alias("part"))
    mixed = part.groupBy("band").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("band")
    return written(part.join(mixed, "band", "left_semi"), "similar-open")


def _joiner(least: float, folder: str):
    """Links within groups of rows (group, side, node, part, place), sorted by group: between the members of side 0 and side 1,
    or where there is no side 1 among all. Members of one part, or joined before, are not linked again."""

    def links_of(side: np.ndarray, node: np.ndarray, part: np.ndarray, hashes: list[np.ndarray]) -> Iterator[tuple[int, int]]:
        size = np.array([len(h) for h in hashes])
        owner = np.repeat(np.arange(len(node)), size)
        _, shingle, n_each = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
        order = np.argsort(shingle, kind="stable")
        holders, first = owner[order], np.cumsum(n_each) - n_each
        end = np.cumsum(size)
        forest = Forest()
        for i in range(len(node) - 1):
            own = shingle[end[i] - size[i] : end[i]]
            n = n_each[own]
            place = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            both = np.bincount(holders[place], minlength=len(node))
            hit = both >= least * (size + size[i] - both)
            hit[: i + 1] = False
            if side.any():
                hit &= side != side[i]
            for j in np.flatnonzero(hit & (part != part[i])).tolist():
                if forest.join(int(part[i]), int(part[j])):
                    yield int(node[i]), int(node[j])

    def made(held: list[list]) -> pa.RecordBatch:
        side, node, part = (np.concatenate([h[i] for h in held]) for i in range(3))
        sets = [x for h in held for x in sets_at(h[3], folder)]
        found = np.array(list(links_of(side, node, part, sets)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            group = batch.column(0).to_numpy()
            edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]).tolist() if len(group) else []
            for a, b in zip(edge, [*edge[1:], len(group)], strict=True):
                if held and group[a] != now:
                    yield made(held)
                    held = []
                now = group[a]
                rows = batch.slice(a, b - a)
                held.append([*(rows.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)), rows.column(4)])
        if held:
            yield made(held)

    return run


def joined_members(left: DataFrame, found: DataFrame, least: float, folder: str) -> DataFrame:
    """Links (a, b) that join all similar members of each bucket of ``left`` (band, node, part): a forest of each, not all pairs.

    Pairs are compared within a task, by an inverted index of its sets. A large bucket is cut into blocks, and the rows of two blocks meet
    in a group of their own, so that no task holds more than two blocks and rows grow with members times blocks.
    """
    rows = left.join(found, "node").select("band", "node", "part", "place")
    load = left.join(found.select("node", "place.n"), "node").groupBy("band").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    blocks = F.greatest(F.ceil(F.col("m") / MEMBERS), F.ceil(F.col("n") / SHINGLES)).cast("int")
    dealt = rows.join(load.select("band", blocks.alias("blocks")), "band").withColumn("own", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(F.xxhash64("band", low, high).alias("group"), ((F.col("own") != F.col("other")) & (F.col("own") == high)).cast("byte").alias("side"), "node", "part", "place")
    return written(dealt.repartition(F.col("group")).sortWithinPartitions("group", "side", "node").mapInArrow(_joiner(least, folder), "a long, b long"), "similar-joined")


def components_of(rows: DataFrame, sets: DataFrame, docs: DataFrame, key: str, text: str, shingle: int, least: float, near: DataFrame) -> DataFrame:
    """(node, component): sets that links of similarity ``least`` or more reach; nodes without a link are absent.

    rows: (__key, node); sets: (node, lead, bands). near: pairs (a, b) to be tried besides those that share a band. Members of a
    bucket meet its least one first; then, in buckets whose members are in several components, those of different ones meet
    each other. Sets of one key are tied.
    """
    buckets = banded_pairs(sets)
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    stars = written(buckets.where("a <> node").select("a", F.col("node").alias("b")).union(near).distinct(), "similar-stars")
    folder = new_dir(rows.sparkSession, "similar-arrays")
    found = sets_of(buckets.select("node").union(stars.select("a")).union(stars.select("b")), sets, docs, key, text, shingle, folder)
    own = rows.groupBy("__key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("__key", "a")
    same = rows.select("__key", "node").distinct().join(own, "__key").where("node <> a").select("a", F.col("node").alias("b"))
    links = written(verified(stars, found, least, folder).union(same), "similar-first")
    left = open_members(buckets, components(links, "a", "b"))
    return components(links.union(joined_members(left, found, least, folder)), "a", "b")
