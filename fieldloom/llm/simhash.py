"""Near duplicates by SimHash, found through Golay-code fuzzy keys.

A fingerprint has 64 bits; two link if 3 bits or fewer differ. It is cut into three segments of 22, 21 and 21
bits. Among three errors, two segments always have at most one error each. The binary Golay code (23, 12) is
perfect, so each segment lies within 3 bits of exactly one codeword; its 12-bit index is the segment's key, and
a segment with one bit changed decodes to one of a few more keys. For each pair of segments one side gives the
nearby keys of the first segment with the own key of the second, the other side the reverse. Fingerprints that
link therefore share a 24-bit key, and those that share one are compared bit by bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import components
from .shared import small, written
from .similar import Forest, components_of, hashed_shingles, simhash, with_sketches
from .words import texts_of

SEGMENTS = ((0, 22), (22, 21), (43, 21))
GENERATOR = 0b101011100011
#: Rows of each side of a bucket that one group may hold, about; a larger bucket is dealt out in blocks.
BLOCK = 2048


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """SimHash of a text's word shingles; 0 if it has no word."""
    return simhash(hashed_shingles(text, shingle))


def with_fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 3) -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed 64-bit integer."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            made = np.array([fingerprint(x, shingle) for x in texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["__key", "__fp"])

    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return rows.mapInArrow(run, f"__key {rows.schema[0].dataType.simpleString()}, __fp long")


class Golay:
    """Index of the codeword nearest to 23 bits."""

    def __init__(self) -> None:
        high = np.arange(4096, dtype=np.int64) << 11
        for bit in range(22, 10, -1):
            high ^= ((high >> bit) & 1) * (GENERATOR << (bit - 11))
        self.high = high
        self.error = np.zeros(2048, np.int64)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                word = sum(1 << b for b in bits)
                self.error[self.high[word >> 11] ^ (word & 2047)] = word

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.high[words >> 11] ^ (words & 2047)]) >> 11

    def nearby(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, index) once for each index of a word or of that word with one of its low bits changed."""
        flips = np.concatenate([[0], 1 << np.arange(bits, dtype=np.int64)])
        found = np.sort(self.index(words[:, None] ^ flips), axis=1)
        new = np.ones(found.shape, bool)
        new[:, 1:] = found[:, 1:] != found[:, :-1]
        return np.nonzero(new)[0], found[new]


def fuzzy_keys(fp: np.ndarray, golay: Golay) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(row, key, side) of each fingerprint: those that link meet on a key, one on side 0 and one on side 1."""
    parts = [((fp >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64) for at, bits in SEGMENTS]
    own = [golay.index(x) for x in parts]
    near = [golay.nearby(x, bits) for x, (_, bits) in zip(parts, SEGMENTS, strict=True)]
    for pair, (i, j) in enumerate(combinations(range(3), 2)):
        row, index = near[i]
        yield row, (pair << 24) | (index << 12) | own[j][row], 0
        row, index = near[j]
        yield row, (pair << 24) | (own[i][row] << 12) | index, 1


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    golay = Golay()
    for batch in batches:
        fp, node = (batch.column(i).to_numpy() for i in (0, 1))
        for at in range(0, len(fp), 8192):
            for row, key, side in fuzzy_keys(fp[at : at + 8192].view(np.uint64), golay):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(row), side, np.int8)), pa.array(fp[at + row]), pa.array(node[at + row])], ["key", "side", "fp", "node"])


def _linker(bits: int):
    def within(group: np.ndarray, side: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links between the two sides of each group of rows; rows are sorted by group, then side."""
        edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.r_[edge, len(group)])
        left = np.add.reduceat((side == 0).astype(np.int64), edge)
        keep = (left > 0) & (left < size)
        edge, size, left = edge[keep], size[keep], left[keep]
        right = size - left
        todo, forest = left * right, Forest()
        done, b = np.cumsum(todo), 0
        while b < len(todo):
            a, b = b, max(b + 1, int(np.searchsorted(done, (done[b - 1] if b else 0) + (1 << 21), "right")))
            t = todo[a:b]
            k = np.arange(int(t.sum())) - np.repeat(np.cumsum(t) - t, t)
            x = np.repeat(edge[a:b], t) + k // np.repeat(right[a:b], t)
            y = np.repeat(edge[a:b] + left[a:b], t) + k % np.repeat(right[a:b], t)
            hit = np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64)) <= bits
            hit &= node[x] != node[y]
            for p, q in zip(node[x[hit]].tolist(), node[y[hit]].tolist(), strict=True):
                if forest.join(p, q):
                    yield p, q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # parts of the last group, joined once it is whole
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(cols[0]):
                continue
            end = int(np.searchsorted(cols[0], cols[0][-1]))
            if held and cols[0][0] != held[-1][0][0]:
                yield made(within(*map(np.concatenate, zip(*held, strict=True))))
                held = []
            if end:
                yield made(within(*map(np.concatenate, zip(*held, [x[:end] for x in cols], strict=True))))
                held = []
            held.append([x[end:] for x in cols])
        if held:
            yield made(within(*map(np.concatenate, zip(*held, strict=True))))

    def made(links: Iterator[tuple[int, int]]) -> pa.RecordBatch:
        found = np.array(list(links), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def links(nodes: DataFrame, bits: int = 3) -> DataFrame:
    """Links (a, b) that join all nodes of ``nodes`` (fp, node) whose fingerprints differ in ``bits`` (at most 3)
    or fewer bits: in each bucket as many as a spanning forest needs, not all pairs."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys hold for 3 differing bits at most")
    keys = written(nodes.select("fp", "node").mapInArrow(_keys, "key long, side byte, fp long, node long"), "simhash-keys")
    sides = keys.groupBy("key").agg(F.count_if(F.col("side") == 0).alias("l"), F.count_if(F.col("side") == 1).alias("r")).where("l > 0 and r > 0")
    large = written(sides.where(f"l * r > {BLOCK * BLOCK} or l + r > {4 * BLOCK}"), "simhash-large")
    if large.isEmpty():
        rows = keys.withColumn("group", F.col("key"))
    else:
        dealt = keys.join(large, "key", "left")
        blocks = [F.coalesce(F.ceil(F.col(n) / BLOCK), F.lit(1)).cast("int") for n in "lr"]
        mine, theirs = (F.when(F.col("side") == 0, blocks[i]).otherwise(blocks[1 - i]) for i in (0, 1))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), mine).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), theirs - 1)))
        rows = dealt.withColumn("group", F.expr("xxhash64(key, if(side = 0, own, other), if(side = 0, other, own))"))
    rows = rows.select("group", "side", "fp", "node").repartition(F.col("group")).sortWithinPartitions("group", "side")
    return rows.mapInArrow(_linker(bits), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", bits: int = 3, shingle: int = 3) -> DataFrame:
    """(key, fingerprint, component_id) for each row of ``docs``.

    fingerprint: 16 hex digits. component_id: the smallest key that links reach. Texts null or without a word
    have fingerprint zero and link like any other. Rows with one key count as one document. A row with a null
    key has its fingerprint but takes no part: its component_id is null. An empty table gives no rows; other
    columns are ignored.
    """
    fps = written(with_fingerprints(docs, key, text, shingle), "simhash-fps")
    nodes = fps.where("__key is not null").groupBy(F.col("__fp").alias("fp")).agg(F.min("__key").cast("long").alias("node"))
    nodes = written(nodes, "simhash-nodes")
    firsts = fps.where("__key is not null").groupBy("__key").agg(F.min("__fp").alias("low"), F.max("__fp").alias("high")).where("low <> high")
    same = fps.join(firsts.select("__key"), "__key").join(nodes, F.col("__fp") == F.col("fp")).select(F.col("__key").alias("a"), F.col("node").alias("b"))
    tied = components(links(nodes, bits).union(same), "a", "b")
    part = nodes.join(tied, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = fps.join(part, F.col("__fp") == F.col("fp"), "left")
    hexed = F.lower(F.lpad(F.hex("__fp"), 16, "0"))
    return out.select(F.col("__key").alias(key), hexed.alias("fingerprint"), F.when(F.col("__key").isNotNull(), F.col("component_id")).alias("component_id"))


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that stay: of each group that links reach, the one with the smallest key.

    Texts link if the Jaccard similarity of their sets of ``shingle``-word shingles is ``least`` or more. Texts whose fingerprints
    meet on a Golay key within 3 bits, and those that share a band of least hashes, are compared. Texts null or without a word link
    with each other. Rows of one key are one document; of several such rows the one whose text has the least CRC-32 stays, equal
    ones in any order. Rows with a null key stay. An empty table gives no rows.
    """
    rows = written(with_sketches(docs, key, text, shingle), "simhash-sketches")
    sets = written(rows.groupBy("node").agg(F.min("__key").alias("lead"), F.min("fp").alias("fp"), F.any_value("bands").alias("bands")), "simhash-sets")
    print_of = sets.groupBy("fp").agg(F.min("node").alias("node"))
    equal = sets.select("fp", "node").join(print_of.withColumnRenamed("node", "a"), "fp").where("node <> a").select("a", F.col("node").alias("b"))
    tied = components_of(rows, sets, docs, key, text, shingle, least, links(print_of).unionByName(equal))
    part = sets.join(tied, "node", "left").groupBy(F.coalesce("component", "node").alias("part")).agg(F.min("lead").alias("__kept"))
    whole = docs.select(F.struct("*").alias("row"), F.col(key).alias("__key"), F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("__crc"))
    left = whole.join(part.select("__kept").distinct(), F.col("__key") == F.col("__kept"), "left_semi")
    one = left.withColumn("__turn", F.row_number().over(Window.partitionBy("__key").orderBy("__crc"))).where("__turn = 1")
    return one.select("row").union(whole.where("__key is null").select("row")).select("row.*")

