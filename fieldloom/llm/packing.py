"""Packing of texts into training sequences of several permitted lengths.

Best fit with bins of variable capacity: a piece, the largest first, goes into the open bin it leaves the least room in;
if none has room, a bin opens. Its size is chosen then, by cost: for each permitted length, what is still to come is
laid into such a bin as full as greedy steps get it, and the size with the least cost a token, once the bin has
shrunk to that content, opens. At the end each bin shrinks to the least permitted length that holds its contents.
Always opening one preferred length is tried too; the cheapest of these packings stays.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (512, 1024, 2048, 4096)
#: Rows that are packed together, or tokens if they come first; a task packs one block after the other.
BLOCK_ROWS, BLOCK_TOKENS = 16_384, 1 << 26


def cost(length: int, longest: int) -> float:
    """Of a sequence: its tokens, and attention that grows with their square."""
    return length * (1 + 0.25 * length / longest)


def pieces(sizes: Sequence[int], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, start, length): each item cut into full sequences and a rest."""
    size = np.asarray(sizes, np.int64)
    count = -(-size // longest)
    item = np.repeat(np.arange(len(size)), count)
    start = (np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)) * longest
    return item, start, np.minimum(longest, size[item] - start)


class _ToCome:
    """How many pieces of each size are not placed yet; a bit for each size that has some."""

    def __init__(self, sizes: Sequence[int]) -> None:
        self.count = Counter(sizes)
        self.mask = sum(1 << s for s in self.count)

    def take(self, size: int) -> None:
        self.count[size] -= 1
        if not self.count[size]:
            self.mask ^= 1 << size

    def filled(self, room: int) -> int:
        """Tokens that go into ``room``, the largest size that fits first."""
        left, mask = room, self.mask
        while left > 0 and (fits := mask & ((2 << left) - 1)):
            size = fits.bit_length() - 1
            n = min(self.count[size], left // size)
            left -= n * size
            mask &= (1 << size) - 1
        return room - left


def cheapest_size(size: int, to_come: _ToCome, lengths: Sequence[int]) -> int:
    """The capacity a bin for ``size`` opens with: the least cost a token of its likely contents, ties to the shorter."""
    longest = lengths[-1]

    def price(length: int) -> tuple[float, int]:
        tokens = size + to_come.filled(length - size)
        return cost(lengths[bisect_left(lengths, tokens)], longest) / tokens, length

    return min(price(n) for n in lengths[bisect_left(lengths, size) :])[1]


def best_fit(sizes: Sequence[int], opened: Callable[[int, _ToCome], int]) -> tuple[list[int], list[int]]:
    """(bin of each size, fill of each bin), larger sizes first; ``opened`` gives the capacity a bin opens with for a size,
    from what is still to come."""
    room: list[tuple[int, int]] = []
    bins, fill, to_come = [0] * len(sizes), [], _ToCome(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        to_come.take(s)
        at = bisect_left(room, (s, -1))
        if at == len(room):
            left, b = opened(s, to_come), len(fill)
            fill.append(0)
        else:
            left, b = room.pop(at)
        bins[i] = b
        fill[b] += s
        if left > s:
            insort(room, (left - s, b))
    return bins, fill


def pack(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS) -> tuple[list[int], list[int]]:
    """(bin of each size, length of each bin) at the least cost found; no size is over the longest length."""
    lengths = sorted(lengths)
    fits = lambda n: lengths[bisect_left(lengths, n)]
    rules = [lambda s, to_come: cheapest_size(s, to_come, lengths)] + [lambda s, to_come, preferred=n: max(preferred, fits(s)) for n in lengths]
    found = None
    for rule in rules if sizes else []:
        bins, fill = best_fit(sizes, rule)
        final = [fits(f) for f in fill]
        price = sum(cost(x, lengths[-1]) for x in final)
        if found is None or price < found[0]:
            found = price, bins, final
    return (found[1], found[2]) if found else ([], [])


def n_tokens(text: Column) -> Column:
    """Words of a text and its end."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")) + 1).cast("long")


def _packer(lengths: tuple[int, ...], names: list[str]):
    def packed(before_: int, whole: pa.Table) -> tuple[pa.RecordBatch, int]:
        keys, sizes = whole.column(0).combine_chunks(), whole.column(1).to_numpy()
        item, start, size = pieces(sizes, max(lengths))
        bins, final = pack(size.tolist(), lengths)
        b = np.array(bins, np.int64)
        order = np.lexsort((np.arange(len(b)), b))
        new = np.r_[True, b[order][1:] != b[order][:-1]] if len(b) else np.zeros(0, bool)
        before = np.cumsum(size[order]) - size[order]
        offset = np.empty(len(b), np.int64)
        offset[order] = before - before[np.flatnonzero(new)][np.cumsum(new) - 1] if len(b) else 0
        task = TaskContext.get().partitionId()
        ids = (np.int64(task) << np.int64(40)) + before_ + b  # bins are numbered through all blocks of a task
        cols = [keys.take(pa.array(item)), pa.array(start), pa.array(size), pa.array(ids), pa.array(np.array(final, np.int64)[b]), pa.array(offset)]
        return pa.RecordBatch.from_arrays(cols, names), before_ + len(final)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, tokens, bins = [], 0, 0, 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            tokens += pc.sum(batch.column(1)).as_py() or 0
            if n >= BLOCK_ROWS or tokens >= BLOCK_TOKENS:
                out, bins = packed(bins, pa.Table.from_batches(held))
                yield out
                held, n, tokens = [], 0, 0
        if n:
            yield packed(bins, pa.Table.from_batches(held))[0]

    return run


def packed(docs: DataFrame, key: str = "doc_id", text: str = "text", size: Column | None = None, lengths: Sequence[int] = LENGTHS) -> DataFrame:
    """(key, start, n_tokens, sequence, sequence_length, position) of each piece of each row of ``docs``.

    Tokens ``start`` to ``start + n_tokens`` of the row stand at ``position`` of their sequence. ``size``: tokens
    of a row, 1 at least; by default its words and an end, so that a null or empty text has one. Rows over the longest
    length are cut into several pieces; none is dropped. Rows are packed where they lie, in blocks, so nothing is
    shuffled: which rows share a sequence, and the sequences' numbers, depend on how the table is split into partitions. Repeated
    rows and null keys are packed like others. An empty table gives no rows; other columns are ignored.
    """
    lengths = tuple(sorted(set(lengths)))
    rows = docs.select(F.col(key).alias("__key"), (n_tokens(F.col(text)) if size is None else size.cast("long")).alias("__size"))
    names = ["__key", "start", "n_tokens", "sequence", "sequence_length", "position"]
    kind = rows.schema[0].dataType.simpleString()
    out = rows.mapInArrow(_packer(lengths, names), f"__key {kind}, start long, n_tokens long, sequence long, sequence_length long, position long")
    return out.withColumnRenamed("__key", key)
