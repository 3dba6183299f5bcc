"""Label propagation and colours by successors over the incidence, without a row for each pair of constraints that share a signal.

The incidence lies in files of the shared folder, once by signals and once by constraints, in parts by the key modulo a prime.
A round is two passes without a shuffle: each signal's labels are counted, then each constraint adds up the counts of its
signals in blocks of ``BLOCK`` entries. Workers map the files into memory, so neither pairs nor votes reach the disk.
Where few labels changed, a constraint adds up the changes of its signals' counts: while its label's votes stay above a bound of
all lesser labels' and not below one of all greater labels' it keeps its label, exactly; only the rest add up whole counts again.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut, drop

#: Counts a worker adds up at once; a constraint with more takes a block of its own.
BLOCK = 2_000_000
#: Arrays a worker holds open, the last used at the end.
_OPEN: OrderedDict[str, np.ndarray] = OrderedDict()
_MOST_OPEN = 4096


def put(folder: str, name: str, data: np.ndarray) -> None:
    """Writes an array whole or not at all: a task that runs twice leaves the same file."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path)
    half = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(half) as out:
        out.write(np.ascontiguousarray(data, np.int64).tobytes())
    store.move(half, f"{path}/{name}")


def get(folder: str, name: str) -> np.ndarray:
    """A file's array, mapped into memory: in place, or from a copy on this machine's disk where the folder is in a store."""
    at = f"{folder}/{name}"
    if at in _OPEN:
        _OPEN.move_to_end(at)
        return _OPEN[at]
    place = urlparse(folder)
    path = f"{place.path}/{name}"
    if place.scheme not in ("", "file"):
        from pyarrow import fs

        store, there = fs.FileSystem.from_uri(folder)
        path = os.path.join(tempfile.gettempdir(), os.path.basename(folder), name)
        if not os.path.exists(path):
            os.makedirs(os.path.dirname(path), exist_ok=True)
            half = f"{path}.{uuid.uuid4().hex}"
            with store.open_input_stream(f"{there}/{name}") as found, open(half, "wb") as out:
                out.write(found.read())
            os.replace(half, path)
    _OPEN[at] = np.memmap(path, np.int64, "r") if os.path.getsize(path) else np.zeros(0, np.int64)
    if len(_OPEN) > _MOST_OPEN:
        _OPEN.popitem(last=False)
    return _OPEN[at]


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, places of its keys)."""
    part = (keys % parts).astype(np.int16 if parts < 1 << 15 else np.int64)  # of 16 bits, a radix sort
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if ends[p] < ends[p + 1]:
            yield p, order[ends[p] : ends[p + 1]]


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] of them), start[1], ..."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _closed(folder: str, r: int) -> None:
    """Lets go of arrays of rounds before ``r``: a deleted file keeps its disk as long as a worker maps it."""
    for at in [x for x in _OPEN if x.startswith(folder) and (m := re.match(r"[a-z]+(\d+)-", x[len(folder) + 1 :])) and int(m[1]) < r]:
        del _OPEN[at]


def _stored(inc: DataFrame, key: str, value: str, folder: str, parts: int) -> int:
    """Writes each part's keys in order, where the values of each begin, and the values; their number of keys."""

    def write(table: pa.Table) -> pa.Table:
        k, v = (table.column(c).to_numpy().astype(np.int64) for c in (key, value))
        order = np.lexsort((v, k))
        keys, start = np.unique(k[order], return_index=True)
        p = int(k[0] % parts)
        put(folder, f"{key}-{p}-keys", keys)
        put(folder, f"{key}-{p}-start", np.append(start, len(k)))
        put(folder, f"{key}-{p}-values", v[order])
        return pa.table({"part": pa.array([p], pa.int64()), "n": pa.array([len(keys)], pa.int64())})

    got = dict(map(tuple, inc.groupBy(F.pmod(F.col(key), F.lit(parts)).alias("part")).applyInArrow(write, "part long, n long").collect()))
    for p in set(range(parts)) - set(got):
        for name, data in (("keys", []), ("start", [0]), ("values", [])):
            put(folder, f"{key}-{p}-{name}", np.array(data, np.int64))
    return sum(got.values())


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)


def _shared(folder: str, parts: int, p: int) -> int:
    """Writes the constraints of part ``p`` that share a signal, such signals of each and their places in their parts; how many."""
    keys, start, signals = (get(folder, f"coni-{p}-{x}") for x in ("keys", "start", "values"))
    place = np.empty(len(signals), np.int64)
    for q, at in _by_part(signals, parts):
        place[at] = np.searchsorted(get(folder, f"signal-{q}-keys"), signals[at])
        ends = get(folder, f"signal-{q}-start")
        place[at[ends[place[at] + 1] - ends[place[at]] < 2]] = -1
    held = np.flatnonzero(place >= 0)
    node = keys[np.repeat(np.arange(len(keys)), np.diff(start))[held]]
    first = _starts(node)
    for name, data in (("keys", node[first]), ("start", np.append(first, len(node))), ("values", signals[held]), ("place", place[held])):
        put(folder, f"node-{p}-{name}", data)
    put(folder, f"label0-{p}", node[first])
    return len(first)


def _members(folder: str, parts: int, p: int) -> None:
    """Writes where each constraint of part ``p``'s shared signals lies: entries in order of its part, places there."""
    start, nodes = get(folder, f"signal-{p}-start"), get(folder, f"signal-{p}-values")
    several = np.flatnonzero(np.repeat(np.diff(start) > 1, np.diff(start)))
    at, place, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(parts + 1, np.int64)
    for q, x in _by_part(nodes[several], parts):
        at.append(several[x])
        place.append(np.searchsorted(get(folder, f"node-{q}-keys"), nodes[several[x]]))
        ends[q + 1] = len(x)
    for name, data in (("at", np.concatenate(at)), ("place", np.concatenate(place)), ("ends", np.cumsum(ends))):
        put(folder, f"signal-{p}-{name}", data)


def _tabled(folder: str, name: str, keys: int, row: np.ndarray, label: np.ndarray, n: np.ndarray) -> None:
    """Writes the sums of ``n`` that are not 0 by row and label, and where each of the rows 0 to ``keys`` begins."""
    if len(row):
        row, label, n = _summed(row, label, n)
        row, label, n = (x[n != 0] for x in (row, label, n))
    for what, data in (("start", np.searchsorted(row, np.arange(keys + 1))), ("label", label), ("n", n)):
        put(folder, f"{name}-{what}", data)


def _counted(folder: str, r: int, parts: int, p: int, few: bool) -> None:
    """The labels of each signal of part ``p`` in round ``r``, and how many constraints have them; ``few``: and how many more than before."""
    start, at, place, ends = (get(folder, f"signal-{p}-{x}") for x in ("start", "at", "place", "ends"))

    def labels(r):
        return np.concatenate([np.zeros(0, np.int64), *(get(folder, f"label{r}-{q}")[place[ends[q] : ends[q + 1]]] for q in range(parts) if ends[q] < ends[q + 1])])

    row, label = np.repeat(np.arange(len(start) - 1), np.diff(start))[at], labels(r)
    _tabled(folder, f"count{r}-{p}", len(start) - 1, row, label, np.ones(len(row), np.int64))
    if few:
        before = labels(r - 1)
        moved = np.flatnonzero(label != before)
        n = np.repeat(np.array([1, -1]), len(moved))
        _tabled(folder, f"delta{r}-{p}", len(start) - 1, np.tile(row[moved], 2), np.append(label[moved], before[moved]), n)


def _summed(row: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, label, sum of n) in order; packed into one number a row where they fit."""
    low = int(label.min())
    bits = [int(x).bit_length() for x in (row.max(), int(label.max()) - low, n.max())]
    if sum(bits) < 63 and n.min() >= 0:
        key = np.sort((row << (bits[1] + bits[2])) | ((label - low) << bits[2]) | n)
        n, key = key & ((1 << bits[2]) - 1), key >> bits[2]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        key = key[first]
        return key >> bits[1], (key & ((1 << bits[1]) - 1)) + low, np.add.reduceat(n, first)
    order = np.lexsort((label, row))
    row, label, n = row[order], label[order], n[order]
    first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (label[1:] != label[:-1])))
    return row[first], label[first], np.add.reduceat(n, first)


def _ranges(folder: str, table: str, parts: int, p: int, which: np.ndarray) -> tuple[np.ndarray, ...]:
    """The signals of some constraints of part ``p``: (signals, how many a constraint, where the rows of each begin, how many)."""
    start, signals, place = (get(folder, f"node-{p}-{x}") for x in ("start", "values", "place"))
    size = start[which + 1] - start[which]
    at = _spread(start[which], size)
    signals, place = signals[at], place[at]
    begin, n = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    for q, x in _by_part(signals, parts):
        ends = get(folder, f"{table}-{q}-start")
        begin[x] = ends[place[x]]
        n[x] = ends[place[x] + 1] - begin[x]
    return signals, size, begin, n


def _blocks(folder: str, table: str, parts: int, found: tuple[np.ndarray, ...]) -> Iterator[tuple]:
    """(a, b, row, label, n) for the constraints a to b of ``_ranges``: the rows of their signals, by the constraint less a."""
    signals, size, begin, n = found
    first = np.append(0, np.cumsum(size))
    total = np.append(0, np.cumsum(n))[first]
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] + BLOCK, "right")) - 1)
        rows = first[a] + np.flatnonzero(n[first[a] : first[b]])
        node, made = np.repeat(np.arange(b - a), size[a:b])[rows - first[a]], []
        for q, x in _by_part(signals[rows], parts):
            many = n[rows[x]]
            at = _spread(begin[rows[x]], many)
            made.append((np.repeat(node[x], many), get(folder, f"{table}-{q}-label")[at], get(folder, f"{table}-{q}-n")[at]))
        if made:
            yield a, b, *(np.concatenate(x) for x in zip(*made, strict=True))
        a = b


def _raised(best: np.ndarray, row: np.ndarray, greater: np.ndarray, n: np.ndarray) -> None:
    """Adds to the bounds of lesser and of greater labels the most that one of these has; rows and labels in order."""
    heads = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (greater[1:] != greater[:-1])))
    best[1 + greater[heads], row[heads]] += np.maximum.reduceat(n, heads)


def _voted(folder: str, r: int, parts: int, p: int, few: bool) -> int:
    """Writes the labels of part ``p`` after round ``r``; how many changed. Beside them the entries of each constraint's signals
    that have its label, and bounds of those that have any one lesser and any one greater; its own entries are in all three."""
    own, size = get(folder, f"label{r}-{p}"), np.diff(get(folder, f"node-{p}-start"))
    new, best, which = np.array(own), np.zeros((3, len(own)), np.int64), np.arange(len(own))
    if few:
        best = np.array(get(folder, f"best{r}-{p}")).reshape(3, -1)
        for a, b, row, label, n in _blocks(folder, f"delta{r}", parts, _ranges(folder, f"delta{r}", parts, p, which)):
            mine = label == own[a:b][row]
            np.add.at(best[0], a + row[mine], n[mine])
            more = ~mine & (n > 0)
            if more.any():
                row, label, n = _summed(row[more], label[more], n[more])
                _raised(best, a + row, label > own[a + row], n)
        votes = best[0] + 1 - size
        which = np.flatnonzero((votes <= best[1]) | (votes < best[2]))  # others keep their label
    found = _ranges(folder, f"count{r}", parts, p, which)
    for a, b, row, label, n in _blocks(folder, f"count{r}", parts, found):
        nodes = which[a:b]
        row, label, n = _summed(row, label, n)
        votes, mine = np.array(n), label == own[nodes][row]
        votes[mine] += 1 - size[nodes][row[mine]]  # a constraint's own entries are no neighbours; itself counts 1
        heads = _starts(row)
        top = np.flatnonzero(votes == np.repeat(np.maximum.reduceat(votes, heads), np.diff(np.append(heads, len(row)))))
        at = top[_starts(row[top])]  # of a constraint's best the least label
        new[nodes], best[0, nodes] = label[at], n[at]
        best[1:, nodes], n[at] = 0, 0
        _raised(best, nodes[row], label > new[nodes][row], n)
    put(folder, f"label{r + 1}-{p}", new)
    put(folder, f"best{r + 1}-{p}", best)
    return int((new != own).sum())


def laid_out(inc: DataFrame) -> tuple[str, int]:
    """(folder, parts) of the files of an incidence that ``cut`` wrote; the table is deleted."""
    spark = inc.sparkSession
    folder = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()).rstrip('/')}/votes-{uuid.uuid4().hex}"
    rows = inc.count()  # a part looks into the files of all others, so small parts cost more than they share out
    parts = _prime(max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(12, rows // 20_000)), rows // 500_000))
    for key, value in (("signal", "coni"), ("coni", "signal")):
        _stored(inc, key, value, folder, parts)
    drop(inc)
    return folder, parts


def _each(spark, parts: int, work: Callable[[int], Iterator[pa.RecordBatch]], schema: str = "x long") -> DataFrame:
    """What ``work`` gives for each part, a task a part."""

    def run(batches):
        for batch in batches:
            for p in batch.column(0).to_pylist():
                yield from work(p)

    return spark.range(0, parts, 1, parts).mapInArrow(run, schema)


def propagated(inc: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, label): as ``graph.propagated_labels`` over ``shared_signals`` of the incidence (coni, signal): each constraint
    takes the label of most votes, a vote a neighbour and shared signal, itself counting 1, ties to the least."""
    inc = cut(inc.select("coni", "signal").dropna())
    spark, (folder, parts) = inc.sparkSession, laid_out(inc)

    def each(work):
        return sum(x for x, in _each(spark, parts, lambda p: iter([pa.RecordBatch.from_pydict({"x": pa.array([work(p) or 0], pa.int64())})])).collect())

    nodes = each(lambda p: _shared(folder, parts, p))
    each(lambda p: _members(folder, parts, p))
    r, changed = 0, nodes
    while r < rounds:
        few = 10 * changed < nodes  # else most would add up whole counts as well

        def count(p, r=r, few=few):
            _closed(folder, r - 1)
            _counted(folder, r, parts, p, few)

        def vote(p, r=r, few=few):
            _closed(folder, r)
            return _voted(folder, r, parts, p, few)

        each(count)
        changed = each(vote)
        _removed(spark, folder, f"{{count,delta,best}}{r}-*")
        if r:
            _removed(spark, folder, f"label{r - 1}-*")
        r += 1
        if not changed:
            break

    def result(p):
        yield pa.RecordBatch.from_pydict({"node": pa.array(get(folder, f"node-{p}-keys"), pa.int64()), "label": pa.array(get(folder, f"label{r}-{p}"), pa.int64())})

    out = cut(_each(spark, parts, result, "node long, label long"))
    _removed(spark, folder, "")
    return out


# --- colours by successors ----------------------------------------------------------------------------------


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes; sums of them wrap."""
    z = x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)
    for turn, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(turn))) * np.uint64(by)
    return z ^ (z >> np.uint64(31))


def _colors(folder: str, r: int, parts: int, nodes: np.ndarray) -> np.ndarray:
    out = np.empty(len(nodes), np.int64)
    for q, at in _by_part(nodes, parts):
        out[at] = get(folder, f"color{r}-{q}")[np.searchsorted(get(folder, f"coni-{q}-keys"), nodes[at])]
    return out


def _placed(folder: str, parts: int, p: int) -> None:
    """Once: where each entry of part ``p``'s constraints stands among its signal's, and the successors that share more than
    one signal (node's row, successor), once for each signal but the first."""
    keys, start, signals = (get(folder, f"coni-{p}-{x}") for x in ("keys", "start", "values"))
    row = np.repeat(np.arange(len(keys)), np.diff(start))
    place, after = np.empty(len(signals), np.int64), np.empty(len(signals), np.int64)
    for q, at in _by_part(signals, parts):
        members, ends = get(folder, f"signal-{q}-values"), get(folder, f"signal-{q}-start")
        s = np.searchsorted(get(folder, f"signal-{q}-keys"), signals[at])
        low, high, want = np.array(ends[s]), np.array(ends[s + 1]) - 1, keys[row[at]]
        while (low < high).any():
            mid = (low + high) >> 1
            less = members[mid] < want
            low, high = np.where(less & (low < high), mid + 1, low), np.where(less, high, mid)
        place[at], after[at] = low, ends[s + 1] - low - 1
    twice, total, a = [], np.append(0, np.cumsum(after))[start], 0
    while a < len(keys):
        b = max(a + 1, int(np.searchsorted(total, total[a] + BLOCK, "right")) - 1)
        rows = slice(start[a], start[b])
        made = [np.zeros((2, 0), np.int64)]
        for q, at in _by_part(signals[rows], parts):
            n = after[rows][at]
            made.append(np.stack([np.repeat(row[rows][at], n), get(folder, f"signal-{q}-values")[_spread(place[rows][at] + 1, n)]]))
        pairs = np.concatenate(made, axis=1)
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        twice.append(pairs[:, 1:][:, (pairs[:, 1:] == pairs[:, :-1]).all(axis=0)])
        a = b
    found = np.concatenate([np.zeros((2, 0), np.int64), *twice], axis=1)
    for name, data in (("place", place), ("twice", found[0]), ("again", found[1])):
        put(folder, f"coni-{p}-{name}", data)


def _after(folder: str, r: int, parts: int, p: int) -> None:
    """For each entry of part ``p``'s signals, two sums of hashes of the colours that follow it."""
    start, nodes = get(folder, f"signal-{p}-start"), get(folder, f"signal-{p}-values")
    color, last = _colors(folder, r, parts, nodes), np.repeat(start[1:], np.diff(start))
    for salt in (1, 2):
        sums = np.append(np.uint64(0), np.cumsum(_mixed(color, salt), dtype=np.uint64))
        put(folder, f"after{r}-{p}-{salt}", (sums[last] - sums[1:]).view(np.int64))


def _bags(folder: str, r: int, parts: int, p: int) -> Iterator[pa.RecordBatch]:
    """(node, color, h1, h2) of part ``p``: its colour and two sums of hashes of its successors' colours, each successor once."""
    keys, start, signals, place, twice, again = (get(folder, f"coni-{p}-{x}") for x in ("keys", "start", "values", "place", "twice", "again"))
    if not len(keys):
        return
    color, out = _colors(folder, r, parts, np.asarray(again)), {"node": keys, "color": get(folder, f"color{r}-{p}")}
    for salt in (1, 2):
        h = np.empty(len(signals), np.int64)
        for q, at in _by_part(signals, parts):
            h[at] = get(folder, f"after{r}-{q}-{salt}")[place[at]]
        sums = np.append(np.uint64(0), np.cumsum(h.view(np.uint64), dtype=np.uint64))
        less = np.append(np.uint64(0), np.cumsum(_mixed(color, salt), dtype=np.uint64))
        ends = np.searchsorted(twice, np.arange(len(keys) + 1))
        out[f"h{salt}"] = (sums[start[1:]] - sums[start[:-1]] - (less[ends[1:]] - less[ends[:-1]])).view(np.int64)
    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()})


def _written(folder: str, r: int, parts: int) -> Callable[[pa.Table], pa.Table]:
    """Writes the colours of a part in order of its constraints."""

    def write(table: pa.Table) -> pa.Table:
        node, color = (table.column(c).to_numpy() for c in ("node", "color"))
        put(folder, f"color{r}-{int(node[0] % parts)}", color[np.argsort(node)])
        return pa.table({"x": pa.array([0], pa.int64())})

    return write


def successor_colors(inc: DataFrame, most: int = 1000) -> DataFrame:
    """(node, color): as ``refine.refined_nodes`` over the arcs src < dst of ``shared_signals``, all nodes alike at first.

    A round adds up hashes from a signal's greatest constraint downwards; successors by several signals are found once and
    taken off, so that each counts once."""
    inc = cut(inc.select("coni", "signal").dropna())
    spark, (folder, parts) = inc.sparkSession, laid_out(inc)
    each = partial(_each, spark, parts)
    done = pa.RecordBatch.from_pydict({"x": pa.array([0], pa.int64())})

    def begin(p):
        _placed(folder, parts, p)
        put(folder, f"color0-{p}", np.zeros(len(get(folder, f"coni-{p}-keys")), np.int64))
        yield done

    each(begin).count()
    seen, r = 1, 0
    while r < most:

        def follow(p, r=r):
            _after(folder, r, parts, p)
            yield done

        each(follow).count()
        bags = cut(each(lambda p, r=r: _bags(folder, r, parts, p), "node long, color long, h1 long, h2 long"))
        low = cut(bags.groupBy("color", "h1", "h2").agg(F.min("node").alias("least")))
        now = low.count()
        named = bags.join(low, ["color", "h1", "h2"]).select("node", F.col("least").alias("color"))
        named.groupBy(F.pmod(F.col("node"), F.lit(parts))).applyInArrow(_written(folder, r + 1, parts), "x long").count()
        drop(bags, low)
        _removed(spark, folder, f"{{color,after}}{r}-*")
        r += 1
        if now == seen:
            break
        seen = now

    def result(p):
        keys = get(folder, f"coni-{p}-keys")
        yield pa.RecordBatch.from_pydict({"node": pa.array(keys, pa.int64()), "color": pa.array(get(folder, f"color{r}-{p}") if len(keys) else [], pa.int64())})

    out = cut(each(result, "node long, color long"))
    _removed(spark, folder, "")
    return out


def _removed(spark, folder: str, names: str) -> None:
    """Deletes the folder's files of these names, or the folder."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    at = hadoop.Path(f"{folder}/{names}" if names else folder)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for x in store.globStatus(at) or []:
        store.delete(x.getPath(), True)
