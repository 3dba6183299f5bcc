"""Communities by greedy moves of modularity over the incidence, without a row for each pair of constraints that share a signal.

Nodes are constraints at first, then communities: an entry (node, signal, n) stands for n constraints of the node that hold the
signal, so the weight between two nodes is the sum over signals of the product of their n, and no level makes pairs. Files lie as in
``votes``, and say besides where each entry's other end stands. Inside a level a community is place * parts + part of a node in it.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut, drop
from . import votes
from .votes import _each, _prime, _removed, _spread, _summed, get, put

#: Moves that one task tries one after the other; of more, half are made at once.
MOST = 200_000
#: Entries up to which one task does all rounds of a level.
ALONE = 500_000
_NONE = np.zeros(0, np.int64)


def _groups(part: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, ends): places in order of their part, and where each part begins among them."""
    order = np.argsort(part.astype(np.uint16) if parts < 1 << 16 else part, kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(part, minlength=parts)))


def _looked_up(folder: str, name: str, parts: int, of: np.ndarray) -> np.ndarray:
    """The value of the files ``name``-part for each community."""
    out = np.empty(len(of), np.int64)
    order, ends = _groups(of % parts, parts)
    place = (of // parts)[order]
    for q in range(parts):
        if ends[q] < ends[q + 1]:
            out[order[ends[q] : ends[q + 1]]] = get(folder, f"{name}-{q}")[place[ends[q] : ends[q + 1]]]
    return out


def _dealt(folder: str, name: str, parts: int, of: np.ndarray, values: np.ndarray) -> None:
    """Writes values by community, those of a part together."""
    order, ends = _groups(of % parts, parts)
    for x, data in (("ends", ends), ("place", (of // parts)[order]), ("value", values[order])):
        put(folder, f"{name}-{x}", data)


def _taken(folder: str, name: str, parts: int, p: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, value) that each part dealt to part ``p``."""
    for q in range(parts):
        ends = get(folder, f"{name}-{q}-ends")
        at = slice(int(ends[p]), int(ends[p + 1]))
        yield np.asarray(get(folder, f"{name}-{q}-place")[at]), np.asarray(get(folder, f"{name}-{q}-value")[at])


def _hash(salt: int, x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int and a long."""
    p1, p2, p3, p4, p5 = (np.uint64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))

    def mixed(h):
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    h = np.array([42], np.uint64) + p5 + np.uint64(4)
    h = mixed(turned(h ^ (np.array([salt], np.uint64) * p1), 23) * p2 + p3)
    h = h + p5 + np.uint64(8)
    return mixed(turned(h ^ (turned(x.astype(np.uint64) * p2, 31) * p1), 27) * p1 + p4).view(np.int64)


def _laid(folder: str, parts: int, p: int) -> None:
    """Once: for the entries of part ``p``, by signals and by nodes, where their other ends stand; the nodes' first communities."""
    for key, other in (("signal", "node"), ("node", "signal")):
        ends_of = get(folder, f"{key}-{p}-values")
        order, ends = _groups(ends_of % parts, parts)
        place = np.empty(len(order), np.int64)
        for q in range(parts):
            at = slice(ends[q], ends[q + 1])
            place[at] = np.searchsorted(get(folder, f"{other}-{q}-keys"), ends_of[order[at]])
        for name, data in (("order", order), ("ends", ends), ("place", place)):
            put(folder, f"{key}-{p}-{name}", data)
    n = len(get(folder, f"node-{p}-keys"))
    put(folder, f"c0-{p}", np.arange(n) * parts + p)
    put(folder, f"tot0-{p}", get(folder, f"node-{p}-k"))
    put(folder, f"name-{p}", get(folder, f"node-{p}-keys"))


def _other_ends(folder: str, key: str, parts: int, p: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, entries of part ``p``, places of their other ends)."""
    order, ends, place = (get(folder, f"{key}-{p}-{x}") for x in ("order", "ends", "place"))
    for q in range(parts):
        if ends[q] < ends[q + 1]:
            yield q, order[ends[q] : ends[q + 1]], place[ends[q] : ends[q + 1]]


def _counted(folder: str, r: int, parts: int, p: int) -> None:
    """The communities of each signal of part ``p`` in round ``r`` and their n; the sums of k of the part's communities."""
    if r:
        tot = np.array(get(folder, f"tot{r - 1}-{p}"))
        for place, value in _taken(folder, f"moved{r - 1}", parts, p):
            np.add.at(tot, place, value)
        put(folder, f"tot{r}-{p}", tot)
    start = get(folder, f"signal-{p}-start")
    c, went = np.empty(int(start[-1]), np.int64), np.zeros(int(start[-1]))
    for q, at, place in _other_ends(folder, "signal", parts, p):
        c[at] = get(folder, f"c{r}-{q}")[place]
        if r:
            went[at] = c[at] != get(folder, f"c{r - 1}-{q}")[place]
    row = np.repeat(np.arange(len(start) - 1), np.diff(start))
    put(folder, f"count{r}-{p}-near", np.bincount(row, went, len(start) - 1) > 0)
    row, c, n = _summed(row, c, np.asarray(get(folder, f"signal-{p}-n"))) if len(c) else (_NONE, _NONE, _NONE)
    for name, data in (("start", np.searchsorted(row, np.arange(len(start)))), ("c", c), ("n", n)):
        put(folder, f"count{r}-{p}-{name}", data)


def _evaluated(folder: str, level: int, r: int, parts: int, p: int, m2: float, resolution: float, whole: bool) -> np.ndarray:
    """(node, own community, best community, gain x 10^9, k, weights to both) of the nodes of part ``p`` that gain by a move; ``whole``: of all nodes,
    else of those that wanted to move the round before or that share a signal with one that moved."""
    keys, start, entry_n, k = (get(folder, f"node-{p}-{x}") for x in ("keys", "start", "n", "k"))
    own = np.asarray(get(folder, f"c{r}-{p}"))
    part, begin, n, near = (np.zeros(len(entry_n), np.int64) for _ in range(4))
    for q, at, place in _other_ends(folder, "node", parts, p):
        ends = get(folder, f"count{r}-{q}-start")
        part[at], begin[at], n[at], near[at] = q, ends[place], ends[place + 1] - ends[place], get(folder, f"count{r}-{q}-near")[place]
    size = np.diff(start)
    todo = np.arange(len(own))
    if not whole:
        row = np.repeat(todo, size)
        busy = np.bincount(row, near, len(own)) > 0
        busy[get(folder, f"wants{r}-{p}")] = True
        todo = np.flatnonzero(busy)
    rows_of = _spread(start[todo], size[todo])
    part, begin, n, entry_n, size, own, k = part[rows_of], begin[rows_of], n[rows_of], np.asarray(entry_n)[rows_of], size[todo], own[todo], np.asarray(k)[todo]
    start = np.append(0, np.cumsum(size))
    own_tot = _looked_up(folder, f"tot{r}", parts, own)
    total = np.append(0, np.cumsum(n))[start]
    out, a = [np.zeros((7, 0), np.int64)], 0
    while a < len(own):
        b = max(a + 1, int(np.searchsorted(total, total[a] + votes.BLOCK, "right")) - 1)
        rows = slice(int(start[a]), int(start[b]))
        node = np.repeat(np.arange(b - a), size[a:b])
        order, ends = _groups(part[rows], parts)
        made = []
        for q in range(parts):
            if len(at := order[ends[q] : ends[q + 1]]):
                many = n[rows][at]
                place = _spread(begin[rows][at], many)
                made.append((np.repeat(node[at], many), get(folder, f"count{r}-{q}-c")[place], get(folder, f"count{r}-{q}-n")[place] * np.repeat(entry_n[rows][at], many)))
        row, c, w = _summed(*(np.concatenate(x) for x in zip(*made, strict=True)))
        itself = np.bincount(node, entry_n[rows].astype(np.float64) ** 2, b - a)
        gain = lambda at, w, tot: np.round(w - resolution * k[a:b][at] * tot / m2, 9)  # noqa: B023, E731
        mine = c == own[a:b][row]
        here = np.zeros(b - a, np.int64)
        here[row[mine]] = w[mine] - itself[row[mine]].astype(np.int64)
        now = gain(np.arange(b - a), here, own_tot[a:b] - k[a:b])
        row, c, w = row[~mine], c[~mine], w[~mine]
        more = gain(row, w, _looked_up(folder, f"tot{r}", parts, c)) - now[row]
        better = more > 1e-9
        row, c, w, more = row[better], c[better], w[better], more[better]
        if len(row):
            heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            top = more == np.repeat(np.maximum.reduceat(more, heads), np.diff(np.append(heads, len(row))))
            row, c, w, more = row[top], c[top], w[top], more[top]
            order = np.lexsort((_looked_up(folder, "name", parts, c), row))
            row, c, w, more = row[order], c[order], w[order], more[order]
            first = np.append(True, row[1:] != row[:-1])
            row = row[first]
            out.append(np.stack([todo[a:b][row], own[a:b][row], c[first], np.round(more[first] * 1e9).astype(np.int64), k[a:b][row], here[row], w[first]]))
        a = b
    return np.concatenate(out, axis=1)


def _kept(moves: np.ndarray, entries: np.ndarray, tot: dict[int, int], m2: float, resolution: float) -> np.ndarray:
    """Of moves (node, from, to, gain, k, weights to from and to) those that still gain when they are made one after the other, the
    greatest gains first; ``entries``: (move, signal, n) in order of the move. ``tot`` is brought up to date."""
    ends = np.searchsorted(entries[0], np.arange(moves.shape[1] + 1)).tolist()
    signals, ns = entries[1].tolist(), entries[2].tolist()
    gone: dict[tuple[int, int], int] = {}
    _, source, target, _, ks, here, there = moves.tolist()
    kept = []
    for i in np.lexsort((moves[0], -moves[3])).tolist():
        a, b, k, less, more = source[i], target[i], ks[i], here[i], there[i]
        own = range(ends[i], ends[i + 1])
        for e in own:
            less += ns[e] * gone.get((signals[e], a), 0)
            more += ns[e] * gone.get((signals[e], b), 0)
        if round(more - resolution * k * tot[b] / m2, 9) - round(less - resolution * k * (tot[a] - k) / m2, 9) > 1e-9:
            kept.append(i)
            tot[a] -= k
            tot[b] += k
            for e in own:
                for c, n in ((a, -ns[e]), (b, ns[e])):
                    gone[signals[e], c] = gone.get((signals[e], c), 0) + n
    return np.array(kept, np.int64)


def _proposed(folder: str, level: int, r: int, parts: int, p: int, m2: float, resolution: float, whole: bool) -> int:
    """Writes the moves that part ``p`` wants, and the entries of their nodes; how many."""
    moves = _evaluated(folder, level, r, parts, p, m2, resolution, whole)
    start = get(folder, f"node-{p}-start")
    size = start[moves[0] + 1] - start[moves[0]]
    rows = _spread(start[moves[0]], size)
    entries = np.stack([np.repeat(np.arange(len(size)), size), get(folder, f"node-{p}-values")[rows], get(folder, f"node-{p}-n")[rows]])
    put(folder, f"move{r}-{p}", moves)
    put(folder, f"entry{r}-{p}", entries)
    return moves.shape[1]


def _picked(folder: str, r: int, parts: int, m2: float, resolution: float) -> None:
    """Of the moves of all parts, at most ``MOST``, writes the places that are kept in each part."""
    moves, entries, of, n = [], [], [], 0
    for p in range(parts):
        own, e = get(folder, f"move{r}-{p}").reshape(7, -1).copy(), get(folder, f"entry{r}-{p}").reshape(3, -1).copy()
        of.append(np.stack([np.full(own.shape[1], p), np.arange(own.shape[1])]))
        own[0], e[0] = get(folder, f"name-{p}")[own[0]], e[0] + n
        n += own.shape[1]
        moves.append(own)
        entries.append(e)
    moves, of = np.concatenate(moves, axis=1), np.concatenate(of, axis=1)
    touched = np.unique(moves[1:3])
    tot = dict(zip(touched.tolist(), _looked_up(folder, f"tot{r}", parts, touched).tolist(), strict=True))
    of = of[:, _kept(moves, np.concatenate(entries, axis=1), tot, m2, resolution)]
    for p in range(parts):
        put(folder, f"kept{r}-{p}", np.sort(of[1][of[0] == p]))


def _applied(folder: str, level: int, r: int, parts: int, p: int, half: bool) -> int:
    """Writes the communities of part ``p`` after round ``r``; how many nodes moved."""
    moves, own, k = get(folder, f"move{r}-{p}").reshape(7, -1), np.array(get(folder, f"c{r}-{p}")), get(folder, f"node-{p}-k")
    put(folder, f"wants{r + 1}-{p}", moves[0])
    kept = moves[:, _hash(level * 1000 + r, get(folder, f"name-{p}")[moves[0]]) % 2 == 0 if half else get(folder, f"kept{r}-{p}")]
    own[kept[0]] = kept[2]
    put(folder, f"c{r + 1}-{p}", own)
    _dealt(folder, f"moved{r}-{p}", parts, np.append(kept[1], kept[2]), np.append(-k[kept[0]], k[kept[0]]))
    return kept.shape[1]


def _settled(each: Callable, swept: Callable, folder: str, level: int, parts: int, m2: float, resolution: float, rounds: int) -> tuple[int, int]:
    """Rounds of a level until no node gains by a move: (the last round, how many nodes moved in all)."""
    each(lambda p: _laid(folder, parts, p))
    whole, moved = True, 0
    for r in range(rounds):
        each(lambda p, r=r: _counted(folder, r, parts, p))
        n = sum(each(lambda p, r=r, w=whole: _proposed(folder, level, r, parts, p, m2, resolution, w)))
        if not n and whole:
            return r, moved
        if 0 < n <= MOST:
            each(lambda _, r=r: _picked(folder, r, parts, m2, resolution), 1)
        elif not n:
            each(lambda p, r=r: put(folder, f"kept{r}-{p}", _NONE))
        moved += sum(each(lambda p, r=r, h=n > MOST: _applied(folder, level, r, parts, p, h)))
        if r:
            swept(folder, f"{{c,tot,count,move,entry,kept,wants,moved}}{r - 1}-*")
        whole = not n or n > MOST
    raise RuntimeError(f"nodes still gain by moves after {rounds} rounds")


def _named(folder: str, r: int, parts: int, p: int) -> None:
    """The least node of part ``p`` in each community, dealt by community."""
    c, name = get(folder, f"c{r}-{p}"), get(folder, f"name-{p}")
    order = np.lexsort((name, c))
    c = c[order]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else _NONE
    _dealt(folder, f"least-{p}", parts, c[first], name[order][first])


def _least(folder: str, parts: int, p: int) -> None:
    out = np.full(len(get(folder, f"name-{p}")), np.iinfo(np.int64).max)
    for place, value in _taken(folder, "least", parts, p):
        np.minimum.at(out, place, value)
    put(folder, f"new-{p}", out)


def _batch(**columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in columns.items()})


def _stored(entries: DataFrame, key: str, other: str, folder: str, parts: int) -> None:
    """Writes the entries of each part by ``key``, as ``votes`` does, with their n, and the k of nodes."""

    def write(table: pa.Table) -> pa.Table:
        x = {c: table.column(c).to_numpy().astype(np.int64) for c in ("node", "signal", "n", "k")}
        order = np.lexsort((x[other], x[key]))
        keys, start = np.unique(x[key][order], return_index=True)
        p = int(x[key][0] % parts)
        for name, data in (("keys", keys), ("start", np.append(start, len(order))), ("values", x[other][order]), ("n", x["n"][order]), ("k", x["k"][order][start])):
            put(folder, f"{key}-{p}-{name}", data)
        return pa.table({"part": pa.array([p], pa.int64())})

    done = {x[0] for x in entries.groupBy(F.pmod(F.col(key), F.lit(parts))).applyInArrow(write, "part long").collect()}
    for p in set(range(parts)) - done:
        for name in ("keys", "values", "n", "k"):
            put(folder, f"{key}-{p}-{name}", _NONE)
        put(folder, f"{key}-{p}-start", np.zeros(1, np.int64))


def louvain(inc: DataFrame, resolution: float = 1.0, rounds: int = 1000, levels: int = 1000) -> DataFrame:
    """(node, cluster): communities of the constraints of an incidence (coni, signal) that share signals, by greedy moves of
    modularity, level by level; the weight of two constraints is the number of signals they share.

    Within a level a node moves to the neighbouring community of the greatest gain, ties to the least. While over ``MOST`` nodes gain,
    half of them move at once, chosen by a hash; then one after the other in order of their gain, each if it still gains. A round
    looks at nodes that share a signal with one that moved; a level ends when of all nodes none gains by a move, the whole when a
    level moves none. ``rounds`` and ``levels`` are guards that raise. A level's communities, named by their least node, are the next
    one's nodes. Deterministic, whatever the number of parts.
    """
    spark = inc.sparkSession
    pairs = cut(inc.select(F.col("coni").alias("node"), "signal").dropna().distinct())
    held = pairs.groupBy("signal").agg(F.count("*").alias("d")).where("d > 1")
    rows = cut(pairs.join(held, "signal").select("node", "signal", F.lit(1).cast("long").alias("n"), (F.col("d") - 1).alias("k")))
    drop(pairs)
    k = cut(rows.groupBy("node").agg(F.sum("k").alias("k")))
    entries = cut(rows.drop("k"))
    drop(rows)
    m2 = float(k.agg(F.sum("k")).first()[0] or 1)
    result = cut(k.select("node", F.col("node").alias("cluster")))
    base = (spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()).rstrip("/")
    for level in range(levels):
        folder, size = f"{base}/communities-{uuid.uuid4().hex}", entries.count()
        alone = size <= ALONE
        parts = 1 if alone else _prime(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // 500_000))
        full = cut(entries.join(k, "node"))
        for key, other in (("signal", "node"), ("node", "signal")):
            _stored(full, key, other, folder, parts)
        drop(full)

        def each(work, n=parts):
            def run(p):
                yield pa.RecordBatch.from_pydict({"x": pa.array([pickle.dumps(work(p))], pa.binary())})

            return [pickle.loads(x[0]) for x in _each(spark, n, run, "x binary").collect()]

        settled = lambda each, swept: _settled(each, swept, folder, level, parts, m2, resolution, rounds)  # noqa: B023, E731
        if alone:
            done = each(lambda _: _alone(settled), 1)[0]
            if isinstance(done, RuntimeError):
                raise done
            r, moved = done
        else:
            r, moved = settled(each, lambda *x: _removed(spark, *x))
        if not moved:
            _removed(spark, folder, "")
            drop(entries, k)
            return result
        each(lambda p, r=r: _named(folder, r, parts, p))  # noqa: B023
        each(lambda p: _least(folder, parts, p))  # noqa: B023

        def named(p):
            return _batch(old=get(folder, f"name-{p}"), name=_looked_up(folder, "new", parts, get(folder, f"c{r}-{p}")))  # noqa: B023

        def degrees(p):
            tot = get(folder, f"tot{r}-{p}")  # noqa: B023
            at = np.flatnonzero(tot)
            return _batch(node=get(folder, f"new-{p}")[at], k=tot[at])  # noqa: B023

        def counted(p):
            start = get(folder, f"count{r}-{p}-start")  # noqa: B023
            size = np.diff(start)
            several = np.flatnonzero(size > 1)
            rows = _spread(start[several], size[several])
            name = _looked_up(folder, "new", parts, get(folder, f"count{r}-{p}-c")[rows])  # noqa: B023
            return _batch(node=name, signal=np.repeat(get(folder, f"signal-{p}-keys")[several], size[several]), n=get(folder, f"count{r}-{p}-n")[rows])  # noqa: B023

        before = entries, k, result
        names = cut(_each(spark, parts, named, "old long, name long"))
        entries, k = cut(_each(spark, parts, counted, "node long, signal long, n long")), cut(_each(spark, parts, degrees, "node long, k long"))
        result = cut(result.join(names, result["cluster"] == names["old"], "left").select("node", F.coalesce("name", "cluster").alias("cluster")))
        drop(*before, names)
        _removed(spark, folder, "")
    raise RuntimeError(f"communities still merge after {levels} levels")


def _alone(settled: Callable) -> tuple[int, int] | RuntimeError:
    try:
        return settled(lambda work, n=1: [work(p) for p in range(n)], lambda *_: None)
    except RuntimeError as e:
        return e
