"""Exact top-k search by inner product with M-trees.

Vectors of a tree, given one more component that makes their norms equal, are nearest to a query where their
inner product with it is largest. An M-tree (Ciaccia et al., 1997) keeps them in pages: each inner entry has a
routing vector, a covering radius and its distance to the routing vector above; each leaf entry has that
distance. Nodes are visited best bound first; by the triangle inequality the stored distances rule out entries
before any product with them is computed. Products are of integers, so bounds alone are rounded, with a margin.

The vectors are split into blocks around routing vectors, with a tree each, written as arrays into the shared folder;
large blocks are split again by a hash of ids. A query goes to its nearest blocks first; the k-th score it finds there is where the
search of the others begins, and a block whose covering radius cannot reach that score is never visited. Routing vectors
come from a bounded sample; every row is indexed and the search is exact whatever they are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import get_array, new_dir, put_array, written

PAGE, FANOUT = 512, 16
#: Vectors of a tree, about; queries that go to a tree together.
BLOCK, QUERIES = 8192, 1024
#: Routing vectors taken from a sample, and trees, of which tasks get one vector each, at most for each length of vectors;
#: beyond that many trees grow.
ROUTES, TREES = 256, 16_384
#: Rounding of bounds, as a share of the largest distance.
_MARGIN = 1e-9
_NO_FLOOR = -(1 << 63)
_ARRAYS = (("ids", np.int64), ("vectors", np.int64), ("toParent", np.float64), ("begin", np.int64), ("end", np.int64), ("leaf", np.int64), ("center", np.int64), ("radius", np.float64), ("nodeParent", np.float64), ("norm", np.float64))


@dataclass
class Tree:
    """Node n is a page: of vectors begin[n]:end[n] if leaf[n], else of nodes begin[n]:end[n]. toParent: of each
    vector to its leaf's routing vector; nodeParent: between a node's routing vector and that of its parent."""

    ids: np.ndarray
    vectors: np.ndarray
    toParent: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    leaf: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    nodeParent: np.ndarray
    norm: np.ndarray


def _split(full: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """``rows`` in groups around routing vectors taken evenly from them, each with the rows nearest to it; a group
    begins with its routing vector. Outliers make poor routing vectors: their groups would be almost empty pages."""
    k = min(FANOUT, -(-len(rows) // PAGE))
    chosen = rows[np.linspace(0, len(rows) - 1, k).astype(np.int64)]
    _, first = np.unique(full[chosen], axis=0, return_index=True)
    chosen = chosen[np.sort(first)]
    near = np.argmin(np.stack([np.linalg.norm(full[rows] - full[c], axis=1) for c in chosen]), axis=0)
    groups = [np.r_[c, rows[(near == i) & (rows != c)]] for i, c in enumerate(chosen)]
    if max(map(len, groups)) == len(rows):  # all alike, or all nearest to one
        return np.array_split(rows, k)
    return groups


def build(ids: np.ndarray, vectors: np.ndarray, norm: float | None = None) -> Tree:
    """A tree of integer vectors, one row each; ``norm``: the squared norm they are lifted to, by default the largest."""
    square = (vectors.astype(np.float64) ** 2).sum(axis=1)
    norm = float(square.max(initial=0)) if norm is None else norm
    full = np.concatenate([vectors.astype(np.float64), np.sqrt(norm - square)[:, None]], axis=1)
    order: list[np.ndarray] = []
    to_parent: list[np.ndarray] = []
    nodes: list[list] = [[0, 0, 0, 0, 0.0, 0.0]]
    todo, placed = [(0, np.arange(len(ids)))], 0
    while todo:
        node, rows = todo.pop()
        center = rows[0] if len(rows) else 0
        d = np.linalg.norm(full[rows] - full[center], axis=1) if len(rows) else np.zeros(0)
        nodes[node][3], nodes[node][4] = int(center), float(d.max(initial=0))
        if len(rows) <= PAGE:
            nodes[node][:3] = placed, placed + len(rows), 1
            placed += len(rows)
            order.append(rows)
            to_parent.append(d)
            continue
        groups = _split(full, rows)
        nodes[node][:3] = len(nodes), len(nodes) + len(groups), 0
        for g in groups:
            todo.append((len(nodes), g))
            nodes.append([0, 0, 0, 0, 0.0, float(np.linalg.norm(full[g[0]] - full[center]))])
    at = np.concatenate(order)
    place = np.empty(len(ids), np.int64)
    place[at] = np.arange(len(ids))
    cols = [np.array([n[i] for n in nodes]) for i in range(6)]
    center = place[cols[3]] if len(ids) else cols[3]
    return Tree(ids[at], vectors[at], np.concatenate(to_parent), *(c.astype(np.int64) for c in cols[:3]), center, cols[4].astype(float), cols[5].astype(float), np.array([norm]))


def quick(tree: Tree) -> Tree:
    """The tree in memory; with vectors as doubles where products of them are whole and exact."""
    parts = {name: np.ascontiguousarray(getattr(tree, name)) for name, _ in _ARRAYS}
    v = parts["vectors"]
    if v.size and float(np.abs(v).max()) ** 2 * v.shape[1] < 2**52:
        parts["vectors"] = v.astype(np.float64)
    return Tree(**parts)


def search(tree: Tree, query_id: int, query: np.ndarray, k: int, seen: list[int] | None = None, least: int | None = None) -> list[tuple[int, int]]:
    """(score, id) of the k best vectors other than the query's own, ties to smaller ids.

    seen: counts of products that were computed, if given. least: vectors of a smaller score need not be found. The query must suit
    the tree's kind of numbers.
    """
    if not len(tree.ids):
        return []
    vectors, to_parent, ids = tree.vectors, tree.toParent, tree.ids
    x = query.astype(vectors.dtype)
    square = float((query.astype(np.float64) ** 2).sum()) + float(tree.norm[0])
    margin = _MARGIN * (1 + 2 * square**0.5)
    found: list[tuple[int, int]] = []  # a heap of (score, -id): the worst of the best first
    start = limit = np.inf if least is None else max(square - 2.0 * least, 0) ** 0.5

    def distance(rows: np.ndarray) -> np.ndarray:
        if seen is not None:
            seen[0] += len(rows)
        return np.sqrt(np.maximum(square - 2.0 * (vectors[rows] @ x), 0))

    nodes = [(0.0, 0, float(distance(tree.center[:1])[0]))]
    while nodes:
        bound, node, here = heapq.heappop(nodes)
        if bound > limit + margin:
            break
        a, b = int(tree.begin[node]), int(tree.end[node])
        if not tree.leaf[node]:
            near = a + (np.abs(here - tree.nodeParent[a:b]) - tree.radius[a:b] <= limit + margin).nonzero()[0]
            d = distance(tree.center[near])
            for child, low, there in zip(near.tolist(), np.maximum(d - tree.radius[near], 0).tolist(), d.tolist(), strict=True):
                if low <= limit + margin:
                    heapq.heappush(nodes, (low, child, there))
            continue
        near = (np.abs(here - to_parent[a:b]) <= limit + margin).nonzero()[0]
        if 2 * len(near) > b - a:
            product, n = vectors[a:b] @ x, b - a
        else:
            product, n = vectors[a + near] @ x, len(near)
        if seen is not None:
            seen[0] += n
        floor = found[0][0] if len(found) == k else least
        hits = (product >= floor).nonzero()[0] if floor is not None else np.arange(n)
        if not len(hits):
            continue
        rows = a + (hits if n == b - a else near[hits])
        for score, i in sorted(zip(product[hits].tolist(), (-ids[rows]).tolist(), strict=True), reverse=True):
            if -i == query_id:
                continue
            if len(found) < k:
                heapq.heappush(found, (score, i))
            elif (score, i) > found[0]:
                heapq.heapreplace(found, (score, i))
            else:
                break
        if len(found) == k:
            limit = min(start, max(square - 2.0 * found[0][0], 0) ** 0.5)
    return sorted(((int(s), -i) for s, i in found), key=lambda y: (-y[0], y[1]))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].astype(np.int64).reshape(-1, dim)


def _builder(folder: str, norms: dict[int, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, rows = None, [], []

        def made() -> pa.RecordBatch:
            tree = build(np.concatenate(ids), np.concatenate(rows), norms[now[0]])
            for name, kind in _ARRAYS:
                put_array(folder, f"{now[0]}-{now[1]}.{name}", getattr(tree, name).astype(kind))
            center = tree.vectors[tree.center[0]].astype(np.int64)
            cols = [pa.array([x], pa.int32()) for x in now] + [pa.array([center], pa.list_(pa.int64())), pa.array([tree.radius[0]], pa.float64())]
            return pa.RecordBatch.from_arrays(cols, ["dim", "block", "center", "radius"])

        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1)
            edge = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for a, b in zip(edge, [*edge[1:], len(keys)], strict=True):
                part = batch.slice(int(a), int(b - a))
                key = tuple(keys[a].tolist())
                if now is not None and key != now:
                    yield made()
                    ids, rows = [], []
                now = key
                ids.append(part.column(2).to_numpy())
                rows.append(_matrix(part.column(3), key[0]))
        if now is not None:
            yield made()

    return run


def _searcher(folder: str, k: int):
    """Rows (dim, block, ids, floors, vectors as bytes), those of a block together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tree, whole = None, None, False
        for batch in batches:
            out: list[tuple] = []
            for dim, block, ids, floors, flat in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if (dim, block) != now:
                    now = dim, block
                    parts = {name: get_array(folder, f"{dim}-{block}.{name}", kind) for name, kind in _ARRAYS}
                    tree = quick(Tree(**(parts | {"vectors": np.asarray(parts["vectors"]).reshape(-1, dim)})))
                    whole = tree.vectors.dtype.kind == "i"
                queries = np.frombuffer(flat, np.int64).reshape(-1, dim)
                if not whole and float(np.abs(queries).max(initial=0)) * float(np.abs(tree.vectors).max()) * dim >= 2**52:
                    tree, whole = Tree(**{**vars(tree), "vectors": tree.vectors.astype(np.int64)}), True
                for query_id, floor, query in zip(np.frombuffer(ids, np.int64).tolist(), np.frombuffer(floors, np.int64).tolist(), queries, strict=True):
                    out += [(query_id, i, s) for s, i in search(tree, query_id, query, k, least=None if floor == _NO_FLOOR else floor)]
            table = np.array(out, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(table[:, i].copy()) for i in range(3)], ["query_id", "vec_id", "score"])

    return run


def _router(routes: dict[int, np.ndarray]):
    """Appends to (dim, id, v) the number of the nearest of the routing vectors of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, route = batch.column(0).to_numpy(zero_copy_only=False), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                rows, centers = _matrix(batch.column(2).take(pa.array(own)), dim).astype(np.float64), routes[dim]
                route[own] = np.argmin((centers**2).sum(axis=1) - 2.0 * rows @ centers.T, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(route)], ["dim", "id", "v", "route"])

    return run


def _asker(trees: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float]], first: bool, k: int):
    """From rows (dim, id, v, floor): for each block to be visited the queries that go there, packed. ``first``: only each
    query's nearest block; else all others that a vector of score ``floor`` or more may be in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                blocks, centers, radius, norm = trees[dim]
                part = batch.filter(pa.array(dims == dim))
                ids, floors = (part.column(i).to_numpy() for i in (1, 3))
                rows = _matrix(part.column(2), dim)
                for at in range(0, len(rows), QUERIES):
                    x, f = rows[at : at + QUERIES], floors[at : at + QUERIES]
                    square = (x.astype(np.float64) ** 2).sum(axis=1) + norm
                    low = np.sqrt(np.maximum(square[:, None] - 2.0 * x.astype(np.float64) @ centers.T, 0)) - radius
                    nearest = np.argmin(low, axis=1)
                    goes = np.zeros(low.shape, bool)
                    if first:
                        goes[np.arange(len(x)), nearest] = True
                    else:
                        reach = np.where(f == _NO_FLOOR, np.inf, np.sqrt(np.maximum(square - 2.0 * np.where(f == _NO_FLOOR, 0, f), 0)))
                        goes = low <= (reach + _MARGIN * (1 + 2 * np.sqrt(square)))[:, None]
                        goes[np.arange(len(x)), nearest] = False
                    out = [(dim, int(blocks[j]), ids[at : at + QUERIES][g].tobytes(), f[g].tobytes(), x[g].tobytes()) for j in np.flatnonzero(goes.any(axis=0)) for g in [goes[:, j]]]
                    if out:
                        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["dim", "block", "ids", "floors", "flat"])

    return run


def top_products(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products of each query with other rows.

    Queries are the rows whose key is divisible by ``every``; components count as floor(scale * x). Vectors that are null or
    hold a null or non-finite component, and rows with a null key, take no part; a query meets the vectors of its
    own length. Rows with the query's key are its own; of several
    such rows the smallest asks. Repeated rows are rows of their own. Empty vectors take no
    part. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    x = F.col(vector)
    good = F.col(key).isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = written(vectors.where(good).select(F.size(x).alias("dim"), F.col(key).cast("long").alias("id"), whole.alias("v")), "mtree-vectors")
    sizes = {r["dim"]: (r["n"], float(r["norm"])) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("norm")).collect()}
    folder = new_dir(spark, "mtree-pages")
    routes, share = {}, {dim: max(BLOCK, -(-n // TREES)) for dim, (n, _) in sizes.items()}
    for dim, (n, _) in sizes.items():
        some = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").limit(min(ROUTES, -(-n // share[dim]))).select("v").collect()
        routes[dim] = np.unique(np.array([r["v"] for r in some], np.float64), axis=0)
    n_blocks = sum(-(-n // share[dim]) for dim, (n, _) in sizes.items()) or 1
    routed = written(rows.mapInArrow(_router(routes), "dim int, id long, v array<long>, route int"), "mtree-routed")
    # a block is a route's rows, or where they are many a share of them by a hash of the id
    load = routed.groupBy("dim", "route").agg(F.count("*").alias("n"))
    per = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("dim")] if share else F.lit(1)
    load = load.withColumn("shares", F.ceil(F.col("n") / per).cast("int")).drop("n")
    first = F.sum("shares").over(Window.partitionBy("dim").orderBy("route").rowsBetween(Window.unboundedPreceding, -1))
    load = load.withColumn("first", F.coalesce(first, F.lit(0)).cast("int"))
    blocks = routed.join(F.broadcast(load), ["dim", "route"]).select("dim", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("shares"))).cast("int").alias("block"), "id", "v")
    blocks = blocks.repartition(n_blocks, "dim", "block").sortWithinPartitions("dim", "block")
    made = written(blocks.mapInArrow(_builder(folder, {dim: norm for dim, (_, norm) in sizes.items()}), "dim int, block int, center array<long>, radius double"), "mtree-trees").collect()
    trees = {}
    for dim, (_, norm) in sizes.items():
        own = [r for r in made if r["dim"] == dim]
        trees[dim] = np.array([r["block"] for r in own]), np.array([r["center"] for r in own], np.float64), np.array([r["radius"] for r in own]), norm
    queries = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("q")).select("q.dim", "id", "q.v")
    queries = written(queries.withColumn("floor", F.lit(_NO_FLOOR)), "mtree-queries")
    # partitions are named, so that small rows are not merged into one task
    visit = lambda asked, first: asked.select("dim", "id", "v", "floor").mapInArrow(_asker(trees, first, k), "dim int, block int, ids binary, floors binary, flat binary").repartition(n_blocks, "dim", "block").sortWithinPartitions("dim", "block").mapInArrow(_searcher(folder, k), "query_id long, vec_id long, score long")
    near = written(visit(queries, True), "mtree-near")
    ends = F.sort_array(F.collect_list("score"), False)
    floors = near.groupBy(F.col("query_id").alias("id")).agg(F.get(ends, F.lit(k - 1)).alias("found"))
    asked = queries.drop("floor").join(floors, "id", "left").withColumn("floor", F.coalesce("found", F.lit(_NO_FLOOR)))
    best = near.union(visit(asked, False))
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.select("query_id", order.alias("rank"), "vec_id", "score").where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id"), "score")
