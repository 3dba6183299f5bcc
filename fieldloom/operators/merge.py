"""Merging of parts in an acyclic graph of parts, and exact searches on small graphs.

Merges depend on order, so each connected graph of parts is one group, taken in order of part ids.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut
from .graph import components
from .relational import nonlinear


@dataclass
class Part:
    """A part: its signals, those of the whole system's inputs and outputs among them, and its constraints by kind."""

    signals: set[int]
    inputs: set[int]
    outputs: set[int]
    n_linear: int
    n_nonlinear: int
    members: set[int] = field(default_factory=set)


class PartGraph:
    def __init__(self, parts: dict[int, Part], arcs: set[tuple[int, int]]) -> None:
        self.parts = parts
        self.after: dict[int, set[int]] = {p: set() for p in parts}
        self.before: dict[int, set[int]] = {p: set() for p in parts}
        for a, b in arcs:
            self.after[a].add(b)
            self.before[b].add(a)

    def shared(self, part: int, others: set[int]) -> set[int]:
        own = self.parts[part].signals
        return {s for o in others for s in self.parts[o].signals & own}

    def ins(self, part: int) -> set[int]:
        return self.shared(part, self.before[part]) | self.parts[part].inputs

    def outs(self, part: int) -> set[int]:
        return self.shared(part, self.after[part]) | self.parts[part].outputs

    def _reach(self, start: int, step: dict[int, set[int]]) -> set[int]:
        seen, todo = {start}, [start]
        while todo:
            for x in step[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    def closure(self, a: int, b: int) -> set[int]:
        """a and b with every part on a way between them: what must merge so that no circle arises."""
        down, up = (a, b) if b in self._reach(a, self.after) else (b, a)
        return self._reach(down, self.after) & self._reach(up, self.before) | {a, b}

    def merge(self, group: set[int]) -> int:
        """The group as one part, under its least name."""
        name, parts = min(group), [self.parts[p] for p in group]
        after = set().union(*(self.after[p] for p in group)) - group
        before = set().union(*(self.before[p] for p in group)) - group
        for p in group:
            del self.parts[p], self.after[p], self.before[p]
        union = lambda get: set().union(*(get(p) for p in parts))
        self.parts[name] = Part(union(lambda p: p.signals), union(lambda p: p.inputs), union(lambda p: p.outputs), sum(p.n_linear for p in parts), sum(p.n_nonlinear for p in parts), union(lambda p: p.members))
        self.after[name], self.before[name] = after, before
        for x in after:
            self.before[x] = self.before[x] - group | {name}
        for x in before:
            self.after[x] = self.after[x] - group | {name}
        return name


def _passing(g: PartGraph, p: int) -> set[int]:
    return g.ins(p) & g.outs(p)


PROPERTIES: dict[str, Callable[[PartGraph, int], bool]] = {
    "passthrough": lambda g, p: bool(_passing(g, p)),
    "only_nonlinear": lambda g, p: g.parts[p].n_linear == 0,
    "single_linear": lambda g, p: g.parts[p].n_linear == 1 and g.parts[p].n_nonlinear == 0,
    "unsafe_linear": lambda g, p: g.parts[p].n_linear == 1 and g.parts[p].n_nonlinear == 0 and len(g.after[p]) > 1,
}


def attraction(g: PartGraph, kind: str, part: int, near: int, below: bool, favour_down: bool) -> int:
    """How much a neighbour, ``below`` or above a part with the property, draws it; 0: they do not merge.

    passthrough: signals that pass through the part and end at the neighbour. only_nonlinear: whether the neighbour has a linear
    constraint. Single linear parts: signals on the arc between them, and on the favoured side those that come from the other.
    """
    if kind == "passthrough":
        reach, ends = (g.ins(near), g.outs(near)) if below else (g.outs(near), g.ins(near))
        return len(_passing(g, part) & reach - ends)
    if kind == "only_nonlinear":
        return int(g.parts[near].n_linear > 0)
    if below:
        return (len(g.ins(part)) if favour_down else 0) + len(g.outs(part) & g.ins(near))
    return (0 if favour_down else len(g.outs(part))) + len(g.ins(part) & g.outs(near))


def merge_where(graph: PartGraph, kind: str, favour_down: bool = True) -> None:
    """Parts with the property merge one after the other, in order of their names, each with a neighbour that draws it:
    the one whose merge takes the most parts (all on ways between the two go along), of these the one that draws least, then
    parts above before those below, then the least. What has arisen waits at the end of the queue if it has the property, as
    does a part that nothing draws; the end is reached when all that wait are such."""
    has = PROPERTIES[kind]
    todo, idle = deque(sorted(p for p in graph.parts if has(graph, p))), 0
    while len(todo) > idle:
        part = todo.popleft()
        if part not in graph.parts or not has(graph, part):
            continue
        sides = [(n, False) for n in sorted(graph.before[part])] + [(n, True) for n in sorted(graph.after[part])]
        drawn = [(n, k) for n, below in sides if (k := attraction(graph, kind, part, n, below, favour_down)) > 0]
        if not drawn:
            todo.append(part)
            idle += 1
            continue
        groups = {n: graph.closure(part, n) for n, _ in drawn}
        best = max(drawn, key=lambda x: (len(groups[x[0]]), -x[1]))[0]
        name, idle = graph.merge(groups[best]), 0
        if has(graph, name) and name not in todo:
            todo.append(name)


def merged_parts(inc: DataFrame, terms: DataFrame, parts: DataFrame, arcs: DataFrame, inputs: DataFrame, outputs: DataFrame, kind: str, favour_down: bool = True, held: DataFrame | None = None, hard: DataFrame | None = None) -> DataFrame:
    """(coni, part_id): the partition after ``merge_where``; a part takes the least name of those merged into it.

    Parts without an arc have no neighbour to merge with: they keep their names, and their signals are not gathered.
    Where the distinct (signal, part_id) of the partition or the non-linear constraints are at hand, ``held`` and ``hard`` stand for ``inc``
    and ``terms``.
    """
    parts, arcs = cut(parts), cut(arcs.select("src", "dst"))
    group = cut(components(arcs, "src", "dst").withColumnRenamed("node", "part_id"))
    all_, parts = parts, cut(parts.join(group, "part_id", "left_semi").select("coni", "part_id"))
    held = inc.join(parts, "coni").select("part_id", "signal").distinct() if held is None else held.join(group, "part_id", "left_semi").select("part_id", "signal")
    roles = inputs.select("signal", F.lit(True).alias("i")).join(outputs.select("signal", F.lit(True).alias("o")), "signal", "full")
    rows = held.join(roles, "signal", "left").groupBy("part_id").agg(F.collect_set("signal").alias("signals"), F.collect_set(F.when(F.col("i"), F.col("signal"))).alias("ins"), F.collect_set(F.when(F.col("o"), F.col("signal"))).alias("outs"))
    hard = parts.join(nonlinear(terms) if hard is None else hard, "coni", "left_semi").groupBy("part_id").agg(F.count("*").alias("n_nonlinear"))
    size = parts.groupBy("part_id").agg(F.count("*").alias("n"))
    succ = arcs.groupBy(F.col("src").alias("part_id")).agg(F.collect_set("dst").alias("succ"))
    table = size.join(rows, "part_id", "left").join(hard, "part_id", "left").join(succ, "part_id", "left").join(group, "part_id").fillna(0, ["n_nonlinear"])

    def run(df: pd.DataFrame) -> pd.DataFrame:
        of = lambda x: set() if x is None else {int(v) for v in x}
        nodes = {int(r.part_id): Part(of(r.signals), of(r.ins), of(r.outs), int(r.n - r.n_nonlinear), int(r.n_nonlinear), {int(r.part_id)}) for r in df.itertuples()}
        graph = PartGraph(nodes, {(int(r.part_id), b) for r in df.itertuples() for b in of(r.succ)})
        merge_where(graph, kind, favour_down)
        return pd.DataFrame([(m, name) for name, p in graph.parts.items() for m in p.members], columns=["old", "new"])

    renamed = table.groupBy("component").applyInPandas(run, "old long, new long")
    return all_.join(renamed, all_["part_id"] == renamed["old"], "left").select("coni", F.coalesce("new", "part_id").alias("part_id"))


def merged_arcs(parts: DataFrame, merged: DataFrame, arcs: DataFrame) -> DataFrame:
    """Arcs between parts after a merge."""
    names = parts.select("coni", F.col("part_id").alias("old")).join(merged, "coni").select("old", F.col("part_id").alias("new")).distinct()
    s, d = names.select(F.col("old").alias("src"), F.col("new").alias("s")), names.select(F.col("old").alias("dst"), F.col("new").alias("d"))
    return arcs.join(s, "src").join(d, "dst").where("s <> d").select(F.col("s").alias("src"), F.col("d").alias("dst")).distinct()


# --- highly connected subgraphs -----------------------------------------------------------------------------


def least_cut(nodes: set[int], weight: dict[tuple[int, int], int]) -> tuple[int, set[int]]:
    """(number of edges cut, one side) of a least cut of a connected graph, by merging the most tightly bound last pairs."""
    near: dict[int, dict[int, int]] = {n: {} for n in nodes}
    for (a, b), w in weight.items():
        near[a][b] = near[a].get(b, 0) + w
        near[b][a] = near[b].get(a, 0) + w
    inside = {n: {n} for n in nodes}
    best: tuple[int, set[int]] | None = None
    while len(near) > 1:
        start = min(near)
        order, bound = [start], dict(near[start])
        left = set(near) - {start}
        while left:
            nxt = min(left, key=lambda n: (-bound.get(n, 0), n))
            left.discard(nxt)
            order.append(nxt)
            for n, w in near[nxt].items():
                if n in left:
                    bound[n] = bound.get(n, 0) + w
        s, t = order[-2], order[-1]
        cut_size = sum(near[t].values())
        if best is None or cut_size < best[0]:
            best = cut_size, set(inside[t])
        inside[s] |= inside.pop(t)
        for n, w in near.pop(t).items():
            near[n].pop(t)
            if n != s:
                near[s][n] = near[s].get(n, 0) + w
                near[n][s] = near[n].get(s, 0) + w
    return best or (0, set(nodes))


def highly_connected(nodes: set[int], edges: set[tuple[int, int]]) -> list[set[int]]:
    """Subgraphs whose least cut is over half of their nodes, found by cutting again and again; others are single nodes."""
    near: dict[int, set[int]] = {n: set() for n in nodes}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out, todo = [], [nodes]
    while todo:
        now = todo.pop()
        seen, front = {min(now)}, [min(now)]
        while front:
            ahead = near[front.pop()] & now - seen
            seen |= ahead
            front += ahead
        if seen != now:
            todo += [seen, now - seen]
            continue
        own = {(a, b) for a in now for b in near[a] & now if a < b}
        if len(now) < 3:
            out += [{n} for n in now]
            continue
        size, side = least_cut(now, dict.fromkeys(own, 1))
        if 2 * size > len(now):
            out.append(now)
        else:
            todo += [side, now - side]
    return out


def highly_connected_clusters(edges: DataFrame, most: int = 1000) -> DataFrame:
    """(coni, cluster) of a graph (src < dst), one group a connected component.

    Exact cuts take the cube of a component's nodes, in one task: a component of over ``most`` nodes is an error, not left out.
    """
    group = cut(components(edges, "src", "dst"))
    n = group.groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if n > most:
        raise ValueError(f"a component of {n} nodes; exact cuts are made for up to {most}")
    rows = edges.join(group.withColumnRenamed("node", "src"), "src").select("component", "src", "dst")

    def run(df: pd.DataFrame) -> pd.DataFrame:
        pairs = {(int(a), int(b)) for a, b in zip(df["src"], df["dst"], strict=True)}
        found = highly_connected({x for p in pairs for x in p}, pairs)
        return pd.DataFrame([(n, min(c)) for c in found for n in c], columns=["coni", "cluster"])

    return rows.groupBy("component").applyInPandas(run, "coni long, cluster long")
