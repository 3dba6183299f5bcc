"""Fixpoints over graphs of constraints and signals.

Graphs are edge tables (src, dst) or the bipartite incidence (coni, signal), which stands for the clique of each
signal's constraints without its quadratic number of edges. Loops run on the driver; rows stay in Spark, and every
round is checkpointed. Labels are least members, so results do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.fixpoint import cut, drop, iterate, state_of


def _star(links: DataFrame, large: bool) -> DataFrame:
    """large: every node ties its larger neighbours to its least; else its smaller ones, and itself, to the least."""
    if large:
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    ends = both.join(low, "a")
    if large:
        out = ends.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = ends.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node of ``links``: the least node that links reach, by alternating large and small stars."""
    start = links.select(F.col(a).alias("a"), F.col(b).alias("b"))
    alone = start.where("a = b").select(F.col("a").alias("node"), F.col("b").alias("component")).distinct()
    stars = iterate(start.where("a <> b").distinct(), lambda s: _star(_star(s, True), False), lambda s: state_of(s, "a", "b"))
    found = stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    found = found.union(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
    return found.union(alone.join(found.select("node"), "node", "left_anti"))


def constraint_components(inc: DataFrame) -> DataFrame:
    """(coni, component): constraints that share signals, over any number of steps; named by the least constraint.

    A constraint ties its signals to its least one and stands in the component of that, so stars run over signals alone.
    """
    inc = inc.select("coni", "signal").dropna()
    low = cut(inc.groupBy("coni").agg(F.min("signal").alias("low"), F.max("signal").alias("high")))
    ties = inc.join(low.where("low < high"), "coni").where("signal > low").select("low", "signal").distinct()
    return _tied(low, ties)


def set_components(sets: DataFrame) -> DataFrame:
    """(coni, component) as ``constraint_components`` has it, from a written table (coni, signals), a row for each constraint."""
    low = sets.select("coni", F.array_min("signals").alias("low"), "signals")
    ties = cut(low.select("low", F.explode("signals").alias("signal")).where("signal > low").distinct())
    found = cut(_tied(low.select("coni", "low"), ties))
    drop(ties)
    return found


def _tied(low: DataFrame, ties: DataFrame) -> DataFrame:
    """(coni, component) of constraints (coni, low) whose signals ``ties`` (low, signal) link."""
    found = components(ties, "low", "signal").select(F.col("node").alias("low"), "component")
    own = cut(low.join(found, "low", "left").select("coni", F.coalesce("component", "low").alias("component")))
    least = own.groupBy("component").agg(F.min("coni").alias("least"))
    return own.join(least, "component").select("coni", F.col("least").alias("component"))


def _walked(edges: DataFrame, start: DataFrame, keys: list[str], most: int = 10_000) -> DataFrame:
    """(node, keys, d): steps along distinct (src, dst) from the nearest row of ``start`` (node, keys) with the same keys."""
    edges, keys = cut(edges), ["node", *keys]
    found = cut(start.select(*keys, F.lit(0).cast("long").alias("d")).distinct())
    front, d = found, 0
    while d < most:
        d += 1
        ahead = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node"), *keys[1:]).distinct()
        last, front = front, cut(ahead.join(found.select(*keys), keys, "left_anti").withColumn("d", F.lit(d).cast("long")))
        if last is not found:
            drop(last)
        if front.isEmpty():
            break
        before, found = found, cut(found.union(front))
        drop(before)
    drop(edges)
    return found


def distances(edges: DataFrame, sources: DataFrame, most: int = 10_000) -> DataFrame:
    """(node, d): steps along (src, dst) from the nearest of ``sources`` (node); unreachable nodes are absent."""
    return _walked(edges.select("src", "dst").distinct(), sources, [], most)


def signal_distances(inc: DataFrame, sources: DataFrame) -> DataFrame:
    """(signal, d): constraints to pass from the nearest of ``sources`` (signal)."""
    con, sig = (F.col("coni") * 2), (F.col("signal") * 2 + 1)
    edges = inc.select(con.alias("src"), sig.alias("dst")).union(inc.select(sig.alias("src"), con.alias("dst")))
    found = distances(edges, sources.select((F.col("signal") * 2 + 1).alias("node")))
    return found.where("node % 2 = 1").select(F.shiftright("node", 1).alias("signal"), F.shiftright("d", 1).alias("d"))


def upward(inc: DataFrame, sources: DataFrame, down: bool = False) -> DataFrame:
    """(node): constraints that ways over shared signals, from lesser to greater constraints, reach from ``sources`` (node), these included;
    ``down``: from greater to lesser ones.

    A signal's least constraint that was reached reaches all above it, so a round joins the incidence once and makes no pairs.
    """
    turn = -1 if down else 1
    inc = cut(inc.select((F.col("coni") * turn).alias("node"), "signal"))
    found = front = cut(sources.select((F.col("node") * turn).alias("node")).distinct())
    while True:
        low = inc.join(front, "node", "left_semi").groupBy("signal").agg(F.min("node").alias("low"))
        ahead = inc.join(low, "signal").where("node > low").select("node").distinct()
        last, front = front, cut(ahead.join(found, "node", "left_anti"))
        if last is not found:
            drop(last)
        if front.isEmpty():
            break
        before, found = found, cut(found.union(front))
        drop(before)
    drop(inc)
    return found.select((F.col("node") * turn).alias("node"))


def between(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes on some path from a source to a target, both ends included."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return distances(edges, sources).select("node").intersect(distances(back, targets).select("node"))


def shortest_between(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes on the shortest of all paths from a source to a target."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    ahead, behind = distances(edges, sources), distances(back, targets).withColumnRenamed("d", "e")
    both = cut(ahead.join(behind, "node").select("node", (F.col("d") + F.col("e")).alias("t")))
    return both.join(F.broadcast(both.agg(F.min("t").alias("t"))), "t").select("node")


def lightest(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, d): the least sum of weights (src, dst, weight >= 0) from a source, the weight of a step being that of its target."""
    edges = cut(edges)
    start = sources.select("node", F.lit(0).cast("long").alias("d"))

    def step(found: DataFrame) -> DataFrame:
        ahead = found.join(edges, found["node"] == edges["src"]).select(F.col("dst").alias("node"), (F.col("d") + F.col("weight")).alias("d"))
        return found.union(ahead).groupBy("node").agg(F.min("d").alias("d"))

    return iterate(start, step, lambda s: s.agg(F.count("*"), F.sum("d")).first())


def nonlinear_cores(inc: DataFrame, nonlinear: DataFrame) -> DataFrame:
    """(coni, core): non-linear constraints that share signals."""
    return constraint_components(inc.join(nonlinear.select("coni"), "coni", "left_semi")).withColumnRenamed("component", "core")


def linear_bridges(inc: DataFrame, nonlinear: DataFrame) -> DataFrame:
    """(coni, component): linear components that touch two cores or more."""
    cores = cut(nonlinear_cores(inc, nonlinear))
    linear = inc.join(nonlinear.select("coni"), "coni", "left_anti")
    parts = cut(constraint_components(linear))
    core_signal = inc.join(cores, "coni").select("signal", "core").distinct()
    touched = linear.join(parts, "coni").join(core_signal, "signal").groupBy("component").agg(F.countDistinct("core").alias("n"))
    return parts.join(touched.where("n > 1").select("component"), "component", "left_semi").select("coni", "component")


def grown(arcs: DataFrame, start: DataFrame, steps: int) -> DataFrame:
    """(root, node): what a root reaches over ``steps`` arcs (src, dst) at most, itself included."""
    found = front = cut(start.select(F.col("node").alias("root"), "node"))
    for _ in range(steps):
        ahead = front.join(arcs, front["node"] == arcs["src"]).select("root", F.col("dst").alias("node")).distinct()
        front = cut(ahead.join(found, ["root", "node"], "left_anti"))
        if front.isEmpty():
            break
        found = cut(found.union(front))
    return found


def connected_to(inc: DataFrame, wanted: DataFrame) -> DataFrame:
    """Constraints in components that hold a signal of ``wanted`` (signal)."""
    parts = cut(constraint_components(inc))
    good = inc.join(wanted.select("signal"), "signal", "left_semi").join(parts, "coni").select("component").distinct()
    return parts.join(good, "component", "left_semi").select("coni")


def component_plan(inc: DataFrame, wanted: DataFrame, least: int = 100) -> DataFrame:
    """(component, size, plan): ``drop`` without a wanted signal, ``whole`` up to ``least`` constraints, else ``cluster``."""
    parts = cut(constraint_components(inc))
    size = parts.groupBy("component").agg(F.count("*").alias("size"))
    good = inc.join(wanted.select("signal"), "signal", "left_semi").join(parts, "coni").select("component", F.lit(True).alias("good")).distinct()
    plan = F.when(F.col("good").isNull(), "drop").when(F.col("size") <= least, "whole").otherwise("cluster")
    return size.join(good, "component", "left").select("component", "size", plan.alias("plan"))


# --- clusters -----------------------------------------------------------------------------------------------


def attracted(inc: DataFrame, nonlinear: DataFrame, first_ring: bool = False) -> DataFrame:
    """(coni, cluster): cores of non-linear constraints that draw in linear ones next to exactly one cluster, all at once, round by round.

    first_ring: each non-linear constraint is joined to all that share a signal with it first; linear ones beside different
    cores do not join these by a signal that no non-linear constraint holds.
    """
    seeds = inc.join(nonlinear.select("coni"), "coni", "left_semi")
    if first_ring:
        seeds = inc.join(seeds.select("signal").distinct(), "signal", "left_semi")
    start = constraint_components(seeds).withColumnRenamed("component", "cluster")

    def step(state: DataFrame) -> DataFrame:
        held = inc.join(state, "coni").select("signal", "cluster").distinct()
        free = inc.join(state.select("coni"), "coni", "left_anti")
        near = free.join(held, "signal").groupBy("coni").agg(F.min("cluster").alias("cluster"), F.max("cluster").alias("other"))
        return state.union(near.where("cluster = other").select("coni", "cluster"))

    return iterate(start, step, lambda s: s.count())


def completed(inc: DataFrame, partial: DataFrame, group: bool = False) -> DataFrame:
    """(coni, cluster): the clusters given, and what is left as single constraints or, if ``group``, as components."""
    rest = inc.join(partial.select("coni"), "coni", "left_anti")
    alone = constraint_components(rest).withColumnRenamed("component", "cluster") if group else rest.select("coni", F.col("coni").alias("cluster")).distinct()
    return partial.select("coni", "cluster").unionByName(alone)


def without_signals(inc: DataFrame, ignored: DataFrame) -> DataFrame:
    """(coni, cluster): components once signals are left out; a constraint without others is its own."""
    kept = inc.join(ignored.select("signal"), "signal", "left_anti")
    return completed(inc, constraint_components(kept).withColumnRenamed("component", "cluster"))


def without_constraints(inc: DataFrame, ignored: DataFrame) -> DataFrame:
    """(signal, cluster): components of signals once constraints are left out; named by the least signal."""
    kept = inc.join(ignored.select("coni"), "coni", "left_anti").select(F.col("coni").alias("signal"), F.col("signal").alias("coni"))
    found = constraint_components(kept).select(F.col("coni").alias("signal"), F.col("component").alias("cluster"))
    rest = inc.select("signal").distinct().join(found.select("signal"), "signal", "left_anti")
    return found.unionByName(rest.withColumn("cluster", F.col("signal")))


def inner_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Edges with both ends in one part."""
    s, d = parts.select(F.col("coni").alias("src"), F.col("cluster").alias("p")), parts.select(F.col("coni").alias("dst"), F.col("cluster").alias("q"))
    return edges.join(s, "src").join(d, "dst").where("p = q").select(*edges.columns)


def modularity(edges: DataFrame, parts: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of a weighted graph (src < dst, weight) and a partition."""
    both = edges.select("src", "weight").union(edges.select(F.col("dst").alias("src"), "weight"))
    degree = both.groupBy("src").agg(F.sum("weight").alias("k")).join(parts.select(F.col("coni").alias("src"), "cluster"), "src")
    total = degree.groupBy("cluster").agg(F.sum("k").alias("tot"))
    inside = inner_edges(edges, parts).join(parts.select(F.col("coni").alias("src"), "cluster"), "src").groupBy("cluster").agg(F.sum("weight").alias("ins"))
    m = F.sum("tot") / 2
    sums = total.join(inside, "cluster", "left").select("tot", F.coalesce("ins", F.lit(0)).alias("ins"))
    return sums.agg((F.sum("ins") / m - F.lit(resolution) * F.sum(F.col("tot").cast("double") * F.col("tot")) / (m * m * 4)).alias("modularity"))


def propagated_labels(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(node, label): each node takes the heaviest label around it, itself counting 1, ties to the least; all at once, ``rounds`` times at most."""
    both = cut(edges.select("src", "dst", "weight").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")))
    start = both.select(F.col("src").alias("node"), F.col("src").alias("label")).distinct()

    def step(state: DataFrame) -> DataFrame:
        votes = both.join(state, both["dst"] == state["node"]).select(F.col("src").alias("node"), "label", "weight").union(state.select("node", "label", F.lit(1).cast("long")))
        sums = votes.groupBy("node", "label").agg(F.sum("weight").alias("w"))
        return sums.groupBy("node").agg(F.min_by("label", F.struct(-F.col("w"), "label")).alias("label"))

    return iterate(start, step, lambda s: state_of(s, "node", "label"), rounds)


def louvain(edges: DataFrame, resolution: float = 1.0, rounds: int = 1000, levels: int = 1000) -> DataFrame:
    """(node, cluster): communities of a weighted graph (src < dst, weight) by greedy moves of modularity, level by level.

    Within a level nodes move to the neighbouring community of the greatest gain, ties to the least; only nodes of
    one share, by a hash that changes from round to round, move at once: a half at first, less every eighth round, so that
    two do not swap for ever. A level ends when no node gains by a move, the whole when a level moves none; ``rounds`` and
    ``levels`` are guards that raise. A level's communities, named by their least node, are the next one's nodes. Deterministic.
    """
    own = edges.select("src").union(edges.select("dst")).distinct().select(F.col("src").alias("node"), F.col("src").alias("cluster"))
    result = cut(own)
    both = cut(edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").cast("double"))))
    m2 = both.agg(F.sum("weight")).first()[0] or 1.0
    for level in range(levels):
        k = cut(both.groupBy("src").agg(F.sum("weight").alias("k")))
        state = cut(k.select(F.col("src").alias("node"), F.col("src").alias("c"), "k"))
        moved_any = False
        for r in range(rounds):
            tot = state.groupBy("c").agg(F.sum("k").alias("tot"))
            links = both.where("src <> dst").join(state.select(F.col("node").alias("dst"), "c"), "dst").groupBy(F.col("src").alias("node"), "c").agg(F.sum("weight").alias("w"))
            mine = state.select("node", F.col("c").alias("own"), "k")
            options = links.join(mine, "node").join(tot, "c")
            gain = F.col("w") - F.lit(resolution) * F.col("k") * (F.col("tot") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)) / m2
            scored = options.select("node", "own", "k", "c", F.round(gain, 9).alias("g"))
            stay = mine.join(scored.where("c = own").select("node", F.col("g").alias("now")), "node", "left").join(tot.withColumnRenamed("c", "own"), "own")
            now = F.coalesce("now", F.round(-F.lit(resolution) * F.col("k") * (F.col("tot") - F.col("k")) / m2, 9))
            best = scored.where("c <> own").groupBy("node").agg(F.min_by(F.struct("c", "g"), F.struct(-F.col("g"), "c")).alias("b"))
            turn = F.pmod(F.xxhash64(F.lit(level * 1000 + r), "node"), F.lit(2 + r // 8)) == 0
            gains = F.col("b").isNotNull() & (F.col("b.g") > now + 1e-9)
            new = F.when(turn & gains, F.col("b.c")).otherwise(F.col("own"))
            after = cut(stay.join(best, "node", "left").select("node", new.alias("c"), "k", (new != F.col("own")).alias("m"), F.coalesce(gains, F.lit(False)).alias("g")))
            moved, wanted = after.agg(F.count_if("m"), F.count_if("g")).first()
            state = after.drop("m", "g")
            moved_any |= moved > 0
            if not wanted:
                break
        else:
            raise RuntimeError(f"nodes still gain by moves after {rounds} rounds")
        if not moved_any:
            return result
        names = state.groupBy("c").agg(F.min("node").alias("name"))
        map_ = cut(state.join(names, "c").select("node", "name"))
        result = cut(result.join(map_.select(F.col("node").alias("cluster"), "name"), "cluster").select("node", F.col("name").alias("cluster")))
        a, b = map_.select(F.col("node").alias("src"), F.col("name").alias("s")), map_.select(F.col("node").alias("dst"), F.col("name").alias("d"))
        both = cut(both.join(a, "src").join(b, "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum("weight").alias("weight")))
    raise RuntimeError(f"communities still merge after {levels} levels")


# --- acyclic graph of parts ---------------------------------------------------------------------------------


def order_of_parts(inc: DataFrame, parts: DataFrame, inputs: DataFrame, outputs: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((coni, part_id), (signal, part_id, i, o)): a partition merged until it has a strict order, and each part's signals and key.

    A part's key is its distance from parts with inputs and from parts with outputs; unreachable counts as farthest, and equals itself.
    Adjacent parts with equal keys merge. Distances run over parts and signals in turn, from inputs and outputs at once, and of the parts of
    a signal with equal keys each is tied to the least, so pairs of parts are not made. ``held``: the distinct (signal, part_id) of the
    partition, where they are at hand; later ones follow from those before, not from the incidence.
    """
    far = 1 << 40
    parts = cut(parts.select("coni", "part_id"))
    held = cut((inc.join(parts, "coni") if held is None else held).select("signal", "part_id").distinct())
    roles = inputs.select("signal", F.lit("i").alias("role")).union(outputs.select("signal", F.lit("o").alias("role"))).distinct()
    while True:
        part, signal = F.col("part_id") * 2, F.col("signal") * 2 + 1
        steps = held.select(part.alias("src"), signal.alias("dst")).union(held.select(signal.alias("src"), part.alias("dst")))
        found = _walked(steps, held.join(roles, "signal").select(part.alias("node"), "role"), ["role"])
        d = lambda role: F.min(F.when(F.col("role") == role, F.shiftright("d", 1))).alias(role)
        keys = found.where("node % 2 = 0").groupBy(F.shiftright("node", 1).alias("part_id")).agg(d("i"), d("o"))
        keyed = cut(held.join(keys, "part_id", "left").fillna(far, ["i", "o"]).select("signal", "part_id", "i", "o"))
        drop(held, found)
        least = keyed.groupBy("signal", "i", "o").agg(F.min("part_id").alias("src"), F.max("part_id").alias("top")).where("src < top").drop("top")
        same = cut(keyed.join(least, ["signal", "i", "o"]).where("part_id > src").select("src", F.col("part_id").alias("dst")).distinct())
        if same.isEmpty():
            return parts, keyed
        merged = cut(components(same, "src", "dst").withColumnRenamed("node", "part_id"))
        renamed = lambda df, c: df.join(merged, "part_id", "left").select(c, F.coalesce("component", "part_id").alias("part_id"))  # noqa: B023, E731
        before, parts, held = parts, cut(renamed(parts, "coni")), cut(renamed(keyed, "signal").distinct())
        drop(before, same, keyed, merged)


def arcs_of(keyed: DataFrame) -> DataFrame:
    """(src, dst): arcs between parts (signal, part_id, i, o) that share a signal, away from inputs, or where that is equal, towards outputs."""
    a = keyed.select("signal", F.col("part_id").alias("src"), F.col("i").alias("si"), F.col("o").alias("so"))
    b = keyed.select("signal", F.col("part_id").alias("dst"), F.col("i").alias("di"), F.col("o").alias("do"))
    return a.join(b, "signal").where("si < di or si = di and so > do").select("src", "dst").distinct()


def layered(inc: DataFrame, parts: DataFrame, inputs: DataFrame, outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((coni, part_id), (src, dst)): a partition merged until it has a strict order, and its arcs."""
    parts, keyed = order_of_parts(inc, parts, inputs, outputs)
    return parts, arcs_of(keyed)


def node_table(keyed: DataFrame, inputs: DataFrame, outputs: DataFrame) -> DataFrame:
    """(node, signal, role): inputs and outputs of each node (signal, part_id, i, o), from arcs and from the whole system's roles.

    Keys of the parts of a signal differ, so an arc leads to each but the first and from each but the last.
    """
    place = F.struct("i", -F.col("o"))
    ends = keyed.groupBy("signal").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    both = F.array(F.when(place > F.col("first"), "in"), F.when(place < F.col("last"), "out"))
    on = keyed.join(ends, "signal").select(F.col("part_id").alias("node"), "signal", F.explode(both).alias("role")).where("role is not null")
    mine = lambda roles, name: keyed.join(roles.select("signal"), "signal", "left_semi").select(F.col("part_id").alias("node"), "signal", F.lit(name).alias("role"))
    return on.unionByName(mine(inputs, "in")).unionByName(mine(outputs, "out")).distinct()


def passthrough(nodes: DataFrame) -> DataFrame:
    """Nodes with a signal that is both input and output."""
    return nodes.groupBy("node", "signal").agg(F.countDistinct("role").alias("n")).where("n > 1").select("node").distinct()
