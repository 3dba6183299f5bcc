import random
from itertools import combinations

from pyspark.sql import functions as F

from fieldloom.operators import graph as G
from fieldloom.operators import merge as M
from fieldloom.operators import relational as R
from fieldloom.plans.fixpoint import cut
from fieldloom.sources import derived as D


def acyclic(graph):
    seen, done = set(), set()

    def visit(n):
        if n in done:
            return True
        if n in seen:
            return False
        seen.add(n)
        ok = all(visit(x) for x in graph.after[n])
        done.add(n)
        return ok

    return all(visit(n) for n in graph.parts)


def test_merges_keep_the_graph_acyclic_and_end_the_property():
    r = random.Random(0)
    for kind in M.PROPERTIES:
        for _ in range(40):
            n = r.randint(2, 9)
            parts = {i: M.Part(set(r.sample(range(12), 4)), set(), set(), r.randint(0, 2), r.randint(0, 1), {i}) for i in range(n)}
            arcs = {(a, b) for a, b in combinations(range(n), 2) if parts[a].signals & parts[b].signals}
            graph = M.PartGraph(parts, arcs)
            M.merge_where(graph, kind)
            assert acyclic(graph)
            assert sorted(m for p in graph.parts.values() for m in p.members) == list(range(n))
            assert all(name == min(p.members) for name, p in graph.parts.items())
            drawn = lambda p: [n for below, side in ((True, graph.after), (False, graph.before)) for n in side[p] if M.attraction(graph, kind, p, n, below, True) > 0]
            assert all(not M.PROPERTIES[kind](graph, p) or not drawn(p) for p in graph.parts)


def test_only_neighbours_that_draw_merge():
    # signal 1 passes through part 1 and on through part 2, nothing takes it in
    through = M.PartGraph({i: M.Part({1, 10 + i}, {1} if i == 1 else set(), {1} if i == 2 else set(), 1, 0, {i}) for i in (1, 2)}, {(1, 2)})
    M.merge_where(through, "passthrough")
    assert set(through.parts) == {1, 2}
    # part 2 takes in what passes through part 1
    caught = M.PartGraph({1: M.Part({1, 5}, {1}, set(), 1, 0, {1}), 2: M.Part({1, 6}, set(), {6}, 1, 0, {2})}, {(1, 2)})
    M.merge_where(caught, "passthrough")
    assert set(caught.parts) == {1}
    hard = M.PartGraph({i: M.Part({1}, set(), set(), 0, 1, {i}) for i in (1, 2)}, {(1, 2)})
    M.merge_where(hard, "only_nonlinear")
    assert set(hard.parts) == {1, 2}
    mixed = M.PartGraph({1: M.Part({1}, set(), set(), 0, 1, {1}), 2: M.Part({1, 2}, set(), set(), 0, 1, {2}), 3: M.Part({2}, set(), set(), 1, 0, {3})}, {(1, 2), (2, 3)})
    M.merge_where(mixed, "only_nonlinear")
    assert sorted(sorted(p.members) for p in mixed.parts.values()) == [[1, 2, 3]]


def test_favoured_side_and_order():
    part = lambda signals, linear, i: M.Part(signals, set(), set(), linear, 1 - linear, {i})
    # 2 is linear, between 1 and 3; it draws to the side that draws least of those that take equally many parts
    for down, want in ((True, [[1, 2], [3]]), (False, [[1], [2, 3]])):
        g = M.PartGraph({1: part({1, 9}, 0, 1), 2: part({1, 2}, 1, 2), 3: part({2, 8}, 0, 3)}, {(1, 2), (2, 3)})
        M.merge_where(g, "single_linear", down)
        assert sorted(sorted(p.members) for p in g.parts.values()) == want


def test_least_cut_by_brute_force():
    r = random.Random(1)
    for _ in range(60):
        n = r.randint(2, 7)
        edges = {(i, i + 1) for i in range(n - 1)} | {e for e in combinations(range(n), 2) if r.random() < 0.5}
        size, side = M.least_cut(set(range(n)), dict.fromkeys(edges, 1))
        cut = lambda s: sum((a in s) != (b in s) for a, b in edges)
        assert size == cut(side) == min(cut(set(s)) for k in range(1, n) for s in combinations(range(n), k))


def test_highly_connected_parts():
    clique = lambda a, b: set(combinations(range(a, b), 2))
    found = M.highly_connected(set(range(10)), clique(0, 5) | clique(5, 10) | {(4, 5)})
    assert sorted(map(sorted, found)) == [list(range(5)), list(range(5, 10))]


def test_parts_without_arcs_are_not_gathered(spark, monkeypatch):
    table = lambda rows, names: spark.createDataFrame(rows, names)
    inc = table([(1, 1), (1, 5), (2, 1), (2, 6), (3, 9), (4, 10)], "coni long, signal long")
    terms = inc.selectExpr("coni", "'C' AS part", "signal", "1L AS coef")
    parts = table([(i, i) for i in range(1, 5)], "coni long, part_id long")
    kept, real = [], M.cut
    monkeypatch.setattr(M, "cut", lambda df: kept.append(df.count()) or real(df))
    got = M.merged_parts(inc, terms, parts, table([(1, 2)], "src long, dst long"), table([(1,)], "signal long"), table([(6,)], "signal long"), "passthrough")
    assert sorted(map(tuple, got.collect())) == [(1, 1), (2, 1), (3, 3), (4, 4)]
    assert kept[-1] == 2


def test_line_items_are_dealt_out_once(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice([None, *range(60)]), r.choice([None, *range(-1, 90)]), r.randint(1, 6), float(r.choice([1, 2, 257]))) for _ in range(300)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    cons = R.constraints(D.terms(spark, str(tmp_path), together=True))
    assert cons._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    terms = cut(D.terms(spark, str(tmp_path)))
    inc, cons = R.incidence(terms), cut(cons)
    pairs = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert pairs(cons.select("coni", F.explode("signals"))) == pairs(inc)
    hard = cons.where("nonlinear").select("coni", "signals")
    assert {x for (x,) in pairs(hard.select("coni"))} == {x for (x,) in pairs(R.nonlinear(terms))} & {x.coni for x in inc.collect()}
    core = hard.where("coni is not null")
    assert pairs(G.set_components(core)) == pairs(G.nonlinear_cores(inc, R.nonlinear(terms)))


def test_both_roles_walk_at_once(spark):
    r = random.Random(5)
    edges = cut(spark.createDataFrame(sorted({(r.randrange(40), r.randrange(40)) for _ in range(60)}), "src long, dst long"))
    starts = spark.createDataFrame([(1, "i"), (2, "i"), (2, "o"), (9, "o")], "node long, role string")
    found = G._walked(edges, starts, ["role"])
    for role in "io":
        alone = G.distances(edges, starts.where(F.col("role") == role).select("node"))
        assert sorted(map(tuple, found.where(F.col("role") == role).select("node", "d").collect())) == sorted(map(tuple, alone.collect()))
