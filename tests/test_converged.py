import pytest

from fieldloom.operators import graph, refine


def test_louvain_stops_at_no_gain_and_raises_at_its_guard(spark):
    cliques = [(a + i, a + j, 1) for a in (0, 10) for i in range(4) for j in range(i)]
    edges = spark.createDataFrame([(min(a, b), max(a, b), w) for a, b, w in cliques] + [(0, 10, 1)], "src long, dst long, weight long")
    got = {r.node: r.cluster for r in graph.louvain(edges).collect()}
    assert got == {a + i: a for a in (0, 10) for i in range(4)}
    with pytest.raises(RuntimeError):
        graph.louvain(edges, rounds=1)


def test_refinement_raises_at_its_guard(spark, monkeypatch):
    chain = spark.createDataFrame([(i, "C", s, 1) for i in range(1, 12) for s in (i, i + 1)], "coni long, part string, signal long, coef long")
    monkeypatch.setattr(refine, "GUARD", 2)
    with pytest.raises(RuntimeError):
        refine.refined(chain)
