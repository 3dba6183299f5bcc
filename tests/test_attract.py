from fieldloom.operators import graph as G


def test_rings_join_only_through_nonlinear_constraints(spark):
    # 1 and 4 are non-linear; 2 stands beside 1, 3 beside 4; 2 and 3 share a signal that neither core holds
    inc = spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 11), (3, 12), (4, 12)], "coni long, signal long")
    hard = spark.createDataFrame([(1,), (4,)], "coni long")
    got = {r.coni: r.cluster for r in G.attracted(inc, hard, first_ring=True).collect()}
    assert got[1] == got[2] != got[3] == got[4]
    # beside both cores a constraint joins them
    both = inc.union(spark.createDataFrame([(5, 10), (5, 12)], "coni long, signal long"))
    assert len({r.cluster for r in G.attracted(both, hard, first_ring=True).collect()}) == 1
