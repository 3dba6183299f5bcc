"""Twins over the whole table, and queries without SQL, against brute force on a small table."""

import random
from collections import defaultdict
from itertools import combinations

import pytest

from fieldloom.operators import merge
from fieldloom.plans import catalog


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    r = random.Random(11)
    rows = [(o, r.randint(1, 40), n, float(r.randint(1, 50))) for o in range(1, 61) for n in range(1, r.randint(2, 4))]
    d = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    coef = defaultdict(int)
    for o, p, n, q in rows:
        coef[o, "CAB"[n % 3], p + 1] += int(q)
    return str(d), {k: v % 257 for k, v in coef.items() if v % 257}


def sides(terms):
    of = defaultdict(set)
    for o, _, s in terms:
        of[o].add(s)
    linear = {o for o in of if not {"A", "B"} <= {p for x, p, _ in terms if x == o}}
    return of, linear


def joined(of):
    """Least constraint of each component."""
    name = {o: o for o in of}
    for _ in of:
        for a in of:
            for b in of:
                if of[a] & of[b]:
                    name[a] = name[b] = min(name[a], name[b])
    return name


def got(spark, small, name, key, value):
    return {r[key]: r[value] for r in catalog.QUERIES[name](spark, small[0]).collect()}


def test_every_sliced_query_has_a_whole_twin():
    import inspect

    names = [n for n, f in catalog.QUERIES.items() if not n.endswith("_whole") and "most" in inspect.signature(f).parameters]
    assert len(names) > 40 and all(f"{n}_whole" in catalog.QUERIES for n in names)


def test_components_and_cores(spark, small):
    of, linear = sides(small[1])
    assert got(spark, small, "gt7_components_whole", "coni", "component") == joined(of)
    assert got(spark, small, "gt8_linear_clusters_whole", "coni", "component") == joined({o: s for o, s in of.items() if o in linear})
    cores = joined({o: s for o, s in of.items() if o not in linear})
    assert got(spark, small, "gt12_cores_whole", "coni", "core") == cores
    assert got(spark, small, "cl6_completed_whole", "coni", "cluster") == cores | {o: o for o in linear}


def test_distances(spark, small):
    of, _ = sides(small[1])
    d = {o: 0 for o in of if o % 100 == 7}
    for k in range(len(of)):
        d |= {b: k + 1 for a in list(d) for b in of if d[a] == k and b not in d and of[a] & of[b]}
    assert len(d) > 5 and got(spark, small, "gt1_distances_whole", "node", "d") == d


def test_attracted(spark, small):
    of, linear = sides(small[1])
    state = joined({o: s for o, s in of.items() if o not in linear})
    while True:
        near = {o: {c for x, c in state.items() if of[x] & of[o]} for o in of if o not in state}
        new = {o: min(c) for o, c in near.items() if len(c) == 1}
        if not new:
            break
        state |= new
    assert len(state) > 20 and got(spark, small, "cl5_attracted", "coni", "cluster") == state


def test_highly_connected(spark, small):
    of, _ = sides(small[1])
    edges = {(a, b) for a in of for b in of if a < b and len(of[a] & of[b]) >= 2}
    cluster = got(spark, small, "cl15_highly_connected", "coni", "cluster")
    assert edges and set(cluster) == {x for e in edges for x in e}
    members = defaultdict(set)
    for x, c in cluster.items():
        members[c].add(x)
    for c, of_c in members.items():
        assert c == min(of_c) and len(of_c) <= 12
        for k in range(1, len(of_c)):
            for side in map(set, combinations(of_c, k)):
                assert 2 * sum(a in of_c and b in of_c and (a in side) != (b in side) for a, b in edges) > len(of_c)


def test_highly_connected_bound(spark):
    path = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "src long, dst long")
    with pytest.raises(ValueError, match="3 nodes"):
        merge.highly_connected_clusters(path, most=2)
    assert sorted(map(tuple, merge.highly_connected_clusters(path, most=3).collect())) == [(1, 1), (2, 2), (3, 3), (7, 7), (8, 8)]
