"""Louvain over the incidence: no pairs, no two communities that gain by merging."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import communities, relational
from fieldloom.plans import catalog


def test_hash_is_sparks(spark):
    ids = [0, 1, -7, 1 << 40]
    rows = spark.createDataFrame([(i,) for i in ids], "x long").select(F.xxhash64(F.lit(1007), "x")).collect()
    assert [r[0] for r in rows] == communities._hash(1007, np.array(ids)).tolist()


@pytest.mark.parametrize("most, alone", [(10**6, 10**6), (15, 0)])
def test_no_communities_gain_by_merging(spark, monkeypatch, most, alone):
    monkeypatch.setattr(communities.votes, "BLOCK", 200)
    monkeypatch.setattr(communities, "MOST", most)
    monkeypatch.setattr(communities, "ALONE", alone)
    r = random.Random(3)
    rows = sorted({(c, r.choice([c // 20 * 10 + r.randint(0, 9), r.randint(0, 60)])) for c in range(50) for _ in range(r.randint(1, 4))} | {(9999, 7777)})
    inc = spark.createDataFrame(rows, "coni long, signal long")
    own = {x.node: x.cluster for x in communities.louvain(inc).collect()}
    weight, by_signal = {}, {}
    for c, s in rows:
        by_signal.setdefault(s, []).append(c)
    for held in by_signal.values():
        for a, b in combinations(held, 2):
            weight[a, b] = weight.get((a, b), 0) + 1
    k = {n: 0 for n in own}
    for (a, b), w in weight.items():
        k[a] += w
        k[b] += w
    assert set(own) == {n for pair in weight for n in pair}
    m2, tot, links = sum(k.values()), {}, {}
    for n, c in own.items():
        tot[c] = tot.get(c, 0) + k[n]
    for (a, b), w in weight.items():
        for x, y in ((own[a], own[b]), (own[b], own[a])):
            if x != y:
                links[x, y] = links.get((x, y), 0) + w
    assert all(w - tot[x] * tot[y] / m2 <= 1e-8 for (x, y), w in links.items())  # no two communities gain by merging
    inside = sum(w for (a, b), w in weight.items() if own[a] == own[b])
    assert 2 * inside / m2 - sum((t / m2) ** 2 for t in tot.values()) > 0.25
    assert all(min(n for n in own if own[n] == c) == c for c in set(own.values()))


def test_cliques_and_guard(spark):
    inc = spark.createDataFrame([(a + i, a + s) for a in (0, 10) for i in range(4) for s in (1, 2)] + [(0, 99), (10, 99)], "coni long, signal long")
    assert {tuple(x) for x in communities.louvain(inc).collect()} == {(a + i, a) for a in (0, 10) for i in range(4)}
    with pytest.raises(RuntimeError):
        communities.louvain(inc, rounds=1)


def test_the_query_makes_no_pairs(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(o, o % 7, n, 1.0) for o in range(60) for n in (1, 2)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(relational, "shared_signals", lambda inc: pytest.fail("pairs"))
    got = catalog.QUERIES["cl1_louvain"](spark, str(tmp_path)).collect()
    assert len(got) == 60 and {(r.node, r.cluster) for r in got} == {(o, o % 7) for o in range(60)}
