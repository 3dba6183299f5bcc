import numpy as np
import pytest

from fieldloom.llm import mtree as M


def brute(ids, vectors, q, x, k):
    s = vectors @ x
    rows = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
    return [(int(s[i]), int(ids[i])) for i in rows]


@pytest.fixture(autouse=True)
def small_pages(monkeypatch):
    monkeypatch.setattr(M, "PAGE", 64)


@pytest.mark.parametrize("kind", ["normal", "clusters", "copies", "few", "one"])
def test_search_equals_brute_force(kind):
    rng = np.random.default_rng(0)
    n = {"few": 3, "one": 1}.get(kind, 3000)
    x = rng.standard_normal((n, 8)) * 60
    if kind == "clusters":
        x = x / 20 + rng.standard_normal((30, 8))[rng.integers(0, 30, n)] * 60
    if kind == "copies":
        x[: n // 2] = x[0]
        x[-200:] = 0
    v = np.floor(x).astype(np.int64)
    ids = rng.permutation(n) * 3
    tree, seen = M.build(ids, v), [0]
    tree = M.quick(tree) if kind != "normal" else tree
    for i in range(0, n, max(1, n // 60)):
        assert M.search(tree, int(ids[i]), v[i], 5, seen) == brute(ids, v, ids[i], v[i], 5)
    if kind == "clusters":
        assert seen[0] < 0.7 * 60 * n


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 64)
    monkeypatch.setattr(M, "QUERIES", 4)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.standard_normal(6)], 1) for i in range(600)]
    rows += [(1000, None, 1), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1050, [float("nan")] * 6, 1), (1100, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (1150, [0.5, 0.5], 1), (1151, [0.25, 1.0], 1), (1200, [], 1), (77, rows[77][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    out = M.top_products(table).collect()
    good = [(i, np.floor(np.array(v) * 256).astype(np.int64)) for i, v, _ in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v)]
    want = set()
    for q, x in good:
        if q % 50 == 0:
            best = sorted(((-int(x @ v), i) for i, v in good if i != q and len(v) == len(x)))[:5]
            want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {tuple(r) for r in out} == want and len(out) == len(want)
    assert M.top_products(table.limit(0)).collect() == []
