import random
from itertools import combinations

from fieldloom.operators import lower


def test_least_cost_above_sixteen_candidates():
    shared = {0: ("mul", ("leaf", 1), ("leaf", 1))} | {i: ("mul", ("exp", 0), ("leaf", 1)) for i in range(1, 19)}
    exprs = shared | {99: ("add", *(("mul", ("exp", i), ("leaf", 1)) for i in range(1, 19)))}
    assert lower.keep_for_degree(exprs, {0: 5} | dict.fromkeys(range(1, 19), 1), 99, 3) == {0}


def test_against_all_subsets():
    r = random.Random(4)
    for _ in range(150):
        n = r.randint(3, 7)
        leaf = lambda i: ("exp", r.randrange(i)) if i and r.random() < 0.8 else ("leaf", 1)
        exprs = {i: (r.choice(["mul", "mul", "add"]), leaf(i), leaf(i)) for i in range(n)}
        dims = {i: r.choice([1, 2, 5, None]) for i in range(n - 1)}
        need = lower.used(exprs, n - 1)
        pool = [i for i in dims if dims[i] is not None and i in need]

        def fits(keep, d):
            raw, kept = {}, {}
            for i in range(n):
                raw[i] = lower.degree(exprs[i], kept)
                kept[i] = 1 if i in keep and raw[i] > 1 else raw[i]
            return all(raw[i] <= d for i in need if i == n - 1 or i in keep)

        for d in (2, 3):
            ways = [set(c) for k in range(len(pool) + 1) for c in combinations(pool, k)]
            costs = [sum(dims[i] for i in k) for k in ways if fits(k, d)]
            got = lower.keep_for_degree(exprs, dims, n - 1, d)
            assert (got is None) == (not costs)
            if got is not None:
                assert fits(got, d) and sum(dims[i] for i in got) == min(costs)
