"""Equivalence says yes only with a mapping that holds term by term."""

import random

import pytest

from fieldloom.operators import refine as X

COLUMNS = "coni long, part string, signal long, coef long"


def system(*constraints):
    """Each constraint is three maps from signals to coefficients."""
    return [(i, part, s, c) for i, con in enumerate(constraints) for part, side in zip("ABC", con) for s, c in side.items()]


# s1 and s2 share a factor in the first system only; signal by signal both look alike
ONE = system(({1: 1, 2: 2}, {3: 1, 4: 2}, {5: 1}), ({1: 1, 2: 1}, {6: 1}, {7: 1}))
TWO = system(({1: 1, 4: 2}, {3: 1, 2: 2}, {5: 1}), ({1: 1, 2: 1}, {6: 1}, {7: 1}))


def renamed(rows, seed):
    r = random.Random(seed)
    signals = sorted({s for _, _, s, _ in rows if s})
    new = dict(zip(signals, r.sample(range(1, 1000), len(signals)), strict=True)) | {0: 0}
    cons = sorted({c for c, _, _, _ in rows})
    at = dict(zip(cons, r.sample(range(1000), len(cons)), strict=True))
    side = lambda c: lambda p: {"A": "B", "B": "A"}.get(p, p) if c in flip else p
    like = lambda c: sorted(k for i, p, _, k in rows if i == c and p == "A") == sorted(k for i, p, _, k in rows if i == c and p == "B")
    flip = {c for c in cons if like(c) and r.random() < 0.5}
    return [(at[c], side(c)(p), new[s], k) for c, p, s, k in rows]


def holds(left, right, names):
    """Whether ``names`` makes the constraints of left those of right, factors of like coefficients in any order."""

    def forms(rows, name):
        out = {}
        for c, p, s, k in rows:
            out.setdefault(c, {"A": [], "B": [], "C": []})[p].append((name(s), k))
        fixed = []
        for x in out.values():
            a, b, c = (tuple(sorted(x[p])) for p in "ABC")
            like = sorted(k for _, k in a) == sorted(k for _, k in b)
            fixed.append((*sorted((a, b)), c) if like else (a, b, c))
        return sorted(fixed)

    return forms(left, lambda s: names[s]) == forms(right, lambda s: s)


def test_factors_that_signals_share_count(spark):
    df = lambda rows: spark.createDataFrame(rows, COLUMNS)
    assert X.same_small(df(ONE).toPandas(), df(TWO).toPandas()) is False
    assert X.same_system(df(ONE), df(TWO))["result"] is False
    parts = [(i, 0) for i in (0, 1)] + [(i, 10) for i in (10, 11)]
    both = ONE + [(c + 10, p, s + 100, k) for c, p, s, k in TWO]
    out = X.equivalent_parts(spark.createDataFrame(parts, "coni long, part_id long"), df(both)).collect()
    assert {(r.part_id, r.class_id, r.sure) for r in out} == {(0, 0, True), (10, 10, True)}


@pytest.mark.parametrize("seed", range(4))
def test_mappings_hold(spark, seed):
    r = random.Random(seed)
    some = lambda at: {r.randint(at, at + 5): r.randint(1, 2) for _ in range(r.randint(1, 3))}
    pieces = [system(*((some(at), some(at), some(at)) for _ in range(3))) for at in (1, 11, 21)]
    rows = [(c + 10 * i, p, s, k) for i, x in enumerate(pieces) for c, p, s, k in x]
    # copies of a piece, a ring that looks alike everywhere, and a constraint of constants
    rows += [(c + 50, p, s + 40, k) for c, p, s, k in pieces[0]]
    for i in range(6):
        rows += [(80 + i, "C", 60 + i, 1), (80 + i, "C", 60 + (i + 1) % 6, 1)]
    rows += [(99, "C", 0, 3)]
    other = renamed(rows, seed)
    got = X.same_system(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(other, COLUMNS))
    assert got["result"] is True
    names = {x.left_signal: x.right_signal for x in got["signals"].collect()} | {0: 0}
    assert holds(rows, other, names)
    i = r.randrange(len(rows) - 1)
    changed = [(*x[:3], x[3] + 7) if j == i else x for j, x in enumerate(other)]
    assert X.same_system(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(changed, COLUMNS))["result"] is False


def test_two_rings_are_not_one(spark):
    ring = lambda n, at: [x for i in range(n) for x in ((at + i, "C", at + i + 1, 1), (at + i, "C", at + (i + 1) % n + 1, 1))]
    df = lambda rows: spark.createDataFrame(rows, COLUMNS)
    assert X.same_system(df(ring(6, 0)), df(ring(3, 0) + ring(3, 10)))["result"] is False
    assert X.same_system(df(ring(3, 0) + ring(3, 10)), df(ring(3, 20) + ring(3, 40)))["result"] is True


def test_coefficients_alone_prove_a_difference(spark, monkeypatch):
    monkeypatch.setattr(X, "refined", lambda *a, **k: pytest.fail("colours are not needed"))
    df = lambda rows: spark.createDataFrame(rows, COLUMNS)
    other = [(*x[:3], x[3] + (i == 4)) for i, x in enumerate(ONE)]
    assert X.same_system(df(ONE), df(other))["result"] is False


def test_shapes_survive_scaling_and_swaps(spark):
    from fieldloom.functions.field import Field
    from fieldloom.operators import normalise

    f, df = Field(257), lambda rows: spark.createDataFrame(rows, COLUMNS)
    r = random.Random(3)
    rows = [(i, p, s, r.randint(1, 256)) for i in range(40) for p in "ABC" for s in r.sample(range(9), r.randint(0, 4))]
    rows += [(50, "A", 1, 1), (50, "A", 2, 256), (50, "A", 3, 16), (50, "A", 4, 241)]  # sums of powers that vanish
    other = X.shuffled(df(rows), 5)
    assert not X.surely_different(df(rows), other, f)
    assert not X.surely_different(df(rows), normalise.norms(df(rows)).where("choice = 1"), f)
    changed = [(*x[:3], x[3] % 256 + 1) if x == rows[7] else x for x in rows]
    assert sum(x[:2] == rows[7][:2] for x in rows) > 1 and X.surely_different(df(rows), df(changed), f)


def test_a_changed_coefficient_is_found_before_norms(spark, monkeypatch):
    from fieldloom.operators import normalise
    from fieldloom.plans import catalog

    monkeypatch.setattr(normalise, "norms", lambda *a: pytest.fail("norms are not needed"))
    got = catalog.QUERIES["eq1_changed_coefficient"](spark, "/root/testdata/sf0.001").collect()
    assert [tuple(x) for x in got] == [(False, None, None)]
