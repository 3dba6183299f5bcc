import random
from collections import defaultdict

import pytest

from fieldloom.llm import packing as P


def test_packs_are_sound_and_cheap():
    r = random.Random(0)
    for _ in range(40):
        sizes = [r.randint(1, r.choice([50, 600, 4096])) for _ in range(r.randint(0, 300))]
        bins, lengths = P.pack(sizes)
        fill = defaultdict(int)
        for b, s in zip(bins, sizes, strict=True):
            fill[b] += s
        assert sorted(fill) == list(range(len(lengths)))
        for b, n in enumerate(lengths):
            assert n == min(x for x in P.LENGTHS if x >= fill[b])
        alone = sum(P.cost(min(x for x in P.LENGTHS if x >= s), 4096) for s in sizes)
        assert sum(P.cost(n, 4096) for n in lengths) <= alone


def least_cost(sizes, lengths):
    """Over all ways to share sizes out to sequences."""
    best = [float("inf")]

    def place(i, fill):
        if i == len(sizes):
            best[0] = min(best[0], sum(P.cost(min(x for x in lengths if x >= f), lengths[-1]) for f in fill))
            return
        for b in range(len(fill)):
            if fill[b] + sizes[i] <= lengths[-1]:
                place(i + 1, fill[:b] + [fill[b] + sizes[i]] + fill[b + 1 :])
        place(i + 1, fill + [sizes[i]])

    place(0, [])
    return best[0]


def test_costs_are_near_the_least():
    r, lengths, ratio = random.Random(4), [8, 16, 32, 64], []
    for _ in range(150):
        sizes = [r.randint(1, r.choice([6, 20, 64])) for _ in range(r.randint(1, 8))]
        got = sum(P.cost(n, 64) for n in P.pack(sizes, lengths)[1])
        ratio.append(got / least_cost(sizes, lengths))
    assert max(ratio) < 1.35 and sum(ratio) / len(ratio) < 1.03 and sum(x < 1 + 1e-9 for x in ratio) > 90


def test_bin_sizes_are_chosen_by_cost():
    lengths = [8, 16]
    # a 7 fills a short sequence alone; a 5 waits for 11 others
    assert P.cheapest_size(7, P._ToCome([]), lengths) == 8
    assert P.cheapest_size(11, P._ToCome([5]), lengths) == 16
    assert P.cheapest_size(5, P._ToCome([3]), lengths) == 8
    assert P.cheapest_size(5, P._ToCome([5, 5, 1]), lengths) == 16  # 16 of 16 cost 20, 6 of 8 cost 9
    bins, final = P.pack([7, 7, 11, 5, 5, 3], lengths)
    assert sorted(final) == [8, 8, 8, 16]


def test_best_fit_takes_the_tightest_bin():
    bins, fill = P.best_fit([6, 5, 4, 3], lambda s, rest: 10)
    assert bins == [0, 1, 0, 1] and fill == [10, 8]


@pytest.mark.parametrize("sizes,most", [([9], 4), ([4, 5, 1], 4), ([], 4)])
def test_pieces(sizes, most):
    item, start, length = P.pieces(sizes, most)
    for i, s in enumerate(sizes):
        own = [(a, n) for j, a, n in zip(item, start, length) if j == i]
        assert sum(n for _, n in own) == s and all(n <= most for _, n in own) and [a for a, _ in own] == list(range(0, s, most))


def test_tables(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK_ROWS", 50)
    rows = [(i, "w " * (i * 37 % 700), 3) for i in range(200)] + [(None, None, 1), (201, "", 1), (202, "w " * 20000, 1), (3, "w " * 111, 3), (3, "w " * 111, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    out = P.packed(docs).collect()
    tokens = defaultdict(int)
    for r in out:
        tokens[r.doc_id] += r.n_tokens
    want = defaultdict(int)
    for i, t, _ in rows:
        want[i] += len((t or "").split()) + 1
    assert tokens == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence].append(r)
    for seq in by.values():
        seq.sort(key=lambda r: r.position)
        at = 0
        for r in seq:
            assert r.position == at
            at += r.n_tokens
        assert len({r.sequence_length for r in seq}) == 1 and seq[0].sequence_length == min(x for x in P.LENGTHS if x >= at)
    assert P.packed(docs.limit(0)).collect() == []
