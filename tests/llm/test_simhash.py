import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from fieldloom.llm import simhash as S
from fieldloom.operators.graph import components


def plain_fingerprint(text, shingle=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, bits):
    up = list(range(len(fps)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(fps)), 2):
        if bin(fps[i] ^ fps[j]).count("1") <= bits:
            a, b = sorted((top(i), top(j)))
            up[b] = a
    return [top(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \n", "a", "A b", "a b c", "A b C d a b c", "x " * 1000, "é\x0bß q w e r t y"])
def test_fingerprints(text):
    assert S.fingerprint((text or "").encode()) == plain_fingerprint(text)


def test_golay_decodes_three_errors():
    golay, r = S.Golay(), random.Random(0)
    for _ in range(500):
        index = r.randrange(4096)
        word = index << 11
        word |= int(golay.high[index])
        for b in r.sample(range(23), r.randint(0, 3)):
            word ^= 1 << b
        assert golay.index(np.array([word]))[0] == index


def test_keys_meet_for_all_error_patterns():
    golay, r = S.Golay(), random.Random(1)
    for _ in range(300):
        x = r.getrandbits(64)
        y = x
        for b in r.sample(range(64), r.randint(1, 3)):
            y ^= 1 << b
        keys = [[set(), set()], [set(), set()]]
        for row, key, side in S.fuzzy_keys(np.array([x, y], np.uint64), golay):
            for i, k in zip(row.tolist(), key.tolist()):
                keys[i][side].add(k)
        assert keys[0][0] & keys[1][1] and keys[1][0] & keys[0][1]


@pytest.mark.parametrize("block", [2048, 4])
def test_links_join_what_is_near(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    r = random.Random(2)
    fps = []
    for _ in range(40):
        x = r.getrandbits(64)
        fps.append(x)
        for _ in range(r.randint(0, 12)):
            for b in r.sample(range(64), r.randint(1, 5)):
                x ^= 1 << b
            fps.append(x)
    fps = list(dict.fromkeys(fps))
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, node long")
    got = {row.node: row.component for row in components(S.links(nodes), "a", "b").collect()}
    assert [got.get(i, i) for i in range(len(fps))] == classes(fps, 3)


def test_tables(spark):
    base = "the quick brown fox jumps over the lazy dog while seven wise owls watch from tall old trees by a slow river"
    texts = [base, base, base.upper(), base + " today", None, "", "one", "other words that have nothing to do with any of those here", base * 50, " ".join(str(i) for i in range(3000))]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, base, "x"), (3, base + " today", "x"), (20, "one", None), (20, "quite different words stand here now", "x"), (21, "quite different words stand here now", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = S.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    ids = [i for i, _, _ in rows if i is not None]
    assert {r.fingerprint for r in out if r.doc_id is None} == {format(plain_fingerprint(base), "016x")}
    assert all(r.component_id is None for r in out if r.doc_id is None)
    got = {r.doc_id: r.component_id for r in out if r.doc_id is not None}
    assert got[1] == got[2] == 0 and got[4] == got[5] == 4 and got[20] == got[21] == got[6] == 6
    assert got[7] == 7 and set(got) == set(ids)
    left = S.without_near_duplicates(docs).collect()  # whole texts: one word more makes too little of a difference
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted({c for c in got.values()})
    assert sum(r.doc_id is None for r in left) == 1
    assert S.near_duplicates(docs.limit(0)).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 600)] + [(7, 7), (900, 901), (901, 900)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 500 for i in range(500, 600)) and got[901] == got[900] == 900
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []
