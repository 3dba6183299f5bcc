import zlib

import numpy as np

from fieldloom.llm import sharding as S


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2.0**31 / ((key >> 33) + 1)))
    return b


def test_jump_equals_the_published_loop_and_moves_only_into_the_new_shard():
    keys = np.random.default_rng(0).integers(0, 2**64, 3000, np.uint64)
    for n in (1, 2, 3, 8, 9, 100):
        got = S.jump(keys, n)
        assert got[:300].tolist() == [plain_jump(int(k), n) for k in keys[:300]]
        grown = S.jump(keys, n + 1)
        moved = got != grown
        assert (grown[moved] == n).all()
        assert abs(moved.mean() - 1 / (n + 1)) < 0.05


def test_tables(spark):
    rows = [(i, f"té{i % 7}", 1) for i in range(2000)] + [(None, None, 1), (None, "x", 2), (5, "té5", 1), (5, "other", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    out = S.shard_documents(docs).collect()
    assert len(out) == len(rows)
    want = sorted((i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r["size"], r.text_crc32) for r in out) == want
    assert len({(r.doc_id, r.shard) for r in out}) == 2001
    for s in range(8):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) > 150
    assert all(r.law == "key" and r.grown_shard in (r.shard, 8) for r in out)
    assert S.shard_documents(docs.limit(0)).collect() == []
