"""Edited copies go, by brute force over sets of five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline
from fieldloom.llm import shared, similar, simhash


def plain(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("members", [1024, 3])
def test_stage_drops_edited_copies(spark, monkeypatch, members):
    monkeypatch.setattr(similar, "MEMBERS", members)
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    texts = []
    for _ in range(40):
        base = [word() for _ in range(r.choice([30, 120, 400]))]
        texts.append(base)
        for edits in (1, 2, 3, 5, 9, 20):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = word()
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, "a b"), (901, "A  b"), (902, "a c"), (903, ""), (904, None), (None, "a b"), (7, "a b"), (7, " ".join(texts[7]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, plain(t or "")) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    alike = 0
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i == j or len(a & b) >= 0.8 * len(a | b):
                alike += i != j
                p, q = top(i), top(j)
                up[max(p, q)] = min(p, q)
    assert alike > 150
    got = [x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert got.count(None) == 1
    assert sorted(i for i in got if i is not None) == sorted({top(i) for i in up})
    assert simhash.without_near_duplicates(docs.limit(0)).collect() == []


def test_sets_lie_in_files_and_rows_say_where(spark, monkeypatch):
    monkeypatch.setattr(similar, "IN_FILE", 30)
    texts = [" ".join(f"w{i * j}" for j in range(i % 12)) for i in range(60)]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    folder = shared.new_dir(spark, "arrays")
    rows = shared.written(similar.with_sets(docs, "text", 5, folder), "places")
    assert rows.dtypes == [("node", "bigint"), ("place", "struct<file:string,first:bigint,n:bigint>")]
    want = {similar.name_of(s): s.tolist() for s in (np.unique(similar.hashed_shingles(t.encode(), 5)) for t in texts)}
    places = rows.toArrow().column("place").combine_chunks()
    assert len(set(places.field("file").to_pylist())) > 4
    got = [s.tolist() for s in similar.sets_at(places, folder)]
    assert dict(zip([r.node for r in rows.collect()], got, strict=True)) == want
