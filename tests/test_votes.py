"""Label propagation over the incidence gives the labels of the pairs, without a row a pair."""

import random
from types import SimpleNamespace

import pytest

from pyspark.sql import functions as F

from fieldloom.operators import graph, refine, relational, votes
from fieldloom.plans import catalog


@pytest.mark.parametrize("rounds", [1, 2, 20])
def test_as_over_pairs(spark, rounds, monkeypatch):
    monkeypatch.setattr(votes, "BLOCK", 40)
    r = random.Random(rounds)
    rows = sorted({(c * 3 + 1, r.choice([r.randint(1, 60), r.randint(1, 6) * 100])) for c in range(120) for _ in range(r.randint(1, 4))} | {(9999, 7777)})
    inc = spark.createDataFrame(rows, "coni long, signal long")
    want = {tuple(x) for x in graph.propagated_labels(relational.shared_signals(inc), rounds).collect()}
    got = {tuple(x) for x in votes.propagated(inc, rounds).collect()}
    assert len(want) > 100 and got == want


def test_few_changes_add_up_few_votes(spark, monkeypatch):
    each, blocks, added = votes._each, votes._blocks, []

    def here(spark, parts, work, schema="x long"):
        if schema != "x long":
            return each(spark, parts, work, schema)
        return SimpleNamespace(collect=lambda: [(x,) for p in range(parts) for batch in work(p) for x in batch.column(0).to_pylist()])

    def counted(folder, table, parts, found):
        added.append((table, int(found[3].sum())))
        return blocks(folder, table, parts, found)

    monkeypatch.setattr(votes, "_each", here)
    monkeypatch.setattr(votes, "_blocks", counted)
    groups = [(c * 3 + k, 1000 + c * 2 + s) for c in range(100) for k in range(3) for s in range(2)]
    path = [(5000 + c, 9000 + c + s) for c in range(25) for s in range(2)]  # its labels move on by one constraint a round
    inc = spark.createDataFrame(groups + path, "coni long, signal long")
    want = {tuple(x) for x in graph.propagated_labels(relational.shared_signals(inc), 20).collect()}
    assert {tuple(x) for x in votes.propagated(inc, 20).collect()} == want
    of = lambda *tables: sum(n for table, n in added if table in tables)
    assert of("count1") >= 650 and 0 < of("count15", "delta15") < 200


def test_sums_that_do_not_fit_one_number():
    import numpy as np

    row, label, n = (np.array(x, np.int64) for x in ([3, 0, 3, 3], [1 << 61, 5, 1 << 61, 7], [1, 2, 3, 4]))
    assert [x.tolist() for x in votes._summed(row, label, n)] == [[0, 3, 3], [5, 7, 1 << 61], [2, 4, 4]]


def test_no_pairs_are_made(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(o, o % 7, n, 1.0) for o in range(60) for n in (1, 2)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(relational, "shared_signals", lambda inc: pytest.fail("pairs"))
    for name in ("cl16_labels", "cl16_labels_two_rounds_whole"):
        assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 60


@pytest.mark.parametrize("seed", [1, 2])
def test_successor_colours_as_over_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(votes, "BLOCK", 40)
    r = random.Random(seed)
    some = sorted({(c, r.choice([r.randint(1, 60), r.randint(1, 6) * 100])) for c in range(90) for _ in range(r.randint(1, 4))})
    rows = some + [(c + 200, s + 1000) for c, s in some] + [(9999, 7777)]  # a copy, so that classes have two members
    inc = spark.createDataFrame(rows, "coni long, signal long")
    nodes = inc.select(F.col("coni").alias("node"), F.lit(0).cast("long").alias("color")).distinct()
    want = {tuple(x) for x in refine.refined_nodes(relational.shared_signals(inc).select("src", "dst"), nodes).collect()}
    assert {tuple(x) for x in votes.successor_colors(inc).collect()} == want and len({c for _, c in want}) > 20


def test_successor_colours_make_no_pairs(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(o, o % 7, n, 1.0) for o in range(60) for n in (1, 2)], "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(relational, "shared_signals", lambda inc: pytest.fail("pairs"))
    assert catalog.QUERIES["fp12_successor_colours_whole"](spark, str(tmp_path)).count() == 60
