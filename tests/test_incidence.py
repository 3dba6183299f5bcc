"""Ways and layers over the incidence against brute force on pairs; loops leave no tables behind."""

import random
from collections import defaultdict
from itertools import combinations
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from fieldloom.operators import graph
from fieldloom.plans import fixpoint


@pytest.fixture(scope="module")
def table(spark):
    r = random.Random(5)
    rows = sorted({(c, r.randint(1, 90)) for c in range(80) for _ in range(r.randint(1, 3))})
    return rows, spark.createDataFrame(rows, "coni long, signal long")


def test_upward_ways(spark, table):
    rows, inc = table
    of = defaultdict(set)
    for c, s in rows:
        of[c].add(s)
    up = {(a, b) for a, b in combinations(sorted(of), 2) if of[a] & of[b]}
    for down in (False, True):
        found = {3, 40}
        while more := {y for a, b in up for x, y in ([(b, a)] if down else [(a, b)]) if x in found} - found:
            found |= more
        start = spark.createDataFrame([(3,), (40,)], "node long")
        assert len(found) > 5 and {r.node for r in graph.upward(inc, start, down).collect()} == found


def test_nodes_go_by_arcs(spark, table):
    rows, inc = table
    parts = inc.select("coni", F.col("coni").alias("part_id")).distinct()
    pick = lambda k: inc.where(F.col("signal") % 10 == k).select("signal").distinct()
    merged, keyed = graph.order_of_parts(inc, parts, pick(1), pick(2))
    part = {r.coni: r.part_id for r in merged.collect()}
    held = defaultdict(set)
    for c, s in rows:
        held[part[c]].add(s)
    key = {r.part_id: (r.i, -r.o) for r in keyed.collect()}
    pairs = {(a, b) for a in held for b in held if a != b and held[a] & held[b]}
    arcs = {(a, b) for a, b in pairs if key[a] < key[b]}
    assert all(key[a] != key[b] for a, b in pairs) and {tuple(r) for r in graph.arcs_of(keyed).collect()} == arcs
    want = {(a, s, "out") for a, b in arcs for s in held[a] & held[b]} | {(b, s, "in") for a, b in arcs for s in held[a] & held[b]}
    want |= {(a, s, name) for a, ss in held.items() for s in ss for k, name in ((1, "in"), (2, "out")) if s % 10 == k}
    assert {tuple(r) for r in graph.node_table(keyed, pick(1), pick(2)).collect()} == want


def test_a_loop_keeps_one_state(spark):
    fixpoint.ready(spark)
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    tables = lambda: {x.name for x in Path(urlparse(folder).path).glob("cut-*")}
    before = tables()
    end = fixpoint.iterate(spark.range(5).toDF("x"), lambda s: s.select(F.least(F.col("x") + 1, F.lit(9)).alias("x")), lambda s: s.agg(F.sum("x")).first())
    left = tables() - before
    assert [r.x for r in end.collect()] == [9] * 5
    assert left == {end._cut_path.split("/")[-1]}
