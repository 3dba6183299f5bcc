"""Queries: merges of parts, highly connected clusters, iterated resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import merge as M
from ..operators import relational as R
from ..sources import derived as D
from .graph_queries import dag, graph

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _merged(spark, d, kind):
    cons, parts, keyed, arcs, inputs, outputs = dag(spark, d)
    return parts, arcs, M.merged_parts(None, None, parts, arcs, inputs, outputs, kind, held=keyed, hard=cons.where("nonlinear").select("coni"))


for _name, _kind in {"dg6_merge_passthrough": "passthrough", "dg7_merge_only_nonlinear": "only_nonlinear", "dg8_merge_single_linear": "single_linear", "dg9_merge_unsafe_linear": "unsafe_linear"}.items():
    QUERIES[_name] = lambda spark, d, kind=_kind: _merged(spark, d, kind)[2]


def dg10(spark, d):
    parts, arcs, merged = _merged(spark, d, "passthrough")
    return M.merged_arcs(parts, merged, arcs)


def cl15(spark, d):
    """Of constraints that share two signals or more: by a single signal the whole table is one component, where exact cuts do not end."""
    return M.highly_connected_clusters(graph(spark, d).where("weight >= 2").select("src", "dst"))


def modularity_at(spark, d, most=2):
    edges = graph(spark, d, most)
    parts = R.incidence(D.terms(spark, d, most)).select("coni", (F.col("coni") % 5).alias("cluster")).distinct()
    return G.modularity(edges, parts, resolution=1.5).select(F.round("modularity", 6).alias("modularity"))


QUERIES |= {"dg10_merged_arcs": dg10, "cl15_highly_connected": cl15, "cl18_modularity_at_resolution": modularity_at}
_INC = "inc AS (SELECT DISTINCT coni, signal FROM term WHERE signal <> 0), e AS (SELECT a.coni AS src, b.coni AS dst, count(*) AS weight FROM inc a JOIN inc b ON a.signal = b.signal AND a.coni <> b.coni GROUP BY 1, 2)"
ORACLES["cl18_modularity_at_resolution"] = f"WITH {D.SPARSE_SQL}, {_INC}, k AS (SELECT src AS node, sum(weight) AS k FROM e GROUP BY 1), tot AS (SELECT node % 5 AS c, sum(k) AS tot FROM k GROUP BY 1), ins AS (SELECT src % 5 AS c, sum(weight) AS ins FROM e WHERE src < dst AND src % 5 = dst % 5 GROUP BY 1), m AS (SELECT sum(tot) / 2.0 AS m FROM tot) SELECT CAST(round(sum(coalesce(ins, 0)) / any_value(m) - 1.5 * sum(tot * tot) / (4.0 * any_value(m) * any_value(m)), 6) AS DOUBLE) AS modularity FROM tot LEFT JOIN ins USING (c), m"
