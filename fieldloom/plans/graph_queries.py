"""Queries and their SQL: distances, components, clusters, layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import communities as C
from ..operators import graph as G
from ..operators import relational as R
from ..operators import votes as W
from ..plans.fixpoint import cut
from ..sources import derived as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
INC = "inc AS (SELECT DISTINCT coni, signal FROM term WHERE signal <> 0)"
S = f"{D.SPARSE_SQL}, {INC}"
EDGE = "e AS (SELECT a.coni AS src, b.coni AS dst, count(*) AS weight FROM inc a JOIN inc b ON a.signal = b.signal AND a.coni <> b.coni GROUP BY 1, 2)"
CC = "reach AS (SELECT DISTINCT coni AS x, coni AS y FROM {i} UNION SELECT r.x, b.coni FROM reach r JOIN {i} a ON a.coni = r.y JOIN {i} b ON a.signal = b.signal), cc AS (SELECT x AS coni, min(y) AS component FROM reach GROUP BY x)"
NONLINEAR = "nl AS (SELECT coni FROM term GROUP BY coni HAVING bool_or(part = 'A') AND bool_or(part = 'B'))"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {sql}"
        return f

    return put


def sparse(spark, d, most=None):
    t = D.terms(spark, d, most)
    return t, R.incidence(t)


def graph(spark, d, most=None):
    return R.shared_signals(sparse(spark, d, most)[1])


def arrows(spark, d, most=None):
    return R.both_ways(graph(spark, d, most))


def starts(spark, d, k=7, most=None):
    return sparse(spark, d, most)[1].where(F.col("coni") % 100 == k).select(F.col("coni").alias("node")).distinct()


@query("gt1_distances", f"{S}, {EDGE}, w AS (SELECT DISTINCT coni AS node, 0 AS d FROM inc WHERE coni % 100 = 7 UNION SELECT dst, d + 1 FROM w JOIN e ON src = node WHERE d < 40) SELECT node, CAST(min(d) AS BIGINT) AS d FROM w GROUP BY node")
def gt1(spark, d, most=2):
    return G.distances(arrows(spark, d, most), starts(spark, d, 7, most))


@query("gt2_signal_distances", f"{S}, w AS (SELECT DISTINCT signal, 0 AS d FROM inc WHERE signal % 100 = 5 UNION SELECT b.signal, d + 1 FROM w JOIN inc a USING (signal) JOIN inc b ON a.coni = b.coni WHERE d < 40) SELECT signal, CAST(min(d) AS BIGINT) AS d FROM w GROUP BY signal")
def gt2(spark, d, most=2):
    inc = sparse(spark, d, most)[1]
    return G.signal_distances(inc, inc.where("signal % 100 = 5").select("signal").distinct())


UP = "f AS (SELECT DISTINCT coni AS node FROM inc WHERE coni % 100 = 7 UNION SELECT dst FROM f JOIN e ON src = node WHERE src < dst), b AS (SELECT DISTINCT coni AS node FROM inc WHERE coni % 100 = 9 UNION SELECT src FROM b JOIN e ON dst = node WHERE src < dst)"


@query("gt3_between", f"{S}, {EDGE}, {UP} SELECT node FROM f INTERSECT SELECT node FROM b")
def gt3(spark, d, most=2):
    inc = sparse(spark, d, most)[1]
    return G.upward(inc, starts(spark, d, 7, most)).intersect(G.upward(inc, starts(spark, d, 9, most), down=True))


@query("gt5_reachable", f"{S}, {EDGE}, {UP} SELECT count(*) > 0 AS reachable FROM (SELECT node FROM f INTERSECT SELECT DISTINCT coni FROM inc WHERE coni % 100 = 9)")
def gt5(spark, d, most=2):
    found = G.upward(sparse(spark, d, most)[1], starts(spark, d, 7, most))
    return found.join(starts(spark, d, 9, most), "node", "left_semi").agg((F.count("*") > 0).alias("reachable"))


@query("gt6_lightest", f"{S}, {EDGE}, w AS (SELECT DISTINCT coni AS node, 0 AS d FROM inc WHERE coni % 100 = 7 UNION SELECT dst, d + weight FROM w JOIN e ON src = node WHERE d < 60) SELECT node, CAST(min(d) AS BIGINT) AS d FROM w GROUP BY node")
def gt6(spark, d, most=2):
    return G.lightest(arrows(spark, d, most), starts(spark, d, 7, most))


@query("gt7_components", f"{S}, {CC.format(i='inc')} SELECT coni, component FROM cc")
def gt7(spark, d, most=2):
    return G.constraint_components(sparse(spark, d, most)[1])


@query("gt8_linear_clusters", f"{S}, {NONLINEAR}, li AS (SELECT * FROM inc WHERE coni NOT IN (SELECT coni FROM nl)), {CC.format(i='li')} SELECT coni, component FROM cc")
def gt8(spark, d, most=2):
    t, inc = sparse(spark, d, most)
    return G.constraint_components(inc.join(R.nonlinear(t), "coni", "left_anti"))


@query("gt9_product_clusters", f"{D.ACIR_SQL}, p AS (SELECT s1 AS a, s2 AS b FROM acir WHERE kind = 'mul' AND coef < 8), pe AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT DISTINCT a AS x, a AS y FROM pe UNION SELECT x, b FROM r JOIN pe ON a = y) SELECT x AS node, min(y) AS component FROM r GROUP BY x")
def gt9(spark, d):
    return G.components(D.acir(spark, d).where("kind = 'mul' and coef < 8"), "s1", "s2")


@query("gt12_cores", f"{S}, {NONLINEAR}, ni AS (SELECT * FROM inc WHERE coni IN (SELECT coni FROM nl)), {CC.format(i='ni')} SELECT coni, component AS core FROM cc")
def gt12(spark, d, most=2):
    t, inc = sparse(spark, d, most)
    return G.nonlinear_cores(inc, R.nonlinear(t))


CORES = f"{S}, {NONLINEAR}, ni AS (SELECT * FROM inc WHERE coni IN (SELECT coni FROM nl)), {CC.format(i='ni')}, li AS (SELECT * FROM inc WHERE coni NOT IN (SELECT coni FROM nl)), r2 AS (SELECT DISTINCT coni AS x, coni AS y FROM li UNION SELECT r.x, b.coni FROM r2 r JOIN li a ON a.coni = r.y JOIN li b ON a.signal = b.signal), lc AS (SELECT x AS coni, min(y) AS component FROM r2 GROUP BY x)"


@query("gt13_linear_bridges", f"{CORES}, touch AS (SELECT lc.component FROM li JOIN lc USING (coni) JOIN inc n ON n.signal = li.signal JOIN cc ON cc.coni = n.coni GROUP BY 1 HAVING count(DISTINCT cc.component) > 1) SELECT coni, component FROM lc WHERE component IN (SELECT component FROM touch)")
def gt13(spark, d, most=2):
    t, inc = sparse(spark, d, most)
    return G.linear_bridges(inc, R.nonlinear(t))


@query("gt14_grown", f"{S}, {EDGE}, w AS (SELECT DISTINCT coni AS root, coni AS node, 0 AS d FROM inc WHERE coni % 100 = 7 UNION SELECT root, dst, d + 1 FROM w JOIN e ON src = node WHERE src < dst AND d < 2) SELECT DISTINCT root, node FROM w")
def gt14(spark, d, most=2):
    return G.grown(graph(spark, d, most), starts(spark, d, 7, most), 2)


@query("pre1_connected", f"{S}, {CC.format(i='inc')} SELECT coni FROM cc WHERE component IN (SELECT component FROM cc JOIN inc USING (coni) WHERE signal <= 220)")
def pre1(spark, d, most=2):
    inc = sparse(spark, d, most)[1]
    return G.connected_to(inc, inc.where("signal <= 220").select("signal").distinct())


@query("pre2_component_plan", f"{S}, {CC.format(i='inc')}, z AS (SELECT component, count(*) AS size FROM cc GROUP BY 1) SELECT component, size, CASE WHEN component NOT IN (SELECT component FROM cc JOIN inc USING (coni) WHERE signal <= 220) THEN 'drop' WHEN size <= 4 THEN 'whole' ELSE 'cluster' END AS plan FROM z")
def pre2(spark, d, most=2):
    inc = sparse(spark, d, most)[1]
    return G.component_plan(inc, inc.where("signal <= 220").select("signal").distinct(), least=4)


@query("cl5_attracted")
def cl5(spark, d):
    t, inc = sparse(spark, d)
    return G.attracted(inc, R.nonlinear(t))


@query("cl5_attracted_first_ring")
def cl5b(spark, d):
    t, inc = sparse(spark, d)
    return G.attracted(inc, R.nonlinear(t), first_ring=True)


@query("cl6_completed", f"{S}, {NONLINEAR}, ni AS (SELECT * FROM inc WHERE coni IN (SELECT coni FROM nl)), {CC.format(i='ni')} SELECT coni, component AS cluster FROM cc UNION ALL SELECT DISTINCT coni, coni FROM inc WHERE coni NOT IN (SELECT coni FROM nl)")
def cl6(spark, d, most=2):
    t, inc = sparse(spark, d, most)
    return G.completed(inc, G.nonlinear_cores(inc, R.nonlinear(t)).withColumnRenamed("core", "cluster"))


@query("cl8_without_signals", f"{S}, k AS (SELECT * FROM inc WHERE signal % 3 <> 0), {CC.format(i='k')} SELECT coni, component AS cluster FROM cc UNION ALL SELECT DISTINCT coni, coni FROM inc WHERE coni NOT IN (SELECT coni FROM k)")
def cl8(spark, d, most=2):
    inc = sparse(spark, d, most)[1]
    return G.without_signals(inc, inc.where("signal % 3 = 0").select("signal").distinct())


@query("cl9_without_constraints", f"{S}, k AS (SELECT coni AS signal, signal AS coni FROM inc WHERE coni % 3 <> 0), {CC.format(i='k')} SELECT coni AS signal, component AS cluster FROM cc UNION ALL SELECT DISTINCT signal, signal FROM inc WHERE signal NOT IN (SELECT coni FROM k)")
def cl9(spark, d, most=2):
    inc = sparse(spark, d, most)[1]
    return G.without_constraints(inc, inc.where("coni % 3 = 0").select("coni").distinct())


@query("cl11_twice_average_degree", f"{S}, dg AS (SELECT signal, count(*) AS n FROM inc GROUP BY 1), k AS (SELECT * FROM inc WHERE signal IN (SELECT signal FROM dg WHERE n < 2 * (SELECT sum(n) // count(*) FROM dg))), {CC.format(i='k')} SELECT coni, component AS cluster FROM cc UNION ALL SELECT DISTINCT coni, coni FROM inc WHERE coni NOT IN (SELECT coni FROM k)")
def cl11(spark, d, most=2):
    inc = sparse(spark, d, most)[1]
    (mean,) = R.degree_average(inc, "mean").select("value").first()
    return G.without_signals(inc, R.degrees(inc).where(F.col("degree") >= 2 * mean))


@query("cl12_ratio_of_signals")
def cl12(spark, d):
    inc = sparse(spark, d)[1]
    n = inc.select("signal").distinct().count()
    heavy = R.heaviest_signals(inc, 0.36, n)
    return G.without_constraints(inc, inc.join(heavy, "signal", "left_semi").select("coni").distinct())


@query("cl13_without_equalities", f"{D.LINKS_SQL}, inc AS (SELECT coni, signal FROM link WHERE signal <> 0), eq AS (SELECT coni FROM link GROUP BY coni HAVING count(*) = 2 AND bool_and(signal <> 0) AND sum(coef) % 257 = 0), k AS (SELECT coni AS signal, signal AS coni FROM inc WHERE coni NOT IN (SELECT coni FROM eq)), edge AS (SELECT DISTINCT a.coni AS x, b.coni AS y FROM k a JOIN k b USING (signal)), r AS (SELECT DISTINCT x, x AS y FROM edge UNION SELECT r.x, e.y FROM r JOIN edge e ON r.y = e.x) SELECT CAST(x AS BIGINT) AS signal, CAST(min(y) AS BIGINT) AS cluster FROM r GROUP BY x UNION ALL SELECT DISTINCT signal, signal FROM inc WHERE signal NOT IN (SELECT coni FROM k)")
def cl13(spark, d):
    t = D.links(spark, d)
    return G.without_constraints(R.incidence(t), R.equalities(t))


ORACLES.pop("cl13_without_equalities")  # its closure is one component of thousands of signals: too slow in SQL


@query("cl17_inner_edges", f"{S}, {EDGE}, {CC.format(i='inc')} SELECT src, dst, weight FROM e WHERE src < dst AND src % 5 = dst % 5")
def cl17(spark, d, most=2):
    parts = sparse(spark, d, most)[1].select("coni", (F.col("coni") % 5).alias("cluster")).distinct()
    return G.inner_edges(graph(spark, d, most), parts)


MOD = "k AS (SELECT src AS node, sum(weight) AS k FROM e GROUP BY 1), tot AS (SELECT node % 5 AS c, sum(k) AS tot FROM k GROUP BY 1), ins AS (SELECT src % 5 AS c, sum(weight) AS ins FROM e WHERE src < dst AND src % 5 = dst % 5 GROUP BY 1), m AS (SELECT sum(tot) / 2.0 AS m FROM tot)"


@query("cl18_modularity", f"{S}, {EDGE}, {MOD} SELECT CAST(round(sum(coalesce(ins, 0)) / any_value(m) - sum(tot * tot) / (4.0 * any_value(m) * any_value(m)), 6) AS DOUBLE) AS modularity FROM tot LEFT JOIN ins USING (c), m")
def cl18(spark, d, most=2):
    parts = sparse(spark, d, most)[1].select("coni", (F.col("coni") % 5).alias("cluster")).distinct()
    return G.modularity(graph(spark, d, most), parts).select(F.round("modularity", 6).alias("modularity"))


@query("cl1_louvain")
def cl1(spark, d):
    return C.louvain(sparse(spark, d)[1])


@query("cl4_resolution", f"{S}, {EDGE}, z AS (SELECT CAST(sum(weight) AS DOUBLE) AS m2 FROM e) SELECT 'expected' AS rule, m2 / 10000.0 AS value FROM z UNION ALL SELECT 'log2', round(m2 / power(log2(m2 / 2), 2), 6) FROM z")
def cl4(spark, d, most=2):
    m2 = arrows(spark, d, most).agg(F.sum("weight").cast("double").alias("m2"))
    rules = F.array(F.struct(F.lit("expected").alias("rule"), (F.col("m2") / 10000).alias("value")), F.struct(F.lit("log2").alias("rule"), F.round(F.col("m2") / F.pow(F.log2(F.col("m2") / 2), 2), 6).alias("value")))
    return m2.select(F.inline(rules))


@query("cl16_labels")
def cl16(spark, d):
    return W.propagated(sparse(spark, d)[1])


ROUND = "SELECT src AS node, label, sum(weight) AS w FROM (SELECT src, {old}.label, weight FROM e JOIN {old} ON {old}.node = e.dst UNION ALL SELECT node, label, 1 FROM {old}) GROUP BY 1, 2"


@query("cl16_labels_two_rounds", f"{S}, {EDGE}, l0 AS (SELECT DISTINCT src AS node, src AS label FROM e), l1 AS (SELECT node, label FROM ({ROUND.format(old='l0')}) QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, label) = 1), l2 AS (SELECT node, label FROM ({ROUND.format(old='l1')}) QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, label) = 1) SELECT * FROM l2")
def cl16b(spark, d, most=2):
    return W.propagated(sparse(spark, d, most)[1], rounds=2)


def ordered(spark, d):
    """(constraints, parts, keyed, inputs, outputs); line items are dealt out once, by constraint."""
    cons = cut(R.constraints(D.terms(spark, d, together=True)))
    hard = F.col("nonlinear") & F.col("coni").isNotNull()
    cores = G.set_components(cons.where(hard).select("coni", "signals"))
    own = cons.where(~hard).select("coni", F.col("coni").alias("component"), "signals")
    whole = own.unionByName(cons.where(hard).join(cores, "coni").select("coni", "component", "signals"))
    held = whole.select("coni", F.col("component").alias("part_id"), F.explode("signals").alias("signal")).where("coni is not null")
    parts = own.select("coni", "component").union(cores).select("coni", F.col("component").alias("part_id"))
    s = cut(cons.where("coni is not null").select(F.explode("signals").alias("signal")).where("signal % 10 in (1, 2)").distinct())
    inputs, outputs = s.where("signal % 10 = 1"), s.where("signal % 10 = 2")
    return cons, *G.order_of_parts(None, parts, inputs, outputs, held.select("signal", "part_id")), inputs, outputs


def dag(spark, d):
    """(constraints, parts, keyed, arcs, inputs, outputs)"""
    cons, parts, keyed, inputs, outputs = ordered(spark, d)
    return cons, parts, keyed, G.arcs_of(keyed), inputs, outputs


def nodes(spark, d):
    return G.node_table(*ordered(spark, d)[2:])


@query("dg1_layers")
def dg1(spark, d):
    return dag(spark, d)[1]


@query("dg1_arcs")
def dg1b(spark, d):
    return dag(spark, d)[3]


@query("dg3_nodes")
def dg3(spark, d):
    return nodes(spark, d)


@query("dg6_passthrough")
def dg6(spark, d):
    return G.passthrough(nodes(spark, d))
