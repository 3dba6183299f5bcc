"""Queries and their SQL: refinement, equivalence, simplification, lowering, verification, files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.field import Field
from ..operators import graph as G
from ..operators import lower as L
from ..operators import normalise as N
from ..operators import refine as X
from ..operators import relational as R
from ..operators import simplify as S
from ..operators import verify as V
from ..operators import votes as W
from ..sources import derived as D
from ..sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FIELD = Field(257)
T, SP, LK, AC = D.TERMS_SQL, D.SPARSE_SQL, D.LINKS_SQL, D.ACIR_SQL
INV = "inv AS (SELECT a.range AS x, b.range AS y FROM range(1, 257) a, range(1, 257) b WHERE a.range * b.range % 257 = 1)"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {sql}"
        return f

    return put


def plain(spark, d, most=None):
    """The sparse system with all coefficients 1, where refinement goes deep."""
    return D.terms(spark, d, most).withColumn("coef", F.lit(1).cast("long"))


SLOT = "ord AS (SELECT coni, coalesce(list_sort(list(coef) FILTER (part = 'A')), []) <> coalesce(list_sort(list(coef) FILTER (part = 'B')), []) AS o FROM pt GROUP BY 1), slot AS (SELECT coni, signal, CASE WHEN any_value(o) THEN string_agg(part || coef, ',' ORDER BY part, coef) ELSE coalesce(string_agg(CAST(coef AS VARCHAR), '+' ORDER BY coef) FILTER (part <> 'C'), '') || '|' || coalesce(CAST(max(coef) FILTER (part = 'C') AS VARCHAR), '-') END AS s FROM pt JOIN ord USING (coni) GROUP BY 1, 2)"


def _rounds(n: int) -> str:
    out = "s0 AS (SELECT DISTINCT signal, CAST(0 AS BIGINT) AS c FROM slot), c0 AS (SELECT DISTINCT coni, CAST(0 AS BIGINT) AS c FROM slot)"
    for i in range(1, n + 1):
        out += f", ck{i} AS (SELECT coni, any_value(c{i - 1}.c) || '#' || string_agg(s{i - 1}.c || ':' || s, ';' ORDER BY s{i - 1}.c || ':' || s) AS k FROM slot JOIN s{i - 1} USING (signal) JOIN c{i - 1} USING (coni) GROUP BY 1), c{i} AS (SELECT coni, min(coni) OVER (PARTITION BY k) AS c FROM ck{i}), sk{i} AS (SELECT signal, any_value(s{i - 1}.c) || '#' || string_agg(c{i}.c || ':' || s, ';' ORDER BY c{i}.c || ':' || s) AS k FROM slot JOIN c{i} USING (coni) JOIN s{i - 1} USING (signal) GROUP BY 1), s{i} AS (SELECT signal, min(signal) OVER (PARTITION BY k) AS c FROM sk{i})"
    return out


ONES = f"{SP}, pt AS (SELECT coni, part, signal, 1 AS coef FROM term), {SLOT}"


@query("fp1_constraint_colours", f"{ONES}, {_rounds(8)} SELECT coni, c AS color FROM c8")
def fp1(spark, d, most=2):
    return X.refined(plain(spark, d, most))[0]


@query("fp1_signal_colours", f"{ONES}, {_rounds(8)} SELECT signal, c AS color FROM s8")
def fp1b(spark, d, most=2):
    return X.refined(plain(spark, d, most))[1]


@query("fp1_one_round", f"{T}, pt AS (SELECT * FROM term), {SLOT}, {_rounds(1)} SELECT coni, c AS color FROM c1")
def fp1c(spark, d):
    return X.refined(D.terms(spark, d), most=1)[0]


@query("fp6_slots", f"{T}, pt AS (SELECT * FROM term), {SLOT} SELECT coni, count(DISTINCT s) AS slots FROM slot GROUP BY coni")
def fp6(spark, d):
    return X.slots(D.terms(spark, d)).groupBy("coni").agg(F.countDistinct("slot").alias("slots"))


def successors(spark, d, most=None):
    inc = R.incidence(D.terms(spark, d, most))
    return R.shared_signals(inc).select("src", "dst"), inc.select(F.col("coni").alias("node"), F.lit(0).cast("long").alias("color")).distinct()


ARCS = f"{SP}, e AS (SELECT DISTINCT a.coni AS src, b.coni AS dst FROM term a JOIN term b ON a.signal = b.signal AND a.coni < b.coni), n0 AS (SELECT DISTINCT coni AS node, 0 AS c FROM term)"


def _arc_rounds(n: int) -> str:
    out = ""
    for i in range(1, n + 1):
        out += f", k{i} AS (SELECT n.node, any_value(n.c) || '#' || coalesce(string_agg(CAST(f.c AS VARCHAR), ',' ORDER BY f.c), '') AS k FROM n{i - 1} n LEFT JOIN e ON e.src = n.node LEFT JOIN n{i - 1} f ON f.node = e.dst GROUP BY 1), n{i} AS (SELECT node, min(node) OVER (PARTITION BY k) AS c FROM k{i})"
    return out


@query("fp12_successor_colours", f"{ARCS}{_arc_rounds(12)} SELECT node, c AS color FROM n12")
def fp12(spark, d, most=2):
    return W.successor_colors(R.incidence(D.terms(spark, d, most)))


@query("fp14_signal_roles", f"{D.SIGNALS_SQL} SELECT role, count(*) AS n FROM sig GROUP BY role")
def fp14(spark, d):
    return D.signals(spark, d).groupBy("role").agg(F.count("*").alias("n"))


def cores(spark, d):
    t = plain(spark, d)
    inc = R.incidence(t)
    return G.constraint_components(inc).withColumnRenamed("component", "part_id"), t


@query("eq9_equal_shapes")
def eq9(spark, d):
    return X.equal_shapes(*cores(spark, d))


@query("eq10_equivalent_parts")
def eq10(spark, d):
    return X.equivalent_parts(*cores(spark, d))


def renamed(terms):
    """The system under names that SQL can give too; which of two factors comes first changes with them."""
    swap = F.col("coni") % 2 == 1
    part = F.when(swap & (F.col("part") == "A"), "B").when(swap & (F.col("part") == "B"), "A").otherwise(F.col("part"))
    signal = F.when(F.col("signal") == 0, F.lit(0).cast("long")).otherwise(3 * F.col("signal") + 5)
    return terms.select((5 * F.col("coni") + 2).alias("coni"), part.alias("part"), signal.alias("signal"), "coef")


def _same(left, right):
    """(alike, left_signal, right_signal): the mapping found, or one row without signals."""
    first = lambda t: N.norms(t).where("choice = 1").select("coni", "part", "signal", "coef")
    got = {"result": False} if X.surely_different(left, right, FIELD) else X.same_system(first(left), first(right))
    if got["result"]:
        return got["signals"].select(F.lit(True).alias("alike"), "left_signal", "right_signal")
    return left.sparkSession.createDataFrame([(got["result"], None, None)], "alike boolean, left_signal long, right_signal long")


@query("eq1_shuffled_system", f"{T} SELECT DISTINCT true AS alike, signal AS left_signal, 3 * signal + 5 AS right_signal FROM term WHERE signal <> 0")
def eq1(spark, d):
    t = D.terms(spark, d)
    return _same(t, renamed(t))


@query("eq1_changed_coefficient", "r AS (SELECT false AS alike, CAST(NULL AS BIGINT) AS left_signal, CAST(NULL AS BIGINT) AS right_signal) SELECT * FROM r")
def eq1b(spark, d):
    """One coefficient of one part with several differs, so that no scaling makes up for it: there is no mapping."""
    t = D.terms(spark, d)
    several = t.groupBy("coni", "part").agg(F.count("*").alias("n"), F.min("signal").alias("signal")).where("n > 1")
    one = several.agg(F.min(F.struct("coni", "signal", "part")).alias("m")).select("m.*").withColumn("more", F.lit(1))
    changed = t.join(F.broadcast(one), ["coni", "signal", "part"], "left").select("coni", "part", "signal", F.when(F.col("more") == 1, F.col("coef") % 256 + 1).otherwise(F.col("coef")).alias("coef"))
    return _same(t, renamed(changed))


@query("sub1_size_classes", f"{SP}, z AS (SELECT coni, count(*) AS n FROM term GROUP BY 1), v AS (SELECT n, CASE WHEN lag(n) OVER (ORDER BY n) IS NULL OR NOT (n - lag(n) OVER (ORDER BY n) <= 1 OR lag(n) OVER (ORDER BY n) >= 0.8 * n) THEN n END AS s FROM (SELECT DISTINCT n FROM z)), g AS (SELECT n, max(s) OVER (ORDER BY n) AS class_size FROM v) SELECT coni, CAST(class_size AS BIGINT) AS class_size FROM z JOIN g USING (n)")
def sub1(spark, d, most=2):
    from pyspark.sql import Window

    sizes = D.terms(spark, d, most).groupBy("coni").agg(F.count("*").alias("n"))
    w = Window.orderBy("n")
    steps = sizes.select("n").distinct().withColumn("before", F.lag("n").over(w))
    start = F.when(F.col("before").isNull() | ~((F.col("n") - F.col("before") <= 1) | (F.col("before") >= 0.8 * F.col("n"))), F.col("n"))
    groups = steps.select("n", F.max(start).over(w).alias("class_size"))
    return sizes.join(groups, "n").select("coni", "class_size")


# --- simplification -----------------------------------------------------------------------------------------


def equality_subs(spark, d):
    t = D.links(spark, d)
    forbidden = t.where("signal > 0 and signal % 10 = 0").select("signal").distinct()
    return S.merged_equalities(t, R.equalities(t), forbidden)


EQ = f"{LK}, eq AS (SELECT coni, min(signal) AS a, max(signal) AS b FROM link GROUP BY coni HAVING count(*) = 2 AND bool_and(signal <> 0) AND sum(coef) % 257 = 0)"


@query("sb21_equalities")
def sb21(spark, d):
    return equality_subs(spark, d)[0]


@query("sb21_equalities_left")
def sb21b(spark, d):
    return equality_subs(spark, d)[1]


SUBS = "sub AS (SELECT s AS from_sig, t AS signal, k AS coef FROM (SELECT DISTINCT signal AS s, signal + 1 AS t, 3 AS k FROM term WHERE signal % 4 = 0 UNION ALL SELECT DISTINCT signal, 0, 5 FROM term WHERE signal % 4 = 0))"


def subs_of(t):
    own = t.where("signal > 0 and signal % 4 = 0").select("signal").distinct()
    pair = F.array(F.struct((F.col("signal") + 1).alias("to"), F.lit(3).cast("long").alias("coef")), F.struct(F.lit(0).cast("long").alias("to"), F.lit(5).cast("long").alias("coef")))
    return own.select(F.col("signal").alias("from_sig"), F.inline(pair)).withColumnRenamed("to", "signal")


@query("sb3_substituted", f"{T}, {SUBS} SELECT coni, part, coalesce(sub.signal, term.signal) AS signal, CAST(sum(term.coef * coalesce(sub.coef, 1)) % 257 AS BIGINT) AS coef FROM term LEFT JOIN sub ON term.signal = from_sig GROUP BY 1, 2, 3 HAVING sum(term.coef * coalesce(sub.coef, 1)) % 257 <> 0")
def sb3(spark, d):
    t = D.terms(spark, d)
    return S.substituted(t, subs_of(t), FIELD)


@query("sb1_sound_substitutions", f"{T}, {SUBS} SELECT * FROM sub WHERE from_sig NOT IN (SELECT from_sig FROM sub WHERE from_sig = signal)")
def sb1(spark, d):
    return S.substitutions_ok(subs_of(D.terms(spark, d)))


@query(
    "sb4_substituted_products",
    f"{AC}, term AS (SELECT s1 AS signal FROM acir UNION SELECT s2 FROM acir WHERE s2 IS NOT NULL), {SUBS}, a AS (SELECT coni, CASE kind WHEN 'lin' THEN 0 ELSE s1 END AS x, CASE kind WHEN 'lin' THEN s1 ELSE s2 END AS y, coef FROM acir), b AS (SELECT coni, coalesce(signal, x) AS x, y, a.coef * coalesce(sub.coef, 1) AS coef FROM a LEFT JOIN sub ON x = from_sig), c AS (SELECT coni, x, coalesce(signal, y) AS y, b.coef * coalesce(sub.coef, 1) AS coef FROM b LEFT JOIN sub ON y = from_sig) SELECT coni, CASE WHEN least(x, y) = 0 THEN 'lin' ELSE 'mul' END AS kind, CASE WHEN least(x, y) = 0 THEN greatest(x, y) ELSE least(x, y) END AS s1, CASE WHEN least(x, y) <> 0 THEN greatest(x, y) END AS s2, CAST(sum(coef) % 257 AS BIGINT) AS coef FROM c GROUP BY coni, least(x, y), greatest(x, y) HAVING sum(coef) % 257 <> 0",
)
def sb4(spark, d):
    a = D.acir(spark, d)
    sig = R.acir_incidence(a).select("signal").distinct()
    return S.substituted_products(a, subs_of(sig), FIELD)


@query("sb7_solved", f"{LK}, {INV}, pv AS (SELECT coni, max(signal) AS from_sig FROM link WHERE signal <> 0 GROUP BY 1), ld AS (SELECT coni, from_sig, y FROM pv JOIN link USING (coni) JOIN inv ON inv.x = link.coef WHERE link.signal = from_sig) SELECT coni, from_sig, signal, (257 - coef * y % 257) % 257 AS coef FROM link JOIN ld USING (coni) WHERE signal <> from_sig")
def sb7(spark, d):
    t = D.links(spark, d)
    return S.solved_for(t, R.greatest_signal(t), FIELD)


@query(
    "sb10_fixed_constraints",
    f"{SP}, f AS (SELECT coni, bool_or(part = 'A') AS a, bool_or(part = 'B') AS b FROM term GROUP BY 1) SELECT coni, part, signal, coef FROM term JOIN f USING (coni) WHERE part = 'C' OR (a AND b)",
)
def sb10(spark, d, most=2):
    return S.fixed_constraints(D.terms(spark, d, most), FIELD)


@query("sb22_constants", f"{LK}, {INV}, low AS (SELECT * FROM link WHERE signal < 2000), c AS (SELECT coni, max(signal) AS s, arg_max(coef, signal) AS lead, coalesce(max(coef) FILTER (signal = 0), 0) AS k FROM low GROUP BY 1 HAVING max(signal) > 0), o AS (SELECT s, arg_min(lead, coni) AS lead, arg_min(k, coni) AS k FROM c WHERE s % 10 <> 0 GROUP BY 1) SELECT s AS from_sig, CAST(0 AS BIGINT) AS signal, (257 - k * y % 257) % 257 AS coef FROM o JOIN inv ON x = lead")
def sb22(spark, d):
    t = D.links(spark, d).where("signal < 2000")
    forbidden = t.where("signal > 0 and signal % 10 = 0").select("signal").distinct()
    return S.constant_substitutions(t, R.constant_equalities(t), forbidden, FIELD)


def small_links(spark, d):
    return D.terms(spark, d).where("part = 'C'")


@query("sb14_elimination")
def sb14(spark, d):
    t = small_links(spark, d)
    return S.linear_elimination(t.select("coni", "signal", "coef"), t.where("signal % 5 = 0").select("signal").distinct())


@query("sb15_sparse_elimination")
def sb15(spark, d):
    t = small_links(spark, d)
    return S.linear_elimination(t.select("coni", "signal", "coef"), t.where("signal % 5 = 0").select("signal").distinct(), sparse=True)


@query("sb25_simplified")
def sb25(spark, d):
    t = D.terms(spark, d)
    return S.simplified(t, t.where("signal % 5 = 0").select("signal").distinct())


@query("sb26_simplified_plonk")
def sb26(spark, d):
    t = D.terms(spark, d)
    return S.simplified(t, t.where("signal % 5 = 0").select("signal").distinct(), plonk=True)


# --- lowering -----------------------------------------------------------------------------------------------

NAIVE = f"{AC}, m AS (SELECT *, row_number() OVER (PARTITION BY coni ORDER BY s1, s2) AS turn FROM acir WHERE kind = 'mul'), top AS (SELECT max(coni) AS tc, max(greatest(s1, coalesce(s2, 0))) AS ts FROM acir), aux AS (SELECT s1, s2, row_number() OVER (ORDER BY s1, s2) AS r FROM (SELECT DISTINCT s1, s2 FROM m WHERE turn > 1)), ax AS (SELECT s1, s2, ts + r AS aux, tc + r AS own FROM aux, top)"


@query("tr1_naive_products", f"{NAIVE} SELECT coni, 'A' AS part, s1 AS signal, coef FROM m WHERE turn = 1 UNION ALL SELECT coni, 'B', s2, 1 FROM m WHERE turn = 1 UNION ALL SELECT coni, 'C', aux, 257 - coef FROM m JOIN ax USING (s1, s2) WHERE turn > 1 UNION ALL SELECT coni, 'C', s1, 257 - coef FROM acir WHERE kind = 'lin' UNION ALL SELECT own, 'A', s1, 1 FROM ax UNION ALL SELECT own, 'B', s2, 1 FROM ax UNION ALL SELECT own, 'C', aux, 1 FROM ax")
def tr1(spark, d):
    return L.naive_products(D.acir(spark, d), FIELD)


HUB = f"{AC}, m AS (SELECT * FROM acir WHERE kind = 'mul'), v AS (SELECT coni, s, count(*) AS n FROM (SELECT coni, s1 AS s FROM m UNION ALL SELECT coni, s2 FROM m WHERE s1 <> s2) GROUP BY 1, 2), h AS (SELECT coni, s AS hub FROM v QUALIFY row_number() OVER (PARTITION BY coni ORDER BY n DESC, s) = 1)"


@query("tr2_star_products", f"{HUB} SELECT coni, 'A' AS part, hub AS signal, CAST(1 AS BIGINT) AS coef FROM h UNION ALL SELECT coni, 'B', CASE WHEN s1 = hub THEN s2 ELSE s1 END, coef FROM m JOIN h USING (coni) WHERE hub IN (s1, s2)")
def tr2(spark, d):
    return L.star_products(D.acir(spark, d))[0]


@query("tr2_residual_products", f"{HUB} SELECT coni, s1, s2, coef FROM m JOIN h USING (coni) WHERE hub NOT IN (s1, s2)")
def tr2b(spark, d):
    return L.star_products(D.acir(spark, d))[1]


@query("tr13_short_linear", f"{LK} SELECT coni, part, signal, coef FROM link WHERE coni IN (SELECT coni FROM link GROUP BY coni HAVING count(*) FILTER (signal <> 0) <= 3)")
def tr13(spark, d):
    return L.short_linear(D.links(spark, d))[0]


@query("tr14_plonk_rows", f"{LK}, k AS (SELECT coni, signal, coef, row_number() OVER (PARTITION BY coni ORDER BY signal) AS k FROM link WHERE signal <> 0) SELECT coni, max(signal) FILTER (k = 1) AS s_a, max(coef) FILTER (k = 1) AS coef_a, max(signal) FILTER (k = 2) AS s_b, max(coef) FILTER (k = 2) AS coef_b, max(signal) FILTER (k = 3) AS s_c, max(coef) FILTER (k = 3) AS coef_c, coalesce((SELECT coef FROM link z WHERE z.signal = 0 AND z.coni = k.coni), 0) AS coef_cte FROM k GROUP BY coni")
def tr14(spark, d):
    return L.plonk_rows(D.links(spark, d))


@query("tr10_chained_linear")
def tr10(spark, d):
    lin = D.acir(spark, d).select("coni", F.col("s1").alias("signal"), "coef")
    return L.chained_linear(lin)


# --- verification -------------------------------------------------------------------------------------------


def squares(spark, d):
    """(x - a)(x - b) = 0 from orders, some twice over one signal."""
    o = D.table(spark, d, "orders")
    k = F.col("o_orderkey").cast("long")
    rows = F.array(*(F.struct(F.lit(p).alias("part"), s.alias("signal"), c.cast("long").alias("coef")) for p, s, c in (("A", k % 700 + 1, F.lit(1)), ("A", F.lit(0).cast("long"), 256 - k % 90), ("B", k % 700 + 1, F.lit(1)), ("B", F.lit(0).cast("long"), 256 - k % 90 - k % 3))))
    return o.select(k.alias("coni"), F.inline(rows)).where("coef <> 0")


DOM = "q AS (SELECT CAST(o_orderkey AS BIGINT) AS coni, o_orderkey % 700 + 1 AS signal, o_orderkey % 90 + 1 AS lo, o_orderkey % 90 + 1 + o_orderkey % 3 AS hi FROM orders)"


@query("vf1_domains", f"{DOM} SELECT coni, signal, lo, hi, hi - lo <= 1 AS binary FROM q")
def vf1(spark, d):
    return V.domains(squares(spark, d), FIELD)


@query("vf6_tightened", f"{DOM} SELECT signal, max(lo) AS lo, min(hi) AS hi FROM q GROUP BY signal")
def vf6(spark, d):
    return V.tightened(V.domains(squares(spark, d), FIELD))


@query(
    "vf3_linear_bounds",
    f"{SP}, b AS (SELECT signal, max(lo) AS lo, min(hi) AS hi FROM ({DOM.replace('q AS (', '')} GROUP BY signal), t AS (SELECT coni, part, term.signal, CASE WHEN coef >= 129 THEN coef - 257 ELSE coef END AS c, coalesce(lo, 0) AS lo, coalesce(hi, 256) AS hi FROM term LEFT JOIN b USING (signal)) SELECT coni, part, CAST(sum(CASE WHEN c >= 0 THEN c * lo ELSE c * hi END) AS BIGINT) AS lo, CAST(sum(CASE WHEN c >= 0 THEN c * hi ELSE c * lo END) AS BIGINT) AS hi FROM t GROUP BY 1, 2",
)
def vf3(spark, d, most=2):
    return V.linear_bounds(D.terms(spark, d, most), V.tightened(V.domains(squares(spark, d), FIELD)), FIELD)


def chained(spark, d):
    """Squares as above, and for each a line x - y - 3 = 0 to a signal of its own, which no square bounds."""
    k = F.col("o_orderkey").cast("long")
    rows = F.array(*(F.struct(F.lit("C").alias("part"), s.alias("signal"), F.lit(c).cast("long").alias("coef")) for s, c in ((k % 700 + 1, 1), (k % 700 + 1001, 256), (F.lit(0).cast("long"), 254))))
    lines = D.table(spark, d, "orders").select((-k - 1).alias("coni"), F.inline(rows))
    return squares(spark, d).unionByName(lines)


# y = x - 3 where that stays within the field's integers; a y below 0 says nothing, but bounds of x from y = x - 3 <= 253 hold none
@query(
    "vf8_deduced_bounds",
    f"{DOM}, b AS (SELECT signal, max(lo) AS lo, min(hi) AS hi FROM q GROUP BY signal) SELECT signal, lo, hi FROM b UNION ALL SELECT signal + 1000, lo - 3, hi - 3 FROM b WHERE lo >= 3 AND hi >= lo",
)
def vf8(spark, d):
    return V.deduced_bounds(chained(spark, d), FIELD)


@query("vf10_determined")
def vf10(spark, d):
    t = D.terms(spark, d)
    return V.determined(t, t.where("signal % 3 <> 0").select("signal").distinct())


def checked(spark, d):
    t = D.terms(spark, d)
    inc = R.incidence(t)
    parts = G.constraint_components(inc).withColumnRenamed("component", "part_id")
    held = inc.join(parts, "coni").select("part_id", "signal").distinct()
    roles = held.withColumn("role", F.when(F.col("signal") % 3 == 0, "out").when(F.col("signal") % 3 == 1, "in")).where("role is not null")
    return V.verdicts(t, parts, roles)


@query("vf11_verdicts")
def vf11(spark, d):
    return checked(spark, d)


@query("snk8_report")
def snk8(spark, d):
    return V.report(checked(spark, d))


# --- files --------------------------------------------------------------------------------------------------


@query("src9_json_round_trip", f"{AC} SELECT coni % 20 AS circuit_id, dense_rank() OVER (PARTITION BY coni % 20 ORDER BY coni) - 1 AS coni, kind, s1, s2, CAST(coef AS VARCHAR) AS coef FROM acir")
def src9(spark, d):
    a = D.acir(spark, d).withColumn("circuit_id", F.col("coni") % 20)
    return files.terms_of_systems(files.systems_of_terms(a)).select("circuit_id", F.col("coni").cast("long").alias("coni"), "kind", "s1", "s2", "coef")


@query("snk3_node_records", f"{SP}, p AS (SELECT DISTINCT coni, coni % 50 AS n FROM term WHERE signal <> 0) SELECT n AS node_id, len(list(coni)) AS constraints FROM p GROUP BY n")
def snk3(spark, d, most=2):
    t = D.terms(spark, d, most)
    inc, parts = R.incidence(t), t.select("coni", (F.col("coni") % 50).alias("part_id")).distinct()
    arcs = R.part_neighbours(inc, parts)
    rows = files.node_records(parts, inc, R.arc_signals(inc, parts, arcs), arcs)
    got = F.from_json("json", "struct<constraints: array<bigint>>")
    return rows.select("node_id", F.size(got["constraints"]).cast("long").alias("constraints"))


@query("snk10_dot", f"{SP}, e AS (SELECT DISTINCT a.coni AS src, b.coni AS dst FROM term a JOIN term b ON a.signal = b.signal AND a.coni < b.coni) SELECT src || ' -> ' || dst || ';' AS line FROM e")
def snk10(spark, d, most=2):
    return files.dot_rows(R.shared_signals(R.incidence(D.terms(spark, d, most))))
