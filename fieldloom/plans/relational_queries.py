"""Queries and their SQL: predicates, projections, joins, groupings, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources import derived as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T, S, L, A, G = D.TERMS_SQL, D.SPARSE_SQL, D.LINKS_SQL, D.ACIR_SQL, D.SIGNALS_SQL
INC = "inc AS (SELECT DISTINCT coni, signal FROM term WHERE signal <> 0)"
PROFILE = """prof AS (SELECT coni, count(*) FILTER (part = 'A') AS n_a, count(*) FILTER (part = 'B') AS n_b,
  count(*) FILTER (part = 'C' AND signal <> 0) AS n_signals, count(*) FILTER (part = 'C' AND signal = 0) AS n_const,
  bool_or(signal = 0) AS has_const, coalesce(sum(coef) FILTER (part = 'C' AND signal <> 0), 0) % 257 AS sum_c FROM {t} GROUP BY coni)"""
LINKS = f"{L}, {PROFILE.format(t='link')}"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def inc(spark: SparkSession, d: str) -> DataFrame:
    return R.incidence(D.terms(spark, d))


@query("prd1_signals", f"WITH {T}, {INC} SELECT * FROM inc")
def prd1(spark, d):
    return inc(spark, d)


@query("prd2_acir_signals", f"WITH {A} SELECT DISTINCT coni, s1 AS signal FROM acir UNION SELECT coni, s2 FROM acir WHERE s2 IS NOT NULL")
def prd2(spark, d):
    return R.acir_incidence(D.acir(spark, d))


@query("prd3_product_signals", f"WITH {A} SELECT DISTINCT coni, s1 AS signal FROM acir WHERE kind = 'mul' UNION SELECT coni, s2 FROM acir WHERE kind = 'mul'")
def prd3(spark, d):
    return R.acir_incidence(D.acir(spark, d), "mul")


@query("prd4_nonlinear", f"WITH {T} SELECT coni FROM term GROUP BY coni HAVING bool_or(part = 'A') AND bool_or(part = 'B')")
def prd4(spark, d):
    return R.nonlinear(D.terms(spark, d))


@query("prd5_acir_nonlinear", f"WITH {A} SELECT DISTINCT coni FROM acir WHERE kind = 'mul'")
def prd5(spark, d):
    return R.acir_nonlinear(D.acir(spark, d))


@query("prd5_acir_linear", f"WITH {A} SELECT coni FROM acir GROUP BY coni HAVING NOT bool_or(kind = 'mul')")
def prd5b(spark, d):
    return R.acir_linear(D.acir(spark, d))


@query("prd6_empty", f"WITH {T} SELECT CAST(o_orderkey AS BIGINT) AS coni FROM orders WHERE o_orderkey NOT IN (SELECT coni FROM term)")
def prd6(spark, d):
    return R.empty(D.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("coni")), D.terms(spark, d))


@query("prd7_roles", f"WITH {G} SELECT signal, role FROM sig")
def prd7(spark, d):
    return D.signals(spark, d)


@query("prd8_equalities", f"WITH {LINKS} SELECT coni FROM prof WHERE (n_a = 0 OR n_b = 0) AND n_signals = 2 AND n_const = 0 AND sum_c = 0")
def prd8(spark, d):
    return R.equalities(D.links(spark, d))


@query("prd9_constant_equalities", f"WITH {LINKS} SELECT coni FROM prof WHERE (n_a = 0 OR n_b = 0) AND n_signals = 1")
def prd9(spark, d):
    return R.constant_equalities(D.links(spark, d).where("signal < 2000"))


ORACLES["prd9_constant_equalities"] = f"WITH {L}, low AS (SELECT * FROM link WHERE signal < 2000), {PROFILE.format(t='low')} SELECT coni FROM prof WHERE (n_a = 0 OR n_b = 0) AND n_signals = 1"


@query("prd10_constant_expressions", f"WITH {L}, low AS (SELECT * FROM link WHERE signal = 0), {PROFILE.format(t='low')} SELECT coni FROM prof WHERE n_signals = 0 AND n_const = 1")
def prd10(spark, d):
    return R.constant_expressions(D.links(spark, d).where("signal = 0"))


RELAXED = f"WITH {L} SELECT coni FROM link WHERE signal <> 0 GROUP BY coni HAVING count(*) = 2 AND (min(coef) = max(coef) OR min(coef) + max(coef) = 257)"


@query("prd12_relaxed_equalities", RELAXED)
def prd12(spark, d):
    return R.relaxed_equalities(D.links(spark, d))


@query(
    "prd13_coefficient_links",
    f"WITH {L} SELECT coni, n = 2 AND k = 2 AS link, k > 0 AS candidate FROM (SELECT coni, count(*) FILTER (signal <> 0) AS n, count(*) FILTER (signal <> 0 AND coef IN (1, 256)) AS k FROM link GROUP BY coni)",
)
def prd13(spark, d):
    return R.coefficient_links(D.links(spark, d), [1, 256])


@query("prd14_plonk_ready", f"WITH {LINKS} SELECT coni FROM prof WHERE (n_a = 0 OR n_b = 0) AND n_signals <= 2")
def prd14(spark, d):
    return R.plonk_ready(D.links(spark, d))


@query("prd15_with_constant", f"WITH {LINKS} SELECT coni FROM prof WHERE has_const")
def prd15(spark, d):
    return R.with_constant(D.links(spark, d))


@query("prd16_ordered_factors", f"WITH {T} SELECT coni, coalesce(list_sort(list(coef) FILTER (part = 'A')), []) <> coalesce(list_sort(list(coef) FILTER (part = 'B')), []) AS ordered FROM term GROUP BY coni")
def prd16(spark, d):
    return R.ordered_factors(D.terms(spark, d))


@query(
    "prd17_kinds",
    f"WITH {LINKS}, k AS (SELECT coni, count(*) FILTER (part = 'C' AND signal <> 0 AND coef = 1) AS ones FROM link GROUP BY coni) SELECT coni, CASE WHEN n_a > 0 AND n_b > 0 THEN 'quadratic' WHEN n_signals = 0 THEN 'number' WHEN n_signals = 1 AND n_const = 0 AND ones = 1 THEN 'signal' ELSE 'linear' END AS kind FROM prof JOIN k USING (coni)",
)
def prd17(spark, d):
    return R.kinds(D.links(spark, d))


@query("prd18_coefficients", f"WITH {T} SELECT coni, part, string_agg(CAST(coef AS VARCHAR), ',' ORDER BY coef) AS coefs FROM term GROUP BY coni, part")
def prd18(spark, d):
    return R.coefficients(D.terms(spark, d))


@query("prd19_used_signals", f"WITH {T} SELECT DISTINCT signal FROM term WHERE signal <> 0")
def prd19(spark, d):
    return inc(spark, d).select("signal").distinct()


@query("prd21_offset", f"WITH {L} SELECT coni, part, CAST(CASE WHEN signal = 0 THEN 0 ELSE signal + 7 END AS BIGINT) AS signal, coef FROM link")
def prd21(spark, d):
    return R.offset(D.links(spark, d), 7)


@query("prd21_renamed", f"WITH {T}, {G} SELECT coni, part, n.signal, coef FROM term t JOIN (SELECT signal AS old, signal * 2 AS signal FROM sig WHERE role <> 'internal') n ON t.signal = n.old")
def prd21b(spark, d):
    mapping = D.signals(spark, d).where("role <> 'internal'").select(F.col("signal").alias("old"), (F.col("signal") * 2).alias("new"))
    return R.renamed(D.terms(spark, d), mapping)


NUMBERED = "num AS (SELECT signal AS old, row_number() OVER (ORDER BY CASE role WHEN 'output' THEN 0 WHEN 'input' THEN 1 ELSE 2 END, signal) AS new FROM {of})"


@query(
    "prd22_subcircuit",
    f"WITH {T}, {G}, sub AS (SELECT * FROM term WHERE coni % 10 = 3), used AS (SELECT * FROM sig WHERE signal IN (SELECT signal FROM sub)), {NUMBERED.format(of='used')} SELECT coni, part, new AS signal, coef FROM sub JOIN num ON signal = old",
)
def prd22(spark, d):
    t = D.terms(spark, d)
    return R.subcircuit(t, t.where("coni % 10 = 3").select("coni").distinct(), D.signals(spark, d))


@query("jn1_holders", f"WITH {T}, {INC} SELECT signal, string_agg(CAST(coni AS VARCHAR), ',' ORDER BY coni) AS conis FROM inc GROUP BY signal")
def jn1(spark, d):
    return R.holders(inc(spark, d))


@query("jn2_nonlinear_holders", f"WITH {A}, i AS (SELECT DISTINCT coni, s1 AS signal FROM acir UNION SELECT coni, s2 FROM acir WHERE s2 IS NOT NULL) SELECT signal, string_agg(CAST(coni AS VARCHAR), ',' ORDER BY coni) AS conis FROM i WHERE coni IN (SELECT coni FROM acir WHERE kind = 'mul') GROUP BY signal")
def jn2(spark, d):
    a = D.acir(spark, d)
    return R.holders(R.acir_incidence(a).join(R.acir_nonlinear(a), "coni", "left_semi"))


ONLY = "SELECT DISTINCT s1 AS signal, coni FROM small WHERE kind = 'lin' AND coni IN (SELECT coni FROM small WHERE kind = 'mul') AND s1 NOT IN (SELECT s1 FROM small WHERE kind = 'mul' UNION SELECT s2 FROM small WHERE kind = 'mul')"


@query("jn3_only_linear", f"WITH {A}, small AS (SELECT * FROM acir WHERE coni % 20 = 0) {ONLY}")
def jn3(spark, d):
    return R.only_linear(D.acir(spark, d).where("coni % 20 = 0"))


@query("jn4_shared_signal_graph", f"WITH {T}, {INC} SELECT a.coni AS src, b.coni AS dst, count(*) AS weight FROM inc a JOIN inc b ON a.signal = b.signal AND a.coni < b.coni GROUP BY 1, 2")
def jn4(spark, d):
    return R.shared_signals(inc(spark, d))


@query("jn5_shared_constraints", f"WITH {T}, {INC} SELECT DISTINCT a.signal AS s1, b.signal AS s2 FROM inc a JOIN inc b ON a.coni = b.coni AND a.signal < b.signal")
def jn5(spark, d):
    return R.shared_constraints(inc(spark, d))


@query("jn6_adjacency", f"WITH {S}, {INC}, e AS (SELECT a.coni AS src, b.coni AS dst, count(*) AS weight FROM inc a JOIN inc b ON a.signal = b.signal AND a.coni <> b.coni GROUP BY 1, 2) SELECT * FROM e")
def jn6(spark, d, most=2):
    return R.both_ways(R.shared_signals(R.incidence(D.terms(spark, d, most))))


@query("jn7_neighbours", f"WITH {S}, {INC} SELECT DISTINCT a.coni AS src, b.coni AS dst FROM inc a JOIN inc b ON a.signal = b.signal AND a.coni <> b.coni")
def jn7(spark, d, most=2):
    return R.both_ways(R.shared_signals(R.incidence(D.terms(spark, d, most)))).select("src", "dst").distinct()


PARTS = "parts AS (SELECT DISTINCT coni, coni % 50 AS part_id FROM term)"


def parts_of(t: DataFrame, n: int = 50) -> DataFrame:
    return t.select("coni", (F.col("coni") % n).alias("part_id")).distinct()


@query("jn8_part_neighbours", f"WITH {S}, {INC}, {PARTS}, h AS (SELECT DISTINCT signal, part_id FROM inc JOIN parts USING (coni)) SELECT DISTINCT a.part_id AS src, b.part_id AS dst FROM h a JOIN h b ON a.signal = b.signal AND a.part_id < b.part_id")
def jn8(spark, d, most=2):
    t = D.terms(spark, d, most)
    return R.part_neighbours(R.incidence(t), parts_of(t))


@query(
    "jn9_weighted_part_neighbours",
    f"WITH {S}, {INC}, {PARTS}, h AS (SELECT DISTINCT signal, part_id FROM inc JOIN parts USING (coni)), e AS (SELECT DISTINCT a.part_id AS src, b.part_id AS dst FROM h a JOIN h b ON a.signal = b.signal AND a.part_id <> b.part_id), n AS (SELECT part_id AS dst, count(*) AS w FROM parts WHERE coni IN (SELECT coni FROM term GROUP BY coni HAVING bool_or(part = 'A') AND bool_or(part = 'B')) GROUP BY 1) SELECT src, e.dst, coalesce(w, 0) AS weight FROM e LEFT JOIN n ON e.dst = n.dst",
)
def jn9(spark, d, most=2):
    t = D.terms(spark, d, most)
    return R.weighted_part_neighbours(R.incidence(t), parts_of(t), R.nonlinear(t))


LEFT_RIGHT = "l AS (SELECT coef AS label FROM term WHERE part = 'A'), r AS (SELECT coef * 2 % 257 AS label FROM term WHERE part = 'B')"


def colours(spark, d):
    t = D.terms(spark, d)
    return t.where("part = 'A'").select(F.col("coef").alias("label")), t.where("part = 'B'").select((F.col("coef") * 2 % 257).alias("label"))


@query("jn10_common_labels", f"WITH {T}, {LEFT_RIGHT} SELECT label, n_left, n_right FROM (SELECT label, count(*) AS n_left FROM l GROUP BY 1) JOIN (SELECT label, count(*) AS n_right FROM r GROUP BY 1) USING (label)")
def jn10(spark, d):
    return R.common_labels(*colours(spark, d))


def pair_tables(spark, d):
    t = D.terms(spark, d)
    of = lambda k: t.where(F.col("coni") % 10 == k).select(F.floor(F.col("coni") / 10).alias("pair"), "coni", "signal", "part", (F.col("coef") % 5).alias("coef"))
    return of(0), of(1)


PAIRS = "pt AS (SELECT coni // 10 AS pair, coni % 10 AS side, coni, signal, part, coef % 5 AS coef FROM term WHERE signal <> 0 AND coni % 10 < 2)"
SIG = "sg AS (SELECT pair, side, coni, signal, string_agg(part || ':' || c, ';' ORDER BY part || ':' || c) AS sig FROM slot GROUP BY ALL)"
MEET = "SELECT l.pair, l.coni AS lconi, r.coni AS rconi, l.signal AS lsignal, r.signal AS rsignal FROM sg l JOIN sg r ON l.pair = r.pair AND l.sig = r.sig AND l.side = 0 AND r.side = 1"


@query("jn11_viable_ordered", f"WITH {T}, {PAIRS}, slot AS (SELECT pair, side, coni, signal, part, CAST(coef AS VARCHAR) AS c FROM pt), {SIG} {MEET}")
def jn11(spark, d):
    return R.viable_pairs(*pair_tables(spark, d))


@query(
    "jn12_viable_unordered",
    f"WITH {T}, {PAIRS}, slot AS (SELECT pair, side, coni, signal, CASE WHEN count(*) = 2 THEN 'both' ELSE 'one' END AS part, string_agg(CAST(coef AS VARCHAR), ',' ORDER BY coef) AS c FROM pt WHERE part <> 'C' GROUP BY 1, 2, 3, 4 UNION ALL SELECT pair, side, coni, signal, part, CAST(coef AS VARCHAR) FROM pt WHERE part = 'C'), {SIG} {MEET}",
)
def jn12(spark, d):
    return R.viable_pairs(*pair_tables(spark, d), ordered=False)


@query("jn15_arc_signals", f"WITH {S}, {INC}, {PARTS}, h AS (SELECT DISTINCT signal, part_id FROM inc JOIN parts USING (coni)), on_ AS (SELECT a.part_id AS src, b.part_id AS dst, a.signal FROM h a JOIN h b ON a.signal = b.signal AND a.part_id + 1 = b.part_id) SELECT src AS node, signal, 'out' AS role FROM on_ UNION SELECT dst, signal, 'in' FROM on_")
def jn15(spark, d, most=2):
    t = D.terms(spark, d, most)
    arcs = parts_of(t).select(F.col("part_id").alias("src"), (F.col("part_id") + 1).alias("dst")).distinct()
    return R.arc_signals(R.incidence(t), parts_of(t), arcs)


@query("jn16_parents", f"WITH {S}, {INC}, {PARTS}, h AS (SELECT DISTINCT signal, part_id FROM inc JOIN parts USING (coni)), e AS (SELECT DISTINCT a.part_id AS src, b.part_id AS dst FROM h a JOIN h b ON a.signal = b.signal AND a.part_id < b.part_id) SELECT dst AS node, string_agg(CAST(src AS VARCHAR), ',' ORDER BY src) AS parents FROM e GROUP BY dst")
def jn16(spark, d, most=2):
    t = D.terms(spark, d, most)
    return R.part_neighbours(R.incidence(t), parts_of(t)).groupBy(F.col("dst").alias("node")).agg(R.joined(R.sorted_list("src")).alias("parents"))


@query("jn18_as_of", "SELECT coni, start, name FROM (SELECT CAST(o_orderkey AS BIGINT) AS coni FROM orders) o ASOF JOIN (SELECT CAST(c_custkey * 9 AS BIGINT) AS start, c_name AS name FROM customer) s ON o.coni >= s.start")
def jn18(spark, d):
    starts = D.table(spark, d, "customer").select((F.col("c_custkey") * 9).cast("long").alias("start"), F.col("c_name").alias("name"))
    return R.as_of(D.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("coni")), starts)


@query("agg1_histogram", f"WITH {T} SELECT coef AS value, count(*) AS n FROM term GROUP BY coef")
def agg1(spark, d):
    return R.histogram(D.terms(spark, d), "coef")


CLASSES = """key AS (SELECT coni, concat_ws('|', string_agg(CAST(coef AS VARCHAR), ',' ORDER BY coef) FILTER (part = 'A'), '') || '/' || concat_ws('|', string_agg(CAST(coef AS VARCHAR), ',' ORDER BY coef) FILTER (part = 'B'), '') || '/' || concat_ws('|', string_agg(CAST(coef AS VARCHAR), ',' ORDER BY coef) FILTER (part = 'C'), '') AS k FROM term GROUP BY coni),
cls AS (SELECT min(coni) OVER (PARTITION BY k) AS class_id, coni FROM key)"""


@query("agg3_coefficient_classes", f"WITH {T}, {CLASSES} SELECT * FROM cls")
def agg3(spark, d):
    return R.coefficient_classes(D.terms(spark, d))


@query("agg2_class_sizes", f"WITH {T}, {CLASSES}, z AS (SELECT class_id, count(*) AS size FROM cls GROUP BY 1) SELECT size, count(*) AS classes, CAST(sum(size) AS BIGINT) AS members, CAST(sum(size * size) AS BIGINT) AS squares FROM z GROUP BY size")
def agg2(spark, d):
    return R.class_sizes(R.coefficient_classes(D.terms(spark, d)))


@query(
    "agg4_shape_classes",
    f"WITH {S}, {INC}, {PARTS}, f AS (SELECT part_id, count(DISTINCT coni) AS n_con, count(DISTINCT signal) AS n_sig FROM inc JOIN parts USING (coni) GROUP BY 1) SELECT part_id, n_con, n_sig, min(part_id) OVER (PARTITION BY n_con, n_sig) AS class_id FROM f",
)
def agg4(spark, d, most=2):
    t = D.terms(spark, d, most)
    f = R.incidence(t).join(parts_of(t), "coni").groupBy("part_id").agg(F.countDistinct("coni").alias("n_con"), F.countDistinct("signal").alias("n_sig"))
    return f.withColumn("class_id", F.min("part_id").over(Window.partitionBy("n_con", "n_sig")))


@query(
    "agg5_multiset_classes",
    f"WITH {S}, c AS (SELECT coni, coef, count(*) AS n FROM term GROUP BY ALL), k AS (SELECT coni, string_agg(CAST(coef AS VARCHAR) || 'x' || n, ';' ORDER BY coef) AS k FROM c GROUP BY 1) SELECT min(coni) OVER (PARTITION BY k) AS class_id, coni FROM k",
)
def agg5(spark, d, most=2):
    return R.multiset_classes(D.terms(spark, d, most), "coni", "coef")


@query("agg6_single_occurrences", f"WITH {S}, {INC} SELECT signal, n, first FROM (SELECT signal, count(*) AS n, min(coni) AS first FROM inc GROUP BY 1) WHERE n = 1")
def agg6(spark, d, most=2):
    return R.occurrences(R.incidence(D.terms(spark, d, most))).where("n = 1")


@query("agg7_linear_occurrences", f"WITH {L} SELECT signal, count(DISTINCT coni) AS n FROM link WHERE signal <> 0 GROUP BY signal")
def agg7(spark, d):
    return R.occurrences(R.incidence(D.links(spark, d))).select("signal", "n")


@query("agg8_monomials_to_add", f"WITH {A} SELECT count(DISTINCT (s1, s2)) AS added FROM (SELECT s1, s2, row_number() OVER (PARTITION BY coni ORDER BY s1, s2) AS k FROM acir WHERE kind = 'mul') WHERE k > 1")
def agg8(spark, d):
    return R.monomials_to_add(D.acir(spark, d))


DEG = f"WITH {T}, {INC}, deg AS (SELECT signal, count(*) AS degree FROM inc GROUP BY 1)"


@query("agg9_degree_mean", f"{DEG} SELECT 'mean' AS kind, CAST(sum(degree) // count(*) AS BIGINT) AS value FROM deg")
def agg9(spark, d):
    return R.degree_average(inc(spark, d), "mean")


@query("agg9_degree_median", f"{DEG} SELECT 'median' AS kind, quantile_disc(degree, 0.5) AS value FROM deg")
def agg9b(spark, d):
    return R.degree_average(inc(spark, d), "median")


@query("agg9_degree_mode", f"{DEG} SELECT 'mode' AS kind, degree AS value FROM (SELECT degree, count(*) AS n FROM deg GROUP BY 1) ORDER BY n DESC, degree LIMIT 1")
def agg9c(spark, d):
    return R.degree_average(inc(spark, d), "mode")


@query("agg13_uncovered", f"WITH {T} SELECT DISTINCT coni FROM term WHERE coni % 50 = 49")
def agg13(spark, d):
    t = D.terms(spark, d)
    return R.uncovered(t.select("coni").distinct(), parts_of(t).where("part_id < 49"))


@query("agg14_summed", f"WITH {T} SELECT signal, CAST(sum(coef) % 257 AS BIGINT) AS coef FROM term GROUP BY signal HAVING sum(coef) % 257 <> 0")
def agg14(spark, d):
    return R.summed(D.terms(spark, d).select("signal", "coef"))


@query("agg15_mismatched_classes", f"WITH {T}, {LEFT_RIGHT} SELECT label, coalesce(n_left, 0) AS n_left, coalesce(n_right, 0) AS n_right FROM (SELECT label, count(*) AS n_left FROM l GROUP BY 1) FULL JOIN (SELECT label, count(*) AS n_right FROM r GROUP BY 1) USING (label) WHERE coalesce(n_left, 0) <> coalesce(n_right, 0)")
def agg15(spark, d):
    return R.mismatched_classes(*colours(spark, d))


@query("win1_dense_ids", f"WITH {T} SELECT part, coef, row_number() OVER (ORDER BY part, coef) AS id FROM (SELECT DISTINCT part, coef FROM term)")
def win1(spark, d):
    return R.dense_ids(D.terms(spark, d), ["part", "coef"])


@query("win2_numbered_signals", f"WITH {G}, {NUMBERED.format(of='sig')} SELECT old, new FROM num")
def win2(spark, d):
    return R.numbered(D.signals(spark, d))


@query("win3_dense_witness", f"WITH {S}, {INC} SELECT signal AS old, row_number() OVER (ORDER BY signal) AS new FROM (SELECT DISTINCT signal FROM inc)")
def win3(spark, d, most=2):
    return R.dense_ids(R.incidence(D.terms(spark, d, most)), ["signal"]).select(F.col("signal").alias("old"), F.col("id").alias("new"))


@query("win4_greatest_signal", f"WITH {L} SELECT coni, max(signal) AS signal FROM link WHERE signal <> 0 GROUP BY coni")
def win4(spark, d):
    return R.greatest_signal(D.links(spark, d))


@query("win5_rarest_signal", f"WITH {L}, n AS (SELECT signal, count(*) AS n FROM link WHERE signal <> 0 GROUP BY 1) SELECT coni, signal FROM link JOIN n USING (signal) QUALIFY row_number() OVER (PARTITION BY coni ORDER BY n, signal DESC) = 1")
def win5(spark, d):
    return R.rarest_signal(D.links(spark, d))


@query("win6_heaviest_signals", f"{DEG}, st AS (SELECT degree, coalesce(sum(count(*)) OVER (ORDER BY degree DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM deg GROUP BY degree) SELECT signal, degree FROM deg JOIN st USING (degree) WHERE before <= 0.36 * (SELECT count(*) FROM part)")
def win6(spark, d):
    n = D.table(spark, d, "part").count()
    return R.heaviest_signals(inc(spark, d), 0.36, n)


@query("srt1_by_distance_vectors", f"WITH {S}, v AS (SELECT coni AS node, list_sort(list(coef)) AS v FROM term GROUP BY 1) SELECT node, row_number() OVER (ORDER BY v, node) AS place FROM v")
def srt1(spark, d, most=2):
    return R.by_distance_vectors(D.terms(spark, d, most).select(F.col("coni").alias("node"), F.col("coef").alias("d")))


@query("srt2_sorted_parts", f"WITH {S} SELECT coni, part, string_agg(signal || ':' || coef, ' ' ORDER BY coef, signal) AS terms FROM term GROUP BY 1, 2")
def srt2(spark, d, most=2):
    rows = D.terms(spark, d, most).groupBy("coni", "part").agg(F.sort_array(F.collect_list(F.struct("coef", "signal"))).alias("x"))
    return rows.select("coni", "part", F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["signal"].cast("string"), x["coef"].cast("string"))), " ").alias("terms"))


SETS = f"WITH {T}, l AS (SELECT DISTINCT signal FROM term WHERE part = 'A' AND coni % 20 = 0), r AS (SELECT DISTINCT signal FROM term WHERE part = 'B' AND coni % 20 = 0)"


@query("set1_signal_sets", f"{SETS} SELECT signal, 'both' AS side FROM l INTERSECT SELECT signal, 'both' FROM r UNION ALL (SELECT signal, 'left' FROM (SELECT * FROM l EXCEPT SELECT * FROM r)) UNION ALL (SELECT signal, 'right' FROM (SELECT * FROM r EXCEPT SELECT * FROM l))")
def set1(spark, d):
    t = D.terms(spark, d).where("coni % 20 = 0")
    left, right = (t.where(F.col("part") == p).select("signal").distinct() for p in "AB")
    parts = {"both": left.intersect(right), "left": left.subtract(right), "right": right.subtract(left)}
    named = [df.withColumn("side", F.lit(k)) for k, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])
