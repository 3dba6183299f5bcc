"""Queries and their SQL: field arithmetic, expressions, canonical scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as E
from ..functions.field import BN254, BigField, Field
from ..operators import normalise as N
from ..operators import relational as R
from ..sources import derived as D

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
T, S, L, A = D.TERMS_SQL, D.SPARSE_SQL, D.LINKS_SQL, D.ACIR_SQL
FIELD = Field(257)
#: Inverses as a table, for SQL.
INV = "inv AS (SELECT a.range AS x, b.range AS y FROM range(1, 257) a, range(1, 257) b WHERE a.range * b.range % 257 = 1)"


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def numbers(spark, d):
    """(k, a, b): operands below and above the prime, negative ones, and zeros."""
    o = D.table(spark, d, "orders")
    k = F.col("o_orderkey").cast("long")
    return o.select(k.alias("k"), (k * 31 - 9000).alias("a"), (k % 40 - F.when(k % 3 == 0, F.col("o_custkey")).otherwise(0)).cast("long").alias("b"))


NUMBERS = "num AS (SELECT k, a, b, ((a % 257) + 257) % 257 AS x, ((b % 257) + 257) % 257 AS y FROM (SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_orderkey * 31 - 9000 AS BIGINT) AS a, CAST(o_orderkey % 40 - CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END AS BIGINT) AS b FROM orders))"
SX, SY = ("CASE WHEN {v} >= 129 THEN {v} - 257 ELSE {v} END".format(v=v) for v in "xy")
SHIFT = "CASE WHEN {k} <= 128 THEN CASE WHEN {k} >= 9 THEN 0 ELSE ((x << {k}) & 511) % 257 END ELSE CASE WHEN 257 - {k} >= 9 THEN 0 ELSE (x >> (257 - {k})) % 257 END END"

_FIELD = {
    "fa1_canon": (lambda f: f.canon("a"), "x"),
    "fa2_add": (lambda f: f.add("a", "b"), "(x + y) % 257"),
    "fa2_sub": (lambda f: f.sub("a", "b"), "(x - y + 257) % 257"),
    "fa2_mul": (lambda f: f.mul("a", "b"), "x * y % 257"),
    "fa3_div": (lambda f: f.div("a", "b"), "(SELECT num.x * inv.y % 257 FROM inv WHERE inv.x = num.y)"),
    "fa4_idiv": (lambda f: f.idiv("a", "b"), "CASE WHEN y <> 0 THEN x // y END"),
    "fa5_mod": (lambda f: f.mod("a", "b"), "CASE WHEN y <> 0 THEN x % y END"),
    "fa6_pow": (lambda f: f.pow("a", F.pmod("b", F.lit(4))), "CASE ((b % 4) + 4) % 4 WHEN 0 THEN 1 WHEN 1 THEN x WHEN 2 THEN x * x % 257 ELSE x * x * x % 257 END"),
    "fa7_neg": (lambda f: f.neg("a"), "(257 - x) % 257"),
    "fa8_inv": (lambda f: f.inv("a"), "(SELECT inv.y FROM inv WHERE inv.x = num.x)"),
    "fa9_complement": (lambda f: f.complement("a"), f"(({(2**256 - 1) % 257}) - x + 257) % 257"),
    "fa10_shift_left": (lambda f: f.shift_left("a", "b"), SHIFT.format(k="y")),
    "fa10_shift_right": (lambda f: f.shift_right("a", "b"), SHIFT.format(k="((257 - y) % 257)")),
    "fa11_and": (lambda f: f.bit_and("a", "b"), "(x & y) % 257"),
    "fa11_or": (lambda f: f.bit_or("a", "b"), "(x | y) % 257"),
    "fa11_xor": (lambda f: f.bit_xor("a", "b"), "xor(x, y) % 257"),
    "fa12_signed": (lambda f: f.signed("a"), SX),
    "fa13_as_bool": (lambda f: f.as_bool("a"), "CASE WHEN x <> 0 THEN 1 ELSE 0 END"),
    "fa13_not": (lambda f: f.not_("a"), "CASE WHEN x = 0 THEN 1 ELSE 0 END"),
    "fa13_and": (lambda f: f.and_("a", "b"), "CASE WHEN x <> 0 AND y <> 0 THEN 1 ELSE 0 END"),
    "fa13_or": (lambda f: f.or_("a", "b"), "CASE WHEN x <> 0 OR y <> 0 THEN 1 ELSE 0 END"),
    "fa15_is_negative": (lambda f: f.is_negative("a").cast("long"), "CASE WHEN x > 128 THEN 1 ELSE 0 END"),
    **{f"fa14_{op}": (lambda f, op=op: f.compare(op, "a", "b"), f"CASE WHEN ({SX}) {sign} ({SY}) THEN 1 ELSE 0 END") for op, sign in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items()},
}
for _name, (_f, _sql) in _FIELD.items():
    QUERIES[_name] = lambda spark, d, f=_f: numbers(spark, d).select("k", f(FIELD).cast("long").alias("value"))
    ORACLES[_name] = f"WITH {NUMBERS}, {INV} SELECT k, CAST({_sql} AS BIGINT) AS value FROM num"


@query("fa_big_sums", f"WITH o AS (SELECT CAST(o_orderkey AS BIGINT) AS k FROM orders) SELECT k, CAST(k * 1000003 AS VARCHAR) AS product, CASE WHEN k % 2 = 0 THEN CAST(k // 2 AS VARCHAR) END AS half FROM o WHERE k > 0")
def fa_big(spark, d):
    f = BigField(BN254)
    o = D.table(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("k")).where("k > 0")
    back = f.mul(f.mul(f.mul("k", 1000003), f.inv("k")), "k")
    half = f.div("k", 2)
    return o.select("k", f.sub(f.add(back, "k"), "k").alias("product"), F.when(F.col("k") % 2 == 0, half).alias("half"))


# --- expressions --------------------------------------------------------------------------------------------


def linear_pair(spark, d):
    t = D.links(spark, d)
    of = lambda r: t.where(F.col("coni") % 2 == r).select(F.floor(F.col("coni") / 2).alias("expr"), "part", "signal", "coef")
    return of(0), of(1)


PAIR = "ab AS (SELECT coni % 2 AS side, coni // 2 AS expr, part, signal, coef FROM link)"


@query("ex1_add", f"WITH {L}, {PAIR} SELECT expr, part, signal, CAST(sum(coef) % 257 AS BIGINT) AS coef FROM ab GROUP BY 1, 2, 3 HAVING sum(coef) % 257 <> 0")
def ex1(spark, d):
    return E.add(*linear_pair(spark, d), FIELD)


@query("ex3_subtract", f"WITH {L}, {PAIR} SELECT expr, part, signal, CAST(sum(CASE side WHEN 0 THEN coef ELSE 257 - coef END) % 257 AS BIGINT) AS coef FROM ab GROUP BY 1, 2, 3 HAVING sum(CASE side WHEN 0 THEN coef ELSE 257 - coef END) % 257 <> 0")
def ex3(spark, d):
    return E.subtract(*linear_pair(spark, d), FIELD)


@query("ex2_multiply", f"WITH {L}, {PAIR} SELECT expr, CASE side WHEN 0 THEN 'A' ELSE 'B' END AS part, signal, coef FROM ab")
def ex2(spark, d):
    return E.multiply(*linear_pair(spark, d))


@query("ex4_divide", f"WITH {L}, {PAIR}, {INV} SELECT expr, part, signal, coef * (SELECT y FROM inv WHERE x = 5) % 257 AS coef FROM ab WHERE side = 0")
def ex4(spark, d):
    return E.divide(linear_pair(spark, d)[0], 5, FIELD)


@query("ex12_add_constant", f"WITH {L}, {PAIR}, u AS (SELECT expr, part, signal, coef FROM ab WHERE side = 0 UNION ALL SELECT DISTINCT expr, 'C', 0, 9 FROM ab WHERE side = 0) SELECT expr, part, signal, CAST(sum(coef) % 257 AS BIGINT) AS coef FROM u GROUP BY 1, 2, 3 HAVING sum(coef) % 257 <> 0")
def ex12(spark, d):
    return E.add_constant(linear_pair(spark, d)[0], 9, FIELD)


@query("ex10_to_constraint", f"WITH {S} SELECT coni AS expr, part, signal, CASE part WHEN 'C' THEN 257 - coef ELSE coef END AS coef FROM term")
def ex10(spark, d, most=2):
    return E.to_constraint(D.terms(spark, d, most).withColumnRenamed("coni", "expr"), FIELD)


EXPANDED = "m AS (SELECT coni, least(a.signal, b.signal) AS s1, greatest(a.signal, b.signal) AS s2, a.coef * b.coef AS coef FROM term a JOIN term b USING (coni) WHERE a.part = 'A' AND b.part = 'B' UNION ALL SELECT coni, 0, signal, {c} FROM term WHERE part = 'C')"


@query("ex11_to_sum", f"WITH {S}, {EXPANDED.format(c='coef')} SELECT coni AS expr, CASE WHEN s1 = 0 THEN 'lin' ELSE 'mul' END AS kind, CASE WHEN s1 = 0 THEN s2 ELSE s1 END AS s1, CASE WHEN s1 <> 0 THEN s2 END AS s2, CAST(sum(coef) % 257 AS BIGINT) AS coef FROM m GROUP BY 1, m.s1, m.s2 HAVING sum(coef) % 257 <> 0")
def ex11(spark, d, most=2):
    return E.to_sum(D.terms(spark, d, most).withColumnRenamed("coni", "expr"), FIELD)


KINDS = "kinds(k) AS (VALUES ('number'), ('signal'), ('linear'), ('quadratic'), ('nonquadratic'))"


def kind_pairs(spark):
    k = spark.createDataFrame([(x, y) for x in ("number", "signal", "linear", "quadratic", "nonquadratic") for y in ("number", "signal", "linear", "quadratic", "nonquadratic")], "l string, r string")
    return k


@query("ex5_kinds_of_numbers", f"WITH {KINDS} SELECT a.k AS l, b.k AS r, CASE WHEN a.k = 'number' AND b.k = 'number' THEN 'number' ELSE 'nonquadratic' END AS kind FROM kinds a, kinds b")
def ex5(spark, d):
    return kind_pairs(spark).select("l", "r", E.kind_of_numbers(F.col("l"), F.col("r")).alias("kind"))


@query("ex1_kinds_of_sums", f"WITH {KINDS}, rk AS (SELECT k, CASE k WHEN 'number' THEN 0 WHEN 'signal' THEN 1 WHEN 'linear' THEN 1 WHEN 'quadratic' THEN 2 ELSE 9 END AS v FROM kinds) SELECT a.k AS l, b.k AS r, CASE WHEN a.v + b.v >= 4 THEN 'nonquadratic' WHEN greatest(a.v, b.v) = 2 THEN 'quadratic' WHEN a.v + b.v = 0 THEN 'number' ELSE 'linear' END AS kind FROM rk a, rk b")
def ex1k(spark, d):
    return kind_pairs(spark).select("l", "r", E.kind_of_sum(F.col("l"), F.col("r")).alias("kind"))


@query("ex2_kinds_of_products", f"WITH {KINDS}, rk AS (SELECT k, CASE k WHEN 'number' THEN 0 WHEN 'signal' THEN 1 WHEN 'linear' THEN 1 WHEN 'quadratic' THEN 2 ELSE 9 END AS v FROM kinds) SELECT a.k AS l, b.k AS r, CASE a.v + b.v WHEN 0 THEN 'number' WHEN 1 THEN 'linear' WHEN 2 THEN 'quadratic' ELSE 'nonquadratic' END AS kind FROM rk a, rk b")
def ex2k(spark, d):
    return kind_pairs(spark).select("l", "r", E.kind_of_product(F.col("l"), F.col("r")).alias("kind"))


@query("ex13_text", f"WITH {L} SELECT coni AS expr, '()() + ' || string_agg(coef || '*' || CASE WHEN signal = 0 THEN '1' ELSE 'x' || signal END, ' + ' ORDER BY signal) AS text FROM link GROUP BY coni")
def ex13(spark, d):
    return E.text_of(D.links(spark, d).withColumnRenamed("coni", "expr"))


@query(
    "ex17_relaxed_orders",
    f"WITH {S}, inc AS (SELECT DISTINCT coni, signal FROM term), o AS (SELECT signal, signal % 9 + 1 AS ord FROM (SELECT DISTINCT signal FROM inc)), t AS (SELECT coni, sum(ord) AS total FROM inc JOIN o USING (signal) GROUP BY 1) SELECT signal, CAST(min(least(ord, total - ord + 1)) AS BIGINT) AS ord FROM inc JOIN o USING (signal) JOIN t USING (coni) GROUP BY signal",
)
def ex17(spark, d, most=2):
    inc = R.incidence(D.terms(spark, d, most))
    return E.relaxed_orders(inc, inc.select("signal").distinct().withColumn("ord", F.col("signal") % 9 + 1))


# --- canonical scaling --------------------------------------------------------------------------------------

EASY = "s AS (SELECT coni, part, CASE WHEN sum(coef) % 257 <> 0 THEN sum(coef) % 257 ELSE sum(DISTINCT coef) % 257 END AS s FROM term GROUP BY 1, 2), fac AS (SELECT coni, part, CAST(any_value(s) * min(s * inv.y % 257) % 257 AS BIGINT) AS factor FROM term JOIN s USING (coni, part) JOIN inv ON inv.x = coef WHERE s <> 0 GROUP BY 1, 2)"
CHOICE = "flag AS (SELECT coni, bool_or(part = 'A') AND bool_or(part = 'B') AS quad FROM term GROUP BY 1), ch AS (SELECT flag.coni, coalesce(a.factor, 1) AS a, coalesce(b.factor, 1) AS b, CASE WHEN quad THEN a.factor * b.factor % 257 ELSE coalesce(c.factor, 1) END AS c FROM flag LEFT JOIN (SELECT * FROM fac WHERE part = 'A') a USING (coni) LEFT JOIN (SELECT * FROM fac WHERE part = 'B') b USING (coni) LEFT JOIN (SELECT * FROM fac WHERE part = 'C') c USING (coni))"


@query("nrm1_list_factors", f"WITH {T}, {INV}, {EASY} SELECT * FROM fac")
def nrm1(spark, d):
    return N.list_factors(D.terms(spark, d).select("coni", "part", "coef"), ["coni", "part"])


@query("nrm3_choices", f"WITH {T}, {INV}, {EASY}, {CHOICE} SELECT * FROM ch")
def nrm3(spark, d):
    return N.choices(D.terms(spark, d))


SCALED = "sc AS (SELECT coni, part, signal, term.coef * inv.y % 257 AS coef FROM term JOIN ch USING (coni) JOIN inv ON inv.x = CASE part WHEN 'A' THEN a WHEN 'B' THEN b ELSE c END), sw AS (SELECT coni, coalesce(list_sort(list(coef) FILTER (part = 'A')), []) > coalesce(list_sort(list(coef) FILTER (part = 'B')), []) AS w FROM sc GROUP BY 1)"


@query("nrm4_norms", f"WITH {T}, {INV}, {EASY}, {CHOICE}, {SCALED} SELECT coni, CAST(1 AS BIGINT) AS choice, CASE WHEN w AND part = 'A' THEN 'B' WHEN w AND part = 'B' THEN 'A' ELSE part END AS part, signal, coef FROM sc JOIN sw USING (coni)")
def nrm4(spark, d):
    return N.norms(D.terms(spark, d))


@query(
    "nrm5_acir_norms",
    f"WITH {A}, {INV}, pick AS (SELECT coni, kind, coef FROM acir WHERE kind = 'mul' OR coni NOT IN (SELECT coni FROM acir WHERE kind = 'mul')), s AS (SELECT coni, CASE WHEN sum(coef) % 257 <> 0 THEN sum(coef) % 257 ELSE sum(DISTINCT coef) % 257 END AS s FROM pick GROUP BY 1), hard AS (SELECT DISTINCT coni, coef AS c FROM pick JOIN s USING (coni) WHERE s = 0), rat AS (SELECT a.coni, a.c AS l, a.c * inv.y % 257 AS r FROM hard a JOIN hard b ON a.coni = b.coni AND a.c <> b.c JOIN inv ON inv.x = b.c), rr AS (SELECT coni, r FROM rat GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY coni ORDER BY count(*), r) = 1), kp AS (SELECT DISTINCT coni, l FROM rat JOIN rr USING (coni, r)), ks AS (SELECT coni, sum(l) % 257 AS s FROM kp GROUP BY 1), fac AS (SELECT *, row_number() OVER (PARTITION BY coni ORDER BY f) AS choice FROM (SELECT coni, any_value(s) * min(s * inv.y % 257) % 257 AS f FROM pick JOIN s USING (coni) JOIN inv ON inv.x = coef WHERE s <> 0 GROUP BY 1 UNION ALL SELECT coni, l FROM kp JOIN ks USING (coni) WHERE ks.s = 0 UNION ALL SELECT coni, any_value(ks.s) * min(ks.s * inv.y % 257) % 257 FROM kp JOIN ks USING (coni) JOIN inv ON inv.x = l WHERE ks.s <> 0 GROUP BY 1)) SELECT coni, choice, kind, s1, s2, CAST(coef * inv.y % 257 AS BIGINT) AS coef FROM acir JOIN fac USING (coni) JOIN inv ON inv.x = f",
)
def nrm5(spark, d):
    return N.acir_norms(D.acir(spark, d))


@query("nrm6_norm_ids", f"WITH {T} SELECT coni, CAST(1 AS BIGINT) AS choice FROM (SELECT DISTINCT coni FROM term)")
def nrm6(spark, d):
    return N.with_normi(N.choices(D.terms(spark, d))).select("coni", "choice")


@query("nrm8_without_repeats", f"WITH {S}, h AS (SELECT coni, string_agg(part || signal || '*' || coef, '.' ORDER BY part, signal) AS h FROM term GROUP BY 1) SELECT coni, part, signal, coef FROM term WHERE coni IN (SELECT min(coni) FROM h GROUP BY h)")
def nrm8(spark, d, most=2):
    return N.without_repeats(D.terms(spark, d, most))


_H = "coalesce(string_agg(signal || '*' || coef, '.' ORDER BY signal, coef) FILTER (part = '{}'), '')"


@query("nrm9_hashes", f"WITH {T} SELECT coni, {' || chr(124) || '.join(_H.format(x) for x in 'ABC')} AS hash FROM term GROUP BY coni")
def nrm9(spark, d):
    return N.hashes(D.terms(spark, d))


@query("nrm7_folded", f"WITH {L}, {INV}, f AS (SELECT coni, arg_min(coef, signal) AS f FROM link GROUP BY 1) SELECT coni, part, signal, coef * y % 257 AS coef FROM link JOIN f USING (coni) JOIN inv ON x = f")
def nrm7(spark, d):
    return N.folded(D.links(spark, d))


@query("nrm11_monomials", f"WITH {S}, {EXPANDED.format(c='257 - coef')}, t AS (SELECT coni, s1, s2, CAST(sum(coef) % 257 AS BIGINT) AS c FROM m GROUP BY 1, 2, 3 HAVING sum(coef) % 257 <> 0) SELECT coni, s1, s2, CASE WHEN c >= 129 THEN c - 257 ELSE c END AS coef FROM t")
def nrm11(spark, d, most=2):
    return N.monomials(D.terms(spark, d, most))
