"""Queries and their SQL: binary files, class maps, cliques, bounds of products, accessors and normal forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.field import Field
from ..operators import graph as G
from ..operators import verify as V
from ..plans.fixpoint import cut, ready
from ..sources import derived as D
from ..sources import files

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FIELD = Field(257)
T, LK, AC, SIG = D.TERMS_SQL, D.LINKS_SQL, D.ACIR_SQL, D.SIGNALS_SQL


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"WITH {sql}"
        return f

    return put


# --- binary files -------------------------------------------------------------------------------------------

GATES = [("PLUS", [3, 250]), ("Poseidon", [])], [(1, [1, 2, 3]), (0, [5, 8]), (0, [])]


def circuits(spark, d):
    """The derived system as eight circuits, by the order's last digits, with constraints numbered from 0 in each."""
    t = D.terms(spark, d).withColumn("circuit_id", F.concat(F.lit("c"), F.col("coni") % 8))
    return t.withColumn("coni", F.floor(F.col("coni") / 8))


def written_files(spark, d) -> str:
    """The folder of the circuits' files."""
    ready(spark)
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/r1cs-{uuid.uuid4().hex}"
    files.write_r1cs(circuits(spark, d), folder, 257, 32, (20, 100, 80), GATES).write.format("noop").mode("overwrite").save()
    return folder


def _named(df):
    """Circuits go by their files' names."""
    return df.withColumn("circuit_id", F.regexp_extract("circuit_id", r"([^/]+)\.r1cs$", 1))


CIRCUITS = f"{T}, ct AS (SELECT 'c' || (coni % 8) AS circuit_id, coni // 8 AS coni, part, signal, coef FROM term)"


@query("src1_r1cs_round_trip", f"{CIRCUITS} SELECT circuit_id, '257' AS prime, coni, part, signal, CAST(coef AS VARCHAR) AS coef FROM ct")
def src1(spark, d):
    return _named(files.read_r1cs(spark, written_files(spark, d))).select("circuit_id", "prime", "coni", "part", "signal", "coef")


@query("src2_headers", f"{CIRCUITS} SELECT circuit_id, '257' AS prime, max(signal) + 1 AS n_wires, 20 AS n_pub_out, 100 AS n_pub_in, 80 AS n_prv_in, max(signal) + 1 AS n_labels, max(coni) + 1 AS n_constraints FROM ct GROUP BY 1")
def src2(spark, d):
    return _named(files.read_headers(spark, written_files(spark, d))).select("circuit_id", "prime", *files.HEADER)


@query("src7_labels", f"{CIRCUITS} SELECT circuit_id, unnest(range(0, max(signal) + 1)) AS wire, unnest(range(0, max(signal) + 1)) AS label FROM ct GROUP BY 1")
def src7(spark, d):
    return _named(files.read_labels(spark, written_files(spark, d))).select("circuit_id", "wire", "label")


@query(
    "src8_custom_gates",
    f"{CIRCUITS}, g AS (SELECT * FROM (VALUES ('used', 0, 0, 'PLUS', '3,250'), ('used', 1, 1, 'Poseidon', ''), ('applied', 0, 1, 'Poseidon', '1,2,3'), ('applied', 1, 0, 'PLUS', '5,8'), ('applied', 2, 0, 'PLUS', '')) v(kind, place, gate, name, vals)) SELECT circuit_id, kind, place, gate, name, vals FROM (SELECT DISTINCT circuit_id FROM ct), g",
)
def src8(spark, d):
    return _named(files.read_gates(spark, written_files(spark, d))).select("circuit_id", "kind", "place", "gate", "name", F.col("values").alias("vals"))


@query("snk1_written_files", f"{CIRCUITS} SELECT circuit_id, max(coni) + 1 AS n_constraints, count(*) AS n_terms, 12 + 12 * 3 + 4 + 32 + 28 + 12 * (max(coni) + 1) + 36 * count(*) + 8 * (max(signal) + 1) + 12 + 4 + 4 + 1 + 4 + 64 + 8 + 1 + 4 + 12 + 4 + 3 * 8 + 5 * 8 AS n_bytes FROM ct GROUP BY 1")
def snk1(spark, d):
    rows = spark.read.format("binaryFile").load(written_files(spark, d)).select(F.col("path").alias("circuit_id"), F.col("length").alias("n_bytes"))
    stats = circuits(spark, d).groupBy("circuit_id").agg((F.max("coni") + 1).alias("n_constraints"), F.count("*").alias("n_terms"))
    return _named(rows).join(stats, "circuit_id").select("circuit_id", "n_constraints", "n_terms", "n_bytes")


@query("src4_symbols", f"{SIG} SELECT signal, 'main.' || role || '[' || signal || ']' AS name FROM sig")
def src4(spark, d):
    ready(spark)
    folder = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/sym-{uuid.uuid4().hex}"
    name = F.concat(F.lit("main."), F.col("role"), F.lit("["), F.col("signal").cast("string"), F.lit("]"))
    D.signals(spark, d).select("signal", F.col("signal").alias("s"), F.lit(1).alias("component"), name.alias("name")).write.csv(folder)
    return files.read_sym(spark, folder)


# --- predicates and accessors -------------------------------------------------------------------------------


@query(
    "prd20_legacy_predicates",
    f"{T}, l AS (SELECT coni, count(*) AS n, count(*) FILTER (part = 'A') = 0 OR count(*) FILTER (part = 'B') = 0 AS linear, count(*) FILTER (signal <> 0) = 0 AS constant FROM term GROUP BY 1) SELECT coni, constant, linear, linear AND n = 2 AND NOT constant AS pair FROM l",
)
def prd20(spark, d):
    n = lambda p: F.count_if(F.col("part") == p)
    per = D.terms(spark, d).groupBy("coni").agg(F.count("*").alias("n"), ((n("A") == 0) | (n("B") == 0)).alias("linear"), (F.count_if(F.col("signal") != 0) == 0).alias("constant"))
    return per.select("coni", "constant", "linear", (F.col("linear") & (F.col("n") == 2) & ~F.col("constant")).alias("pair"))


@query(
    "ex9_decomposed",
    f"{LK}, z AS (SELECT coni, count(*) FILTER (signal <> 0) AS n, max(coef) FILTER (signal <> 0) AS c, max(signal) AS s, coalesce(max(coef) FILTER (signal = 0), 0) AS k FROM link GROUP BY 1) SELECT coni, CASE WHEN n = 0 THEN 'number' WHEN n = 1 AND c = 1 AND k = 0 THEN 'signal' ELSE 'linear' END AS kind, CASE WHEN n = 1 AND c = 1 AND k = 0 THEN s END AS signal, CAST(CASE WHEN n = 0 THEN k END AS BIGINT) AS value FROM z",
)
def ex9(spark, d):
    """The normal form of a map of coefficients: a number, a signal, or a linear expression."""
    s = F.col("signal") != 0
    per = D.links(spark, d).groupBy("coni").agg(F.count_if(s).alias("n"), F.max(F.when(s, F.col("coef"))).alias("c"), F.max("signal").alias("s"), F.coalesce(F.max(F.when(~s, F.col("coef"))), F.lit(0)).alias("k"))
    one = (F.col("n") == 1) & (F.col("c") == 1) & (F.col("k") == 0)
    return per.select("coni", F.when(F.col("n") == 0, "number").when(one, "signal").otherwise("linear").alias("kind"), F.when(one, F.col("s")).alias("signal"), F.when(F.col("n") == 0, F.col("k").cast("long")).alias("value"))


@query("ex15_accessors", f"{T} SELECT coni, count(*) FILTER (part = 'A') AS n_a, count(*) FILTER (part = 'B') AS n_b, count(*) FILTER (part = 'C') AS n_c, min(signal) FILTER (part = 'A') AS first_a, min(signal) FILTER (part = 'C') AS first_c FROM term GROUP BY 1")
def ex15(spark, d):
    is_ = lambda p: F.col("part") == p
    return D.terms(spark, d).groupBy("coni").agg(*(F.count_if(is_(p)).alias(f"n_{p.lower()}") for p in "ABC"), F.min(F.when(is_("A"), F.col("signal"))).alias("first_a"), F.min(F.when(is_("C"), F.col("signal"))).alias("first_c"))


@query("jn17_class_members", f"{T}, c AS (SELECT coni, string_agg(part || coef, ',' ORDER BY part, coef) AS k FROM term GROUP BY 1), m AS (SELECT coni, min(coni) OVER (PARTITION BY k) AS class_id, row_number() OVER (PARTITION BY k ORDER BY coni) - 1 AS place FROM c) SELECT class_id, place, coni FROM m")
def jn17(spark, d):
    """Classes as sorted lists of members, and back to a row a member with its place."""
    keys = D.terms(spark, d).groupBy("coni").agg(F.md5(F.array_join(F.sort_array(F.collect_list(F.struct("part", "coef"))).cast("array<string>"), ",")).alias("k"))
    lists = keys.groupBy("k").agg(F.sort_array(F.collect_list("coni")).alias("members"))
    return lists.select(F.col("members")[0].alias("class_id"), F.posexplode("members").alias("place", "coni")).select("class_id", F.col("place").cast("long").alias("place"), "coni")


# --- substitution -------------------------------------------------------------------------------------------


@query(
    "sb8_solved_not_normalised",
    f"{LK}, top AS (SELECT coni, max(signal) AS s FROM link WHERE signal <> 0 GROUP BY 1) SELECT link.coni, s AS from_signal, (SELECT (257 - x.coef) % 257 FROM link x WHERE x.coni = link.coni AND x.signal = s) AS divisor, signal, coef FROM link JOIN top USING (coni) WHERE signal <> s",
)
def sb8(spark, d):
    """A linear constraint solved for its greatest signal, the division left open: divisor * from_signal = the rest."""
    t = D.links(spark, d)
    top = t.where("signal <> 0").groupBy("coni").agg(F.max(F.struct("signal", "coef")).alias("t"))
    rows = t.join(top, "coni").where(F.col("signal") != F.col("t.signal"))
    return rows.select("coni", F.col("t.signal").alias("from_signal"), FIELD.neg(F.col("t.coef")).alias("divisor"), "signal", "coef")


# --- graphs -------------------------------------------------------------------------------------------------


@query(
    "gt10_monomial_clusters",
    f"{AC}, m AS (SELECT DISTINCT coni, s1, s2 FROM acir WHERE kind = 'mul'), o AS (SELECT *, s1 IS DISTINCT FROM lag(s2) OVER (PARTITION BY coni ORDER BY s1, s2) AS fresh FROM m), g AS (SELECT coni, s1, s2, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY coni ORDER BY s1, s2) AS part FROM o) SELECT coni, s1, s2, min(s1) OVER (PARTITION BY coni, part) AS cluster FROM g",
)
def gt10(spark, d):
    """Monomials of a constraint that share signals, over any number of steps; named by the least signal."""
    mul = D.acir(spark, d).where("kind = 'mul'").select("coni", "s1", "s2").distinct()
    nodes = mul.select("coni", F.col("s1").alias("s")).union(mul.select("coni", F.col("s2").alias("s"))).distinct()
    ids = cut(nodes.withColumn("node", F.col("coni") * 1_000_000 + F.col("s")))
    ends = mul.select((F.col("coni") * 1_000_000 + F.col("s1")).alias("a"), (F.col("coni") * 1_000_000 + F.col("s2")).alias("b"))
    part = G.components(ends, "a", "b").join(ids, "node").select("coni", F.col("s").alias("s1"), (F.col("component") - F.col("coni") * 1_000_000).alias("cluster"))
    return mul.join(part, ["coni", "s1"]).select("coni", "s1", "s2", "cluster")


@query("cl7_clusters_of_cliques")
def cl7(spark, d):
    """Vertices 0 to 599 in the components of given complete subgraphs; a vertex in none is alone."""
    k = D.links(spark, d).where("signal between 4000 and 4400 and coni % 3 = 0").select((F.col("signal") % 40).alias("signal"), (F.col("coni") % 600).alias("coni")).distinct()
    vertices = spark.range(600).select(F.col("id").alias("coni"))
    found = G.constraint_components(k).withColumnRenamed("component", "cluster")
    return vertices.join(found, "coni", "left").select(F.col("coni").alias("vertex"), F.coalesce("cluster", "coni").alias("cluster"))


ORACLES["cl7_clusters_of_cliques"] = f"""WITH RECURSIVE {LK}, k AS (SELECT DISTINCT signal % 40 AS clique, coni % 600 AS v FROM link WHERE signal BETWEEN 4000 AND 4400 AND coni % 3 = 0),
e AS (SELECT DISTINCT a.v AS x, b.v AS y FROM k a JOIN k b USING (clique)),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT v.range AS vertex, coalesce(min(y), v.range) AS cluster FROM range(0, 600) v LEFT JOIN r ON r.x = v.range GROUP BY v.range"""


# --- bounds -------------------------------------------------------------------------------------------------

SIGNED = "CASE WHEN coef >= 129 THEN coef - 257 ELSE coef END"


@query(
    "vf4_product_bounds",
    f"{T}, b AS (SELECT signal, signal % 3 AS lo, signal % 3 + signal % 5 AS hi FROM (SELECT DISTINCT signal FROM term)), w AS (SELECT coni, part, sum(CASE WHEN c >= 0 THEN c * lo ELSE c * hi END) AS lo, sum(CASE WHEN c >= 0 THEN c * hi ELSE c * lo END) AS hi FROM (SELECT coni, part, {SIGNED} AS c, lo, hi FROM term JOIN b USING (signal)) GROUP BY 1, 2), p AS (SELECT a.coni, a.lo AS al, a.hi AS ah, b.lo AS bl, b.hi AS bh FROM w a JOIN w b ON a.coni = b.coni AND a.part = 'A' AND b.part = 'B') SELECT coni, CAST(least(al * bl, al * bh, ah * bl, ah * bh) AS BIGINT) AS lo, CAST(greatest(al * bl, al * bh, ah * bl, ah * bh) AS BIGINT) AS hi FROM p",
)
def vf4(spark, d):
    t = D.terms(spark, d)
    s = F.col("signal")
    bounds = t.select("signal").distinct().select("signal", (s % 3).alias("lo"), (s % 3 + s % 5).alias("hi"))
    return V.product_bounds(V.linear_bounds(t, bounds, FIELD))
