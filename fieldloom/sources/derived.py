"""Constraint systems derived from ordinary tables.

``terms``: (coni, part, signal, coef), the sparse A * B = C form; signal 0 is the constant 1.
``acir``: (coni, kind, s1, s2, coef), sums of products and linear terms equal to 0; s2 is null in linear terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

P = 257


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terms(spark: SparkSession, sf_dir: str, most: int | None = None, together: bool = False) -> DataFrame:
    """An order is a constraint, a part a signal; ``most`` keeps line items of at most that quantity. ``together``: a constraint's
    terms lie in one partition, so that what groups by constraint deals out nothing anew."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    if most is not None:
        rows = rows.where(F.col("l_quantity") <= most)
    if together:
        rows = rows.repartition("l_orderkey")
    turn = F.col("l_linenumber") % 3
    part = F.when(turn == 1, "A").when(turn == 2, "B").otherwise("C")
    keyed = rows.groupBy(F.col("l_orderkey").cast("long").alias("coni"), part.alias("part"), (F.col("l_partkey") + 1).cast("long").alias("signal"))
    return keyed.agg((F.sum(F.col("l_quantity").cast("long")) % P).alias("coef")).where("coef <> 0")


TERMS_SQL = """term AS (
  SELECT CAST(l_orderkey AS BIGINT) AS coni, CASE l_linenumber % 3 WHEN 1 THEN 'A' WHEN 2 THEN 'B' ELSE 'C' END AS part,
    CAST(l_partkey + 1 AS BIGINT) AS signal, CAST(sum(CAST(l_quantity AS BIGINT)) % 257 AS BIGINT) AS coef
  FROM lineitem GROUP BY 1, 2, 3 HAVING sum(CAST(l_quantity AS BIGINT)) % 257 <> 0)"""
SPARSE_SQL = TERMS_SQL.replace("FROM lineitem", "FROM lineitem WHERE l_quantity <= 2")


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear constraints from orders: customer = priority slot, some with a constant, some with a third signal."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_custkey").cast("long").alias("c"))
    row = lambda signal, coef: F.struct(signal.cast("long").alias("signal"), coef.cast("long").alias("coef"))
    k = F.col("k")
    each = F.array(
        row(F.col("c") + 1, F.lit(1)),
        row(k * 7 % 997 + 2000, F.when(k % 11 == 0, 3).otherwise(256)),
        F.when(k % 5 == 0, row(F.lit(0), k % 256 + 1)),
        F.when(k % 7 == 0, row(k * 13 % 499 + 4000, k % 200 + 2)),
    )
    rows = o.select(k.alias("coni"), F.inline(F.filter(each, lambda x: x.isNotNull())))
    return rows.groupBy("coni", F.lit("C").alias("part"), "signal").agg((F.sum("coef") % P).alias("coef")).where("coef <> 0")


LINKS_SQL = """link AS (
  SELECT coni, 'C' AS part, signal, CAST(sum(coef) % 257 AS BIGINT) AS coef FROM (
    SELECT CAST(o_orderkey AS BIGINT) AS coni, CAST(o_custkey + 1 AS BIGINT) AS signal, 1 AS coef FROM orders
    UNION ALL SELECT o_orderkey, o_orderkey * 7 % 997 + 2000, CASE WHEN o_orderkey % 11 = 0 THEN 3 ELSE 256 END FROM orders
    UNION ALL SELECT o_orderkey, 0, o_orderkey % 256 + 1 FROM orders WHERE o_orderkey % 5 = 0
    UNION ALL SELECT o_orderkey, o_orderkey * 13 % 499 + 4000, o_orderkey % 200 + 2 FROM orders WHERE o_orderkey % 7 = 0)
  GROUP BY coni, signal HAVING sum(coef) % 257 <> 0)"""


def acir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive parts of an order are multiplied; its last part is linear."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("coni"), (F.col("l_partkey") + 1).cast("long").alias("s")).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    after = F.lead("s").over(Window.partitionBy("coni").orderBy("s"))
    rows = rows.withColumn("n", after)
    kind = F.when(F.col("n").isNull(), "lin").otherwise("mul")
    return rows.select("coni", kind.alias("kind"), F.col("s").alias("s1"), F.col("n").alias("s2"), (F.col("q") % P).alias("coef")).where("coef <> 0")


ACIR_SQL = """acir AS (
  SELECT coni, CASE WHEN n IS NULL THEN 'lin' ELSE 'mul' END AS kind, s AS s1, n AS s2, CAST(q % 257 AS BIGINT) AS coef FROM (
    SELECT *, lead(s) OVER (PARTITION BY coni ORDER BY s) AS n FROM (
      SELECT CAST(l_orderkey AS BIGINT) AS coni, CAST(l_partkey + 1 AS BIGINT) AS s, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem GROUP BY 1, 2))
  WHERE q % 257 <> 0)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(signal, role): the first hundredth of the parts are outputs, the next tenth inputs."""
    part = table(spark, sf_dir, "part").select((F.col("p_partkey") + 1).cast("long").alias("signal"))
    n = part.agg(F.count("*").alias("n"))
    s = F.col("signal")
    role = F.when(s <= F.floor(F.col("n") / 100), "output").when(s <= F.floor(F.col("n") / 100) * 11, "input").otherwise("internal")
    return part.crossJoin(n).select("signal", role.alias("role"))


SIGNALS_SQL = """sig AS (
  SELECT signal, CASE WHEN signal <= n // 100 THEN 'output' WHEN signal <= n // 100 * 11 THEN 'input' ELSE 'internal' END AS role
  FROM (SELECT CAST(p_partkey + 1 AS BIGINT) AS signal, count(*) OVER () AS n FROM part))"""
