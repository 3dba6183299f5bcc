"""Expressions of degree two at most, and their algebra.

An expression is rows (expr, part, signal, coef), part A, B or C: the product of A and B plus C; signal 0 is the
constant 1. Its kind is number, signal, linear, quadratic, or nonquadratic for what has left the algebra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .field import Field


def _kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def kind_of_sum(left: Column, right: Column) -> Column:
    quad = lambda k: (k == "quadratic").cast("int")
    return F.when((left == "nonquadratic") | (right == "nonquadratic") | (quad(left) + quad(right) == 2), "nonquadratic").when(quad(left) + quad(right) == 1, "quadratic").when((left == "number") & (right == "number"), "number").otherwise("linear")


def kind_of_product(left: Column, right: Column) -> Column:
    low = lambda k: k.isin("signal", "linear")
    return (
        F.when((left == "nonquadratic") | (right == "nonquadratic"), "nonquadratic")
        .when((left == "number") & (right == "number"), "number")
        .when((left == "number") & (right == "quadratic") | (left == "quadratic") & (right == "number"), "quadratic")
        .when((left == "number") | (right == "number"), "linear")
        .when(low(left) & low(right), "quadratic")
        .otherwise("nonquadratic")
    )


def kind_of_quotient(left: Column, right: Column) -> Column:
    """Only numbers divide."""
    return F.when(right == "number", F.when(left == "signal", "linear").otherwise(left)).otherwise("nonquadratic")


def kind_of_numbers(left: Column, right: Column) -> Column:
    """Integer quotients, remainders, bits, comparisons and logic: of numbers alone."""
    return F.when((left == "number") & (right == "number"), "number").otherwise("nonquadratic")


def kind_of_power(left: Column, exponent: Column) -> Column:
    return F.when(left == "number", "number").when((exponent == 2) & left.isin("signal", "linear"), "quadratic").otherwise("nonquadratic")


def add(left: DataFrame, right: DataFrame, f: Field) -> DataFrame:
    """Coefficient-wise sum of expressions of which one at most has a product."""
    return left.unionByName(right).groupBy("expr", "part", "signal").agg(f.sum("coef").alias("coef")).where("coef <> 0")


def scale(expr: DataFrame, by: Column | int, f: Field) -> DataFrame:
    """A number times an expression: its A and C are multiplied."""
    return expr.withColumn("coef", F.when(F.col("part") == "B", F.col("coef")).otherwise(f.mul("coef", by))).where("coef <> 0")


def subtract(left: DataFrame, right: DataFrame, f: Field) -> DataFrame:
    return add(left, scale(right, -1, f), f)


def divide(expr: DataFrame, by: Column | int, f: Field) -> DataFrame:
    return scale(expr, f.inv(by), f)


def multiply(left: DataFrame, right: DataFrame) -> DataFrame:
    """The product of two linear expressions, as parts A and B."""
    return left.where("part = 'C'").withColumn("part", F.lit("A")).unionByName(right.where("part = 'C'").withColumn("part", F.lit("B")))


def add_constant(expr: DataFrame, value: int, f: Field) -> DataFrame:
    one = expr.select("expr").distinct().select("expr", F.lit("C").alias("part"), F.lit(0).cast("long").alias("signal"), f.canon(value).alias("coef"))
    return add(expr, one, f)


def to_constraint(expr: DataFrame, f: Field) -> DataFrame:
    """A * B + C = 0 in the form A * B = C."""
    return expr.withColumn("coef", F.when(F.col("part") == "C", f.neg("coef")).otherwise(F.col("coef")))


def to_sum(expr: DataFrame, f: Field) -> DataFrame:
    """(expr, kind, s1, s2, coef): the product multiplied out; a product with the constant is linear."""
    a = expr.where("part = 'A'").select("expr", F.col("signal").alias("x"), F.col("coef").alias("cx"))
    b = expr.where("part = 'B'").select("expr", F.col("signal").alias("y"), F.col("coef").alias("cy"))
    x, y = F.least("x", "y"), F.greatest("x", "y")
    mul = a.join(b, "expr").select("expr", F.when(x == 0, "lin").otherwise("mul").alias("kind"), F.when(x == 0, y).otherwise(x).alias("s1"), F.when(x != 0, y).alias("s2"), f.mul("cx", "cy").alias("coef"))
    lin = expr.where("part = 'C'").select("expr", F.lit("lin").alias("kind"), F.col("signal").alias("s1"), F.lit(None).cast("long").alias("s2"), "coef")
    return mul.unionByName(lin).groupBy("expr", "kind", "s1", "s2").agg(f.sum("coef").alias("coef")).where("coef <> 0")


def text_of(expr: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(expr, text): terms in order of their signals; ``names`` (signal, name) replace the numbers."""
    rows = expr if names is None else expr.join(names, "signal", "left")
    name = F.when(F.col("signal") == 0, F.lit("1")).otherwise(F.col("name") if names is not None else F.concat(F.lit("x"), F.col("signal").cast("string")))
    term = F.struct("signal", F.concat(F.col("coef").cast("string"), F.lit("*"), name).alias("t"))
    part = lambda p: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == p, term))), lambda x: x["t"]), " + ")
    return rows.groupBy("expr").agg(F.concat(F.lit("("), part("A"), F.lit(")("), part("B"), F.lit(") + "), part("C")).alias("text"))


def relaxed_orders(inc: DataFrame, orders: DataFrame) -> DataFrame:
    """One step of order relaxation: a signal's order becomes the least, over its constraints, of itself and the sum of
    the others' orders plus 1. orders: (signal, ord)."""
    held = inc.join(orders, "signal")
    total = held.groupBy("coni").agg(F.sum("ord").alias("total"))
    new = held.join(total, "coni").groupBy("signal").agg(F.min(F.least(F.col("ord"), F.col("total") - F.col("ord") + 1)).alias("ord"))
    return new
