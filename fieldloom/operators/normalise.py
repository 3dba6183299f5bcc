"""Canonical scaling of constraints.

A list of coefficients is scaled so that lists which differ by a factor become equal. If its sum s is not 0, the
least s / c_i fixes the factor; else the sum of its distinct coefficients may. Where both vanish, the ratios of all
pairs are counted and the list shrinks to the left members of the rarest ratio, until that is stable: what stays
is a coset of roots of unity, and each of its members is a choice of factor.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.field import Field


def _rooted(coefs: list[int], p: int) -> list[int]:
    """Factors of a list whose sum, and whose sum of distinct members, vanish."""
    now = sorted(set(coefs))
    while len(now) > 1:
        ratios = {}
        for a in now:
            for b in now:
                if a != b:
                    ratios.setdefault(a * pow(b, -1, p) % p, []).append(a)
        _, keep = min(ratios.items(), key=lambda kv: (len(kv[1]), kv[0]))
        keep = sorted(set(keep))
        if keep == now:
            break
        now = keep
        if s := sum(now) % p:
            return [_by_sum(now, s, p)]
    return now


def _by_sum(coefs: list[int], s: int, p: int) -> int:
    """The member c whose s / c is least, as a factor: s times that, back over s."""
    return s * min(s * pow(c, -1, p) % p for c in coefs) % p


def factors_of(coefs: list[int], p: int) -> list[int]:
    """All choices of factor for a list, one unless it is a coset of roots of unity."""
    if s := sum(coefs) % p:
        return [_by_sum(coefs, s, p)]
    if s := sum(set(coefs)) % p:
        return [_by_sum(sorted(set(coefs)), s, p)]
    return _rooted(coefs, p)


def list_factors(lists: DataFrame, keys: list[str], p: int = 257) -> DataFrame:
    """(keys, factor) from rows (keys, coef): aggregates where a sum decides, one small group at a time for the rest."""
    f = Field(p)
    sums = lists.groupBy(*keys).agg(f.sum("coef").alias("s"), F.sum_distinct(F.col("coef")).alias("u")).withColumn("s", F.when(F.col("s") != 0, F.col("s")).otherwise(f.canon("u")))
    easy = lists.join(sums.where("s <> 0"), keys).groupBy(*keys, "s").agg(F.min(f.div("s", "coef")).alias("least"))
    easy = easy.select(*keys, f.mul("s", "least").alias("factor"))
    hard = lists.join(sums.where("s = 0").select(*keys), keys, "left_semi")
    schema = ", ".join(f"{n} {t}" for n, t in hard.select(*keys).dtypes) + ", factor long"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        found = factors_of([int(c) for c in rows["coef"]], p)
        return pd.DataFrame({k: [rows[k].iloc[0]] * len(found) for k in keys} | {"factor": found})

    return easy.unionByName(hard.groupBy(*keys).applyInPandas(one, schema))


def choices(terms: DataFrame, p: int = 257) -> DataFrame:
    """(coni, a, b, c): every choice of factors of a constraint's parts; 1 for an empty factor.

    A and B go by their constant, else by their list. C goes by its constant, else by a * b where both factors
    are there, else by its list.
    """
    f = Field(p)
    const = terms.where("signal = 0").select("coni", "part", F.col("coef").alias("factor"))
    lists = terms.join(const.select("coni", "part"), ["coni", "part"], "left_anti").select("coni", "part", "coef")
    ab = const.where("part <> 'C'").unionByName(list_factors(lists.where("part <> 'C'"), ["coni", "part"], p))
    flags = terms.groupBy("coni").agg(F.bool_or(F.col("part") == "A").alias("has_a"), F.bool_or(F.col("part") == "B").alias("has_b"))
    pick = lambda part: ab.where(F.col("part") == part).select("coni", F.col("factor").alias(part.lower()))
    rows = flags.join(pick("A"), "coni", "left").join(pick("B"), "coni", "left").fillna(1, ["a", "b"])
    c_const = const.where("part = 'C'").select("coni", F.col("factor").alias("k"))
    linear = lists.where("part = 'C'").join(flags.where("not (has_a and has_b)").select("coni"), "coni", "left_semi")
    c_list = list_factors(linear, ["coni", "part"], p).select("coni", F.col("factor").alias("l"))
    rows = rows.join(c_const, "coni", "left").join(c_list, "coni", "left")
    c = F.coalesce("k", F.when(F.col("has_a") & F.col("has_b"), f.mul("a", "b")), "l", F.lit(1).cast("long"))
    return rows.select("coni", "a", "b", c.alias("c"))


def with_normi(chosen: DataFrame) -> DataFrame:
    """Adds ``choice``: (coni, choice) names a norm."""
    return chosen.withColumn("choice", F.row_number().over(Window.partitionBy("coni").orderBy("a", "b", "c")).cast("long"))


def norms(terms: DataFrame, p: int = 257) -> DataFrame:
    """(coni, choice, part, signal, coef): each norm's terms, its factors in order of their sorted coefficients."""
    f = Field(p)
    picked = with_normi(choices(terms, p))
    by = F.when(F.col("part") == "A", F.col("a")).when(F.col("part") == "B", F.col("b")).otherwise(F.col("c"))
    scaled = terms.join(picked, "coni").select("coni", "choice", "part", "signal", f.div("coef", by).alias("coef"))
    of = lambda part: F.sort_array(F.collect_list(F.when(F.col("part") == part, F.col("coef"))))
    swap = scaled.groupBy("coni", "choice").agg(of("A").alias("x"), of("B").alias("y")).where("x > y").select("coni", "choice", F.lit(True).alias("swap"))
    turned = F.when(F.col("swap") & (F.col("part") == "A"), "B").when(F.col("swap") & (F.col("part") == "B"), "A").otherwise(F.col("part"))
    return scaled.join(swap, ["coni", "choice"], "left").select("coni", "choice", turned.alias("part"), "signal", "coef")


def acir_norms(acir: DataFrame, p: int = 257) -> DataFrame:
    """(coni, choice, kind, s1, s2, coef): scaled by the constant, else by the products' list, else by the linear one.

    The constant is the linear term of signal 0."""
    f = Field(p)
    const = acir.where("kind = 'lin' and s1 = 0").select("coni", F.col("coef").alias("factor"))
    rest = acir.join(const.select("coni"), "coni", "left_anti")
    mul = rest.where("kind = 'mul'").select("coni", "coef")
    lin = rest.join(mul.select("coni"), "coni", "left_anti").select("coni", "coef")
    factor = const.unionByName(list_factors(mul, ["coni"], p)).unionByName(list_factors(lin, ["coni"], p))
    factor = factor.withColumn("choice", F.row_number().over(Window.partitionBy("coni").orderBy("factor")).cast("long"))
    return acir.join(factor, "coni").select("coni", "choice", "kind", "s1", "s2", f.div("coef", "factor").alias("coef"))


def folded(terms: DataFrame, p: int = 257) -> DataFrame:
    """The older normal form: a constant or empty factor folds into C, which is then scaled so that the coefficient of
    its least signal is 1; quadratic constraints have each part scaled so, their factors in order of signals."""
    f = Field(p)
    flags = terms.groupBy("coni").agg(*(F.bool_or((F.col("part") == x) & (F.col("signal") != 0)).alias(f"var_{x}") for x in "AB"), *(F.coalesce(F.max(F.when((F.col("part") == x) & (F.col("signal") == 0), F.col("coef"))), F.lit(0)).alias(f"k_{x}") for x in "AB"))
    rows = terms.join(flags, "coni")
    quad = F.col("var_A") & F.col("var_B")
    keep = rows.where(quad).select("coni", "part", "signal", "coef")
    flat = rows.where(~quad)
    other = F.when(F.col("part") == "A", F.col("k_B")).otherwise(F.col("k_A"))
    # A * B - C with a constant factor k: k times the other factor, less C; the constant product counts once
    once = ~((F.col("part") == "B") & (F.col("signal") == 0))
    moved = flat.where("part <> 'C'").where(once).select("coni", F.lit("C").alias("part"), "signal", f.mul("coef", other).alias("coef"))
    less = flat.where("part = 'C'").select("coni", "part", "signal", f.neg("coef").alias("coef"))
    linear = moved.unionByName(less).groupBy("coni", "part", "signal").agg(f.sum("coef").alias("coef")).where("coef <> 0")
    all_terms = keep.unionByName(linear)
    first = F.min_by("coef", "signal").over(Window.partitionBy("coni", "part"))
    scaled = all_terms.withColumn("first", first).select("coni", "part", "signal", f.div("coef", "first").alias("coef"))
    return scaled


def hashes(terms: DataFrame) -> DataFrame:
    """(coni, hash): signals and coefficients of the parts, in order, as text."""
    part = lambda p: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("part") == p, F.struct("signal", "coef")))), lambda x: F.concat_ws("*", x["signal"].cast("string"), x["coef"].cast("string"))), ".")
    return terms.groupBy("coni").agg(F.concat_ws("|", part("A"), part("B"), part("C")).alias("hash"))


def without_repeats(terms: DataFrame) -> DataFrame:
    """Of constraints with equal terms, the first."""
    first = hashes(terms).groupBy("hash").agg(F.min("coni").alias("coni"))
    return terms.join(first.select("coni"), "coni", "left_semi")


def monomials(terms: DataFrame, p: int = 257) -> DataFrame:
    """(coni, s1, s2, coef): A * B - C multiplied out, coefficients signed; s1 = 0 in linear terms, both in the constant."""
    f = Field(p)
    a = terms.where("part = 'A'").select("coni", F.col("signal").alias("x"), F.col("coef").alias("cx"))
    b = terms.where("part = 'B'").select("coni", F.col("signal").alias("y"), F.col("coef").alias("cy"))
    product = a.join(b, "coni").select("coni", F.least("x", "y").alias("s1"), F.greatest("x", "y").alias("s2"), f.mul("cx", "cy").alias("coef"))
    less = terms.where("part = 'C'").select("coni", F.lit(0).cast("long").alias("s1"), F.col("signal").alias("s2"), f.neg("coef").alias("coef"))
    total = product.unionByName(less).groupBy("coni", "s1", "s2").agg(f.sum("coef").alias("coef")).where("coef <> 0")
    return total.withColumn("coef", f.signed("coef"))
