"""Whether inputs determine outputs: bounds, uniqueness, and a three-valued check of small systems."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.field import Field
from ..plans.fixpoint import cut


def domains(terms: DataFrame, f: Field) -> DataFrame:
    """(coni, signal, lo, hi, binary) of constraints (x - a)(x - b) = 0: one signal in both factors, nothing in C.
    binary: the two roots are neighbours, so the bounds say all."""
    per = terms.groupBy("coni").agg(
        F.count_if(F.col("part") == "C").alias("n_c"),
        F.countDistinct(F.when(F.col("signal") != 0, F.col("signal"))).alias("n_s"),
        F.max(F.when(F.col("signal") != 0, F.col("signal"))).alias("signal"),
        *(F.max(F.when((F.col("part") == p) & (F.col("signal") != 0), F.col("coef"))).alias(f"{p.lower()}1") for p in "AB"),
        *(F.coalesce(F.max(F.when((F.col("part") == p) & (F.col("signal") == 0), F.col("coef"))), F.lit(0)).alias(f"{p.lower()}0") for p in "AB"),
    ).where("n_c = 0 and n_s = 1 and a1 is not null and b1 is not null")
    ra, rb = f.neg(f.div("a0", "a1")), f.neg(f.div("b0", "b1"))
    rows = per.select("coni", "signal", ra.alias("r"), rb.alias("q"))
    lo, hi = F.least("r", "q"), F.greatest("r", "q")
    return rows.select("coni", "signal", lo.alias("lo"), hi.alias("hi"), (hi - lo <= 1).alias("binary"))


def linear_bounds(terms: DataFrame, bounds: DataFrame, f: Field) -> DataFrame:
    """(coni, part, lo, hi): of each part as a sum of integers with signed coefficients; signals without bounds lie in [0, p - 1]."""
    b = bounds.select("signal", "lo", "hi")
    rows = terms.join(b, "signal", "left").withColumn("c", f.signed("coef"))
    lo = F.when(F.col("signal") == 0, 1).otherwise(F.coalesce("lo", F.lit(0)))
    hi = F.when(F.col("signal") == 0, 1).otherwise(F.coalesce("hi", F.lit(f.p - 1)))
    low = F.when(F.col("c") >= 0, F.col("c") * lo).otherwise(F.col("c") * hi)
    high = F.when(F.col("c") >= 0, F.col("c") * hi).otherwise(F.col("c") * lo)
    return rows.groupBy("coni", "part").agg(F.sum(low).alias("lo"), F.sum(high).alias("hi"))


def product_bounds(parts: DataFrame) -> DataFrame:
    """(coni, lo, hi) of the product of both factors, from ``linear_bounds``: the least and the greatest of the four products
    of their ends, whatever their signs."""
    side = lambda p: parts.where(F.col("part") == p).select("coni", F.col("lo").alias(f"{p}l"), F.col("hi").alias(f"{p}h"))
    ends = [F.col(a) * F.col(b) for a in ("Al", "Ah") for b in ("Bl", "Bh")]
    return side("A").join(side("B"), "coni").select("coni", F.least(*ends).alias("lo"), F.greatest(*ends).alias("hi"))


def tightened(bounds: DataFrame) -> DataFrame:
    """(signal, lo, hi): the intersection of all bounds of a signal."""
    return bounds.groupBy("signal").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi"))


def deduced_bounds(terms: DataFrame, f: Field, most: int = 50) -> DataFrame:
    """(signal, lo, hi): domains, then to a fixpoint what linear constraints say of a signal with coefficient 1 or -1, where
    the others' sum stays within one round of the field."""
    bounds = cut(tightened(domains(terms, f)))
    flags = terms.groupBy("coni").agg(F.bool_or(F.col("part") == "A").alias("a"), F.bool_or(F.col("part") == "B").alias("b")).where("not (a and b)")
    lin = cut(terms.where("part = 'C'").join(flags.select("coni"), "coni", "left_semi").withColumn("c", f.signed("coef")))
    seen = None
    for _ in range(most):
        whole = linear_bounds(lin.drop("c"), bounds, f).select("coni", F.col("lo").alias("tl"), F.col("hi").alias("th"))
        rows = lin.where("signal <> 0 and c in (1, -1)").join(whole, "coni").join(bounds, "signal", "left").fillna({"lo": 0, "hi": f.p - 1})
        ol = F.col("tl") - F.when(F.col("c") == 1, F.col("lo")).otherwise(-F.col("hi"))
        oh = F.col("th") - F.when(F.col("c") == 1, F.col("hi")).otherwise(-F.col("lo"))
        new = rows.select("signal", F.when(F.col("c") == 1, -oh).otherwise(ol).alias("lo"), F.when(F.col("c") == 1, -ol).otherwise(oh).alias("hi"))
        fits = new.where((F.col("lo") >= 0) & (F.col("hi") <= f.p - 1) & (F.col("lo") <= F.col("hi")))
        bounds = cut(tightened(bounds.unionByName(fits)))
        now = bounds.agg(F.count("*"), F.sum("lo"), F.sum("hi")).first()
        if now == seen:
            break
        seen = now
    return bounds


def determined(terms: DataFrame, known: DataFrame, most: int = 1000) -> DataFrame:
    """(signal): what ``known`` (signal) determines: a constraint with one unknown signal left fixes it, where
    that stands in C alone, or in one factor alone and the other is a constant other than 0."""
    other = lambda p: F.bool_or(F.col("part") == p) & ~F.coalesce(F.bool_or((F.col("part") == p) & (F.col("signal") != 0)), F.lit(False))
    fixed = terms.groupBy("coni").agg(other("A").alias("a"), other("B").alias("b"))
    alone = lambda p: F.bool_and(F.col("part") == p)
    places = terms.where("signal <> 0").groupBy("coni", "signal").agg(*(alone(p).alias(f"only_{p.lower()}") for p in "ABC"))
    inc = cut(places.join(fixed, "coni").select("coni", "signal", F.expr("only_c or (only_b and a) or (only_a and b)").alias("fixes")))
    found = cut(known.select("signal").distinct())
    while most:
        most -= 1
        open_ = inc.join(found, "signal", "left_anti").groupBy("coni").agg(F.count("*").alias("n"), F.max("signal").alias("signal"), F.bool_and("fixes").alias("ok"))
        new = cut(open_.where("n = 1 and ok").select("signal").distinct())
        if new.isEmpty():
            break
        found = cut(found.union(new))
    return found


def check_small(rows: pd.DataFrame, inputs: set[int], outputs: set[int], p: int, most: int = 200_000) -> str:
    """VERIFIED, FAILED or UNKNOWN: uniqueness first, then all assignments if they are at most ``most``."""
    cons: dict[int, dict[str, dict[int, int]]] = {}
    for coni, part, signal, coef in rows[["coni", "part", "signal", "coef"]].itertuples(index=False):
        cons.setdefault(int(coni), {"A": {}, "B": {}, "C": {}})[part][int(signal)] = int(coef)
    signals = sorted({s for c in cons.values() for x in c.values() for s in x if s})
    known = inputs & set(signals)
    while True:
        new = set()
        for c in cons.values():
            unknown = {s for x in c.values() for s in x if s} - known
            if len(unknown) == 1 and not unknown & (set(c["A"]) | set(c["B"])):
                new |= unknown
        if not new:
            break
        known |= new
    wanted = outputs & set(signals)
    if wanted <= known:
        return "VERIFIED"
    if p ** len(signals) > most:
        return "UNKNOWN"
    seen: dict[tuple, tuple] = {}
    value = lambda x, v: sum(c * (1 if s == 0 else v[s]) for s, c in x.items())
    for values in product(range(p), repeat=len(signals)):
        v = dict(zip(signals, values, strict=True))
        if all((value(c["A"], v) * value(c["B"], v) - value(c["C"], v)) % p == 0 for c in cons.values()):
            key, out = tuple(v[s] for s in signals if s in inputs), tuple(v[s] for s in signals if s in wanted)
            if seen.setdefault(key, out) != out:
                return "FAILED"
    return "VERIFIED"


def verdicts(terms: DataFrame, parts: DataFrame, roles: DataFrame, p: int = 257, most: int = 200_000) -> DataFrame:
    """(part_id, result, n_constraints): each part (coni, part_id) checked by itself; roles: (part_id, signal, role in or out)."""
    rows = terms.join(parts, "coni").join(roles, ["part_id", "signal"], "left")

    def check(df: pd.DataFrame) -> pd.DataFrame:
        ins, outs = ({int(s) for s in df.loc[df["role"] == r, "signal"]} for r in ("in", "out"))
        result = check_small(df.drop_duplicates(["coni", "part", "signal"]), ins, outs, p, most)
        return pd.DataFrame({"part_id": [int(df["part_id"].iloc[0])], "result": [result], "n_constraints": [df["coni"].nunique()]})

    return rows.groupBy("part_id").applyInPandas(check, "part_id long, result string, n_constraints long")


def shared_verdicts(results: DataFrame, classes: DataFrame) -> DataFrame:
    """(part_id, result): the verdict of each class's representative, for all of its members."""
    return classes.join(results.select(F.col("part_id").alias("class_id"), "result"), "class_id").select("part_id", "result")


def report(results: DataFrame) -> DataFrame:
    """(result, parts, constraints, mean_constraints, most_constraints)."""
    return results.groupBy("result").agg(F.count("*").alias("parts"), F.sum("n_constraints").alias("constraints"), F.round(F.avg("n_constraints"), 1).alias("mean_constraints"), F.max("n_constraints").alias("most_constraints"))
