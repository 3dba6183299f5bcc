"""Elimination of linear constraints by substitution.

A substitution is rows (from_sig, signal, coef): from_sig = sum of coef * signal, signal 0 for the constant.
Connected clusters of linear constraints are independent, and each is eliminated exactly in one grouped task.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.field import Field
from ..plans.fixpoint import cut, drop, ranked
from .graph import components, constraint_components


def substitutions_ok(subs: DataFrame) -> DataFrame:
    """Substitutions whose right side does not hold their own signal."""
    bad = subs.where("from_sig = signal").select("from_sig")
    return subs.join(bad, "from_sig", "left_anti")


def substituted(terms: DataFrame, subs: DataFrame, f: Field) -> DataFrame:
    """Terms (coni, part, signal, coef) with every occurrence of from_sig replaced: one join and one sum."""
    s = subs.select(F.col("from_sig").alias("signal"), F.col("signal").alias("to"), F.col("coef").alias("by"), F.lit(True).alias("hit"))
    rows = terms.join(s, "signal", "left").select("coni", "part", F.when(F.col("hit"), F.col("to")).otherwise(F.col("signal")).alias("signal"), F.when(F.col("hit"), f.mul("coef", "by")).otherwise(F.col("coef")).alias("coef"))
    return rows.groupBy("coni", "part", "signal").agg(f.sum("coef").alias("coef")).where("coef <> 0")


def substituted_products(acir: DataFrame, subs: DataFrame, f: Field) -> DataFrame:
    """Sums of products (coni, kind, s1, s2, coef) with both slots of a product, and linear terms, replaced."""
    s = subs.select(F.col("from_sig").alias("s"), F.col("signal").alias("to"), F.col("coef").alias("by"), F.lit(True).alias("hit"))
    out = acir.select("coni", F.when(F.col("kind") == "lin", F.lit(0).cast("long")).otherwise(F.col("s1")).alias("x"), F.when(F.col("kind") == "lin", F.col("s1")).otherwise(F.col("s2")).alias("y"), "coef")
    for slot in ("x", "y"):
        hit = out.join(s, out[slot] == s["s"], "left")
        out = hit.select("coni", *[(F.when(F.col("hit"), F.col("to")).otherwise(F.col(c)) if c == slot else F.col(c)).alias(c) for c in ("x", "y")], F.when(F.col("hit"), f.mul("coef", "by")).otherwise(F.col("coef")).alias("coef"))
    return fixed_products(out.select("coni", "x", "y", "coef"), f)


def fixed_products(rows: DataFrame, f: Field) -> DataFrame:
    """(coni, kind, s1, s2, coef) from (coni, x, y, coef): pairs in order, products with the constant linear, zeros gone."""
    x, y = F.least("x", "y"), F.greatest("x", "y")
    total = rows.select("coni", x.alias("x"), y.alias("y"), "coef").groupBy("coni", "x", "y").agg(f.sum("coef").alias("coef")).where("coef <> 0")
    lin = F.col("x") == 0
    return total.select("coni", F.when(lin, "lin").otherwise("mul").alias("kind"), F.when(lin, F.col("y")).otherwise(F.col("x")).alias("s1"), F.when(~lin, F.col("y")).alias("s2"), "coef")


def solved_for(terms: DataFrame, pivots: DataFrame, f: Field) -> DataFrame:
    """(coni, from_sig, signal, coef): linear constraints (part C) solved for their pivot (coni, signal)."""
    p = pivots.select("coni", F.col("signal").alias("from_sig"))
    rows = terms.where("part = 'C'").join(p, "coni")
    lead = rows.where("signal = from_sig").select("coni", F.col("coef").alias("lead"))
    return rows.where("signal <> from_sig").join(lead, "coni").select("coni", "from_sig", "signal", f.neg(f.div("coef", "lead")).alias("coef"))


def fixed_constraints(terms: DataFrame, f: Field) -> DataFrame:
    """Zeros gone; a factor that is empty empties the other; a factor that is constant folds into C."""
    rows = terms.where("coef <> 0")
    has = lambda p: F.bool_or(F.col("part") == p)
    only = lambda p: ~F.coalesce(F.bool_or((F.col("part") == p) & (F.col("signal") != 0)), F.lit(False))
    k = lambda p: F.coalesce(F.max(F.when((F.col("part") == p) & (F.col("signal") == 0), F.col("coef"))), F.lit(0))
    flags = rows.groupBy("coni").agg(has("A").alias("a"), has("B").alias("b"), only("A").alias("ca"), only("B").alias("cb"), k("A").alias("ka"), k("B").alias("kb"))
    full = rows.join(flags, "coni")
    keep = full.where("part = 'C' or (a and b and not ca and not cb)").select("coni", "part", "signal", "coef")
    by = F.when(F.col("ca"), F.col("ka")).otherwise(F.col("kb"))
    other = full.where("a and b and (ca or cb) and part = if(ca, 'B', 'A')").select("coni", F.lit("C").alias("part"), "signal", f.neg(f.mul("coef", by)).alias("coef"))
    return keep.unionByName(other).groupBy("coni", "part", "signal").agg(f.sum("coef").alias("coef")).where("coef <> 0")


def merged_equalities(terms: DataFrame, equal: DataFrame, forbidden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((from_sig, signal, coef), (s1, s2)): classes of signals tied by x = y constraints (coni) collapse onto their least
    forbidden member, else their least; ties between forbidden members stay as equalities."""
    pair = terms.join(equal.select("coni"), "coni", "left_semi").groupBy("coni").agg(F.min("signal").alias("a"), F.max("signal").alias("b"))
    found = cut(components(pair, "a", "b"))
    marked = found.join(forbidden.select(F.col("signal").alias("node"), F.lit(True).alias("keep")).distinct(), "node", "left")
    rep = marked.groupBy("component").agg(F.coalesce(F.min(F.when(F.col("keep"), F.col("node"))), F.min("node")).alias("rep"))
    rows = marked.join(rep, "component").where("node <> rep")
    subs = rows.where("keep is null").select(F.col("node").alias("from_sig"), F.col("rep").alias("signal"), F.lit(1).cast("long").alias("coef"))
    left = rows.where("keep").select(F.col("rep").alias("s1"), F.col("node").alias("s2"))
    return subs, left


def constant_substitutions(terms: DataFrame, fixed: DataFrame, forbidden: DataFrame, f: Field) -> DataFrame:
    """(from_sig, signal, coef) from constraints x = c (coni) whose signal is not forbidden; the first of a signal counts."""
    rows = terms.where("part = 'C'").join(fixed.select("coni"), "coni", "left_semi")
    flat = rows.groupBy("coni").agg(F.max("signal").alias("s"), F.max_by("coef", "signal").alias("lead"), F.coalesce(F.max(F.when(F.col("signal") == 0, F.col("coef"))), F.lit(0)).alias("k"))
    one = flat.join(forbidden.select(F.col("signal").alias("s")), "s", "left_anti").groupBy("s").agg(F.min_by(F.struct("lead", "k"), "coni").alias("x"))
    return one.select(F.col("s").alias("from_sig"), F.lit(0).cast("long").alias("signal"), f.neg(f.div("x.k", "x.lead")).alias("coef"))


def eliminate(rows: list[tuple[int, dict[int, int]]], forbidden: set[int], p: int, sparse: bool = False) -> tuple[dict[int, dict[int, int]], list[dict[int, int]]]:
    """Exact elimination of linear forms that are 0: (substitutions without eliminated signals on their right, leftovers).

    Constraints are taken in order; the pivot is the greatest signal that is not forbidden, or with ``sparse`` the rarest.
    ``held`` has the substitutions that hold a signal on their right, so a pivot visits these alone.
    """
    count: dict[int, int] = {}
    for _, form in rows:
        for s in form:
            count[s] = count.get(s, 0) + 1
    subs: dict[int, dict[int, int]] = {}
    held: dict[int, set[int]] = {}
    rest = []
    for _, given in sorted(rows):
        form = {}
        for s, c in given.items():
            for t, b in (subs[s] if s in subs else {s: 1}).items():
                if v := (form.get(t, 0) + c * b) % p:
                    form[t] = v
                else:
                    form.pop(t, None)
        free = [s for s in form if s and s not in forbidden]
        if not free:
            if form:
                rest.append(form)
            continue
        pivot = min(free, key=lambda s: (count.get(s, 0), -s)) if sparse else max(free)
        scale = -pow(form.pop(pivot), -1, p) % p
        new = {s: c * scale % p for s, c in form.items()}
        for at in held.pop(pivot, ()):
            right = subs[at]
            c = right.pop(pivot)
            for s, b in new.items():
                if v := (right.get(s, 0) + c * b) % p:
                    right[s] = v
                    held.setdefault(s, set()).add(at)
                elif right.pop(s, 0):
                    held[s].discard(at)
        subs[pivot] = new
        for s in new:
            held.setdefault(s, set()).add(pivot)
    return subs, rest


def linear_elimination(linear: DataFrame, forbidden: DataFrame, p: int = 257, sparse: bool = False) -> DataFrame:
    """(cluster, kind, from_sig, signal, coef) over clusters of linear constraints (coni, signal, coef) that share signals:
    kind ``sub`` for substitutions, ``left`` for constraints on forbidden signals alone (from_sig numbers them)."""
    inc = linear.where("signal <> 0").select("coni", "signal").distinct()
    parts = constraint_components(inc)
    marks = forbidden.select("signal", F.lit(True).alias("keep")).distinct()
    rows = linear.join(parts, "coni").join(marks, "signal", "left")

    def solve(df: pd.DataFrame) -> pd.DataFrame:
        forms: dict[int, dict[int, int]] = {}
        for coni, signal, coef in df[["coni", "signal", "coef"]].itertuples(index=False):
            forms.setdefault(int(coni), {})[int(signal)] = int(coef)
        fixed = {int(s) for s in df.loc[df["keep"] == True, "signal"]}  # noqa: E712
        subs, rest = eliminate(list(forms.items()), fixed, p, sparse)
        cluster = int(df["component"].iloc[0])
        out = [(cluster, "sub", s, t, c) for s, right in subs.items() for t, c in (right or {0: 0}).items()]
        out += [(cluster, "left", i, t, c) for i, form in enumerate(rest) for t, c in form.items()]
        return pd.DataFrame(out, columns=["cluster", "kind", "from_sig", "signal", "coef"])

    return rows.groupBy("component").applyInPandas(solve, "cluster long, kind string, from_sig long, signal long, coef long")


def simplified(terms: DataFrame, forbidden: DataFrame, p: int = 257, most: int = 1000, plonk: bool = False) -> DataFrame:
    """Rounds of elimination until no linear constraint gives a substitution: the terms that stay.

    plonk: only linear constraints of at most two signals are eliminated. Linear constraints without a free signal stay as
    they are, names included: no substitution touches them, so no round takes them up again.
    """
    f = Field(p)
    state = cut(fixed_constraints(terms, f))
    for _ in range(most):
        shape = state.groupBy("coni").agg(F.bool_or(F.col("part") == "A").alias("a"), F.bool_or(F.col("part") == "B").alias("b"), F.count_if((F.col("part") == "C") & (F.col("signal") != 0)).alias("n"))
        linear = shape.where("not (a and b)" + (" and n <= 2" if plonk else "")).select("coni")
        lin = state.where("part = 'C'").join(linear, "coni", "left_semi")
        free = lin.where("signal <> 0").join(forbidden.select("signal"), "signal", "left_anti").select("coni").distinct()
        busy = cut(lin.join(free, "coni", "left_semi"))
        if busy.isEmpty():
            drop(busy)
            return state
        solved = cut(linear_elimination(busy.select("coni", "signal", "coef"), forbidden, p))
        subs = solved.where("kind = 'sub'").select("from_sig", "signal", "coef")
        kept = substituted(state.join(busy.select("coni").distinct(), "coni", "left_anti"), subs, f)
        base = state.agg(F.max("coni")).first()[0] + 1
        rest = solved.where("kind = 'left'")
        names = ranked(rest.select("cluster", "from_sig").distinct(), ["cluster", "from_sig"], "__place")
        left = rest.join(names, ["cluster", "from_sig"]).select((F.col("__place") + base).alias("coni"), F.lit("C").alias("part"), "signal", "coef")
        before, state = state, cut(fixed_constraints(kept.unionByName(left), f))
        drop(before, busy, solved)
    return state


def dense_witness(terms: DataFrame) -> Column | DataFrame:
    """(old, new): signals that stay, renumbered without gaps in their order."""
    from .relational import dense_ids

    return dense_ids(terms.where("signal <> 0").select("signal"), ["signal"]).select(F.col("signal").alias("old"), F.col("id").alias("new"))
