"""Lowering between forms of constraints, and degree reduction of expression graphs."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.field import Field
from ..plans.fixpoint import ranked


def naive_products(acir: DataFrame, f: Field) -> DataFrame:
    """(coni, part, signal, coef) in the form A * B = C from sums of products that are 0.

    A constraint's first product stays in A and B; each other distinct product has one auxiliary signal, and a
    constraint that defines it, shared by all. Auxiliary ids follow the greatest ones, in order of the products.
    """
    turn = F.row_number().over(Window.partitionBy("coni").orderBy("s1", "s2"))
    mul = acir.where("kind = 'mul'").withColumn("turn", turn)
    first, rest = mul.where("turn = 1"), mul.where("turn > 1")
    aux = ranked(rest.select("s1", "s2").distinct(), ["s1", "s2"], "rank")
    tops = acir.agg(F.max("coni").alias("top_c"), F.max(F.greatest("s1", F.coalesce("s2", F.lit(0)))).alias("top_s"))
    aux = aux.join(F.broadcast(tops)).select("s1", "s2", (F.col("top_s") + F.col("rank")).alias("aux"), (F.col("top_c") + F.col("rank")).alias("own"))
    row = lambda df, coni, part, signal, coef: df.select(F.col(coni).alias("coni"), F.lit(part).alias("part"), F.col(signal).alias("signal"), coef.cast("long").alias("coef"))
    one = F.lit(1)
    parts = [
        row(first, "coni", "A", "s1", F.col("coef")),
        row(first, "coni", "B", "s2", one),
        row(rest.join(aux, ["s1", "s2"]), "coni", "C", "aux", f.neg("coef")),
        row(acir.where("kind = 'lin'"), "coni", "C", "s1", f.neg("coef")),
        row(aux, "own", "A", "s1", one),
        row(aux, "own", "B", "s2", one),
        row(aux, "own", "C", "aux", one),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def star_products(acir: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((coni, part, signal, coef), residual): per constraint the signal of the most products becomes A, ties to the least,
    and what it is multiplied with B; products without it are the residual (coni, s1, s2, coef)."""
    mul = acir.where("kind = 'mul'").select("coni", "s1", "s2", "coef")
    votes = mul.select("coni", F.explode(F.array_distinct(F.array("s1", "s2"))).alias("signal")).groupBy("coni", "signal").agg(F.count("*").alias("n"))
    hub = votes.groupBy("coni").agg(F.min_by("signal", F.struct(-F.col("n"), "signal")).alias("hub"))
    rows = mul.join(hub, "coni")
    with_hub = (F.col("s1") == F.col("hub")) | (F.col("s2") == F.col("hub"))
    other = F.when(F.col("s1") == F.col("hub"), F.col("s2")).otherwise(F.col("s1"))
    b = rows.where(with_hub).select("coni", F.lit("B").alias("part"), other.alias("signal"), "coef")
    a = hub.select("coni", F.lit("A").alias("part"), F.col("hub").alias("signal"), F.lit(1).cast("long").alias("coef"))
    return a.unionByName(b), rows.where(~with_hub).select("coni", "s1", "s2", "coef")


def short_linear(terms: DataFrame, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(short, long): linear constraints of at most ``most`` signals, and the others."""
    n = terms.groupBy("coni").agg(F.count_if(F.col("signal") != 0).alias("n"))
    rows = terms.join(n, "coni")
    return rows.where(F.col("n") <= most).drop("n"), rows.where(F.col("n") > most).drop("n")


def chained_linear(terms: DataFrame) -> DataFrame:
    """(coni, step, signal, coef): linear constraints with more than three signals as chains of three.

    Step 1 adds the first two signals, in order, into an auxiliary one; each further step adds the next signal to it;
    the last step is what stays of the constraint, constant included. Auxiliary signals are negative: -(step), per constraint.
    """
    short, long = short_linear(terms)
    flat = short.select("coni", F.lit(0).cast("long").alias("step"), "signal", "coef")
    turn = F.row_number().over(Window.partitionBy("coni").orderBy("signal"))
    rows = long.where("signal <> 0").withColumn("k", turn).withColumn("n", F.count("*").over(Window.partitionBy("coni")))
    last = F.col("n") - 2
    step = F.least(F.greatest(F.col("k") - 1, F.lit(1)), last)
    own = rows.select("coni", step.cast("long").alias("step"), "signal", "coef")
    out_aux = rows.where("k >= 2 and k <= n - 2").select("coni", (F.col("k") - 1).cast("long").alias("step"), (-(F.col("k") - 1)).cast("long").alias("signal"), F.lit(-1).cast("long").alias("coef"))
    in_aux = rows.where("k >= 3 and k <= n - 1").select("coni", (F.col("k") - 1).cast("long").alias("step"), (-(F.col("k") - 2)).cast("long").alias("signal"), F.lit(1).cast("long").alias("coef"))
    const = long.where("signal = 0").join(rows.groupBy("coni").agg((F.max("n") - 2).cast("long").alias("step")), "coni").select("coni", "step", "signal", "coef")
    return flat.unionByName(own).unionByName(out_aux).unionByName(in_aux).unionByName(const)


def plonk_rows(terms: DataFrame) -> DataFrame:
    """(coni, s_a, coef_a, s_b, coef_b, s_c, coef_c, coef_cte) of linear constraints of at most three signals."""
    turn = F.row_number().over(Window.partitionBy("coni").orderBy("signal"))
    rows = terms.where("signal <> 0").withColumn("k", turn)
    pick = lambda i, c: F.max(F.when(F.col("k") == i, F.col(c)))
    wide = rows.groupBy("coni").agg(*(pick(i, c).alias(f"{n}_{x}") for i, x in enumerate("abc", 1) for n, c in (("s", "signal"), ("coef", "coef"))))
    const = terms.where("signal = 0").select("coni", F.col("coef").alias("k"))
    return wide.join(const, "coni", "left").withColumn("coef_cte", F.coalesce("k", F.lit(0))).drop("k")


# --- expression graphs: {"op", "values"} trees as tuples ----------------------------------------------------


def degree(expr: tuple, kept: dict[int, int]) -> int:
    """Degree of a tree: ("leaf", d), ("challenge",), ("exp", id), ("add" | "sub" | "neg" | "mul", child, ...)."""
    op = expr[0]
    if op == "leaf":
        return expr[1]
    if op == "challenge":
        return 0
    if op == "exp":
        return kept[expr[1]]
    parts = [degree(x, kept) for x in expr[1:]]
    return sum(parts) if op == "mul" else max(parts)


def used(exprs: dict[int, tuple], root: int) -> set[int]:
    """Expressions that the root needs, itself included."""
    seen, todo = set(), [root]

    def of(e: tuple) -> list[int]:
        return [e[1]] if e[0] == "exp" else [i for x in e[1:] if isinstance(x, tuple) for i in of(x)]

    while todo:
        if (i := todo.pop()) not in seen:
            seen.add(i)
            todo += of(exprs[i])
    return seen


def keep_for_degree(exprs: dict[int, tuple], dims: dict[int, int | None], root: int, d: int) -> set[int] | None:
    """The expressions to keep as columns (degree 1 where used) so that all have degree ``d`` at most, of least total
    dimension, then fewest; None if there is none. Exact at all sizes, by branch and bound."""
    need = sorted(used(exprs, root) - {root})
    candidates = [i for i in need if dims.get(i) is not None]

    def valid(keep: set[int]) -> bool:
        known: dict[int, int] = {}

        class Lazy(dict):
            def __missing__(self, i: int) -> int:
                if i not in known:
                    known[i] = degree(exprs[i], self)
                return 1 if i in keep and known[i] > 1 else known[i]

        lazy = Lazy()
        return degree(exprs[root], lazy) <= d and all(lazy[i] >= 0 and known[i] <= d for i in need if i in keep or i in known)

    # keeping more never breaks what is valid: a branch is left where all that it may still keep is too little or too dear
    order = sorted(candidates, key=lambda i: (-dims[i], i))
    best: tuple[int, int, list[int]] | None = None
    todo: list[tuple[int, frozenset[int]]] = [(0, frozenset())]
    while todo:
        at, keep = todo.pop()
        now = sum(dims[i] for i in keep), len(keep), sorted(keep)
        if (best is not None and now[:2] > best[:2]) or not valid(set(keep) | set(order[at:])):
            continue
        if valid(set(keep)):
            if best is None or now < best:
                best = now
        elif at < len(order):
            todo += [(at + 1, keep | {order[at]}), (at + 1, keep)]
    return None if best is None else set(best[2])


def best_degree(exprs: dict[int, tuple], dims: dict[int, int | None], root: int, most: int, q_dim: int) -> tuple[int, set[int], int] | None:
    """(degree, kept, cost) of the least cost (degree - 1) * q_dim + dimensions kept, over degrees 2 to ``most``."""
    found = None
    for d in range(2, most + 1):
        keep = keep_for_degree(exprs, dims, root, d)
        if keep is not None:
            cost = (d - 1) * q_dim + sum(dims[i] for i in keep)
            if found is None or cost < found[2]:
                found = d, keep, cost
    return found
