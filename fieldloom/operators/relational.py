"""Predicates, projections, joins, groupings and rankings over constraint tables.

Tables as in ``sources.derived``: terms (coni, part, signal, coef), acir (coni, kind, s1, s2, coef), incidence
(coni, signal). Signal 0 is the constant: it takes part in the algebra, never in incidence or graphs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.field import Field
from ..plans.fixpoint import ranked


def joined(values: Column, sep: str = ",") -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), sep)


def sorted_list(value: Column | str) -> Column:
    """Aggregate: the sorted values as an array."""
    return F.sort_array(F.collect_list(value))


# --- signals of constraints ---------------------------------------------------------------------------------


def incidence(terms: DataFrame) -> DataFrame:
    return terms.where("signal <> 0").select("coni", "signal").distinct()


def acir_incidence(acir: DataFrame, kind: str | None = None) -> DataFrame:
    """Signals of linear and product terms, or of one kind."""
    rows = acir if kind is None else acir.where(F.col("kind") == kind)
    both = rows.select("coni", F.explode(F.array("s1", "s2")).alias("signal"))
    return both.where("signal is not null and signal <> 0").distinct()


def nonlinear(terms: DataFrame) -> DataFrame:
    """Constraints with terms in both factors."""
    return terms.groupBy("coni").agg(F.bool_or(F.col("part") == "A").alias("a"), F.bool_or(F.col("part") == "B").alias("b")).where("a and b").select("coni")


def constraints(terms: DataFrame) -> DataFrame:
    """(coni, signals, nonlinear): a row for each constraint that holds a signal, with the set of its signals."""
    of = lambda part: F.bool_or(F.col("part") == part)
    rows = terms.groupBy("coni").agg(F.collect_set(F.when(F.col("signal") != 0, F.col("signal"))).alias("signals"), (of("A") & of("B")).alias("nonlinear"))
    return rows.where(F.size("signals") > 0)


def acir_nonlinear(acir: DataFrame) -> DataFrame:
    return acir.where("kind = 'mul'").select("coni").distinct()


def acir_linear(acir: DataFrame) -> DataFrame:
    return acir.select("coni").distinct().join(acir_nonlinear(acir), "coni", "left_anti")


def empty(constraints: DataFrame, terms: DataFrame) -> DataFrame:
    return constraints.select("coni").join(terms.select("coni"), "coni", "left_anti")


def profile(terms: DataFrame, p: int = 257) -> DataFrame:
    """One row a constraint with what its predicates need: counts by part, the constant, sums and coefficients of C."""
    c = F.col("part") == "C"
    zero = F.col("signal") == 0
    return terms.groupBy("coni").agg(
        F.count_if(F.col("part") == "A").alias("n_a"),
        F.count_if(F.col("part") == "B").alias("n_b"),
        F.count_if(c).alias("n_c"),
        F.count_if(c & ~zero).alias("n_signals"),
        F.count_if(c & zero).alias("n_const"),
        F.bool_or(zero).alias("has_const"),
        Field(p).canon(F.sum(F.when(c & ~zero, F.col("coef")))).alias("sum_c"),
    )


def _linear() -> Column:
    return (F.col("n_a") == 0) | (F.col("n_b") == 0)


def equalities(terms: DataFrame, p: int = 257) -> DataFrame:
    """x = y: linear, no constant, two coefficients that cancel."""
    return profile(terms, p).where(_linear() & (F.col("n_signals") == 2) & (F.col("n_const") == 0) & (F.col("sum_c") == 0)).select("coni")


def constant_equalities(terms: DataFrame, p: int = 257) -> DataFrame:
    """x = c: linear with one signal, with or without a constant."""
    return profile(terms, p).where(_linear() & (F.col("n_signals") == 1)).select("coni")


def constant_expressions(terms: DataFrame, p: int = 257) -> DataFrame:
    return profile(terms, p).where(_linear() & (F.col("n_signals") == 0) & (F.col("n_const") == 1)).select("coni")


def relaxed_equalities(terms: DataFrame, p: int = 257) -> DataFrame:
    """x = +-y + c: two coefficients that are equal or cancel."""
    c = terms.where("part = 'C' and signal <> 0").groupBy("coni").agg(F.count("*").alias("n"), F.min("coef").alias("low"), F.max("coef").alias("high"))
    plain = terms.groupBy("coni").agg(F.bool_or(F.col("part") == "A").alias("a"), F.bool_or(F.col("part") == "B").alias("b")).where("not (a and b)")
    return c.where((F.col("n") == 2) & ((F.col("low") == F.col("high")) | (F.col("low") + F.col("high") == p))).join(plain, "coni", "left_semi").select("coni")


def coefficient_links(terms: DataFrame, coefficients: list[int]) -> DataFrame:
    """(coni, link, candidate): a link is linear with two signals whose coefficients are all among the given; a
    candidate has one of them in C."""
    among = F.col("coef").isin(coefficients)
    c = (F.col("part") == "C") & (F.col("signal") != 0)
    rows = terms.groupBy("coni").agg(F.count_if(c).alias("n"), F.count_if(c & among).alias("k"), F.count_if(F.col("part") == "A").alias("n_a"), F.count_if(F.col("part") == "B").alias("n_b"))
    return rows.select("coni", (_linear() & (F.col("n") == 2) & (F.col("k") == 2)).alias("link"), (F.col("k") > 0).alias("candidate"))


def plonk_ready(terms: DataFrame) -> DataFrame:
    """Linear constraints of at most two signals."""
    return profile(terms).where(_linear() & (F.col("n_signals") <= 2)).select("coni")


def with_constant(terms: DataFrame) -> DataFrame:
    return profile(terms).where("has_const").select("coni")


def ordered_factors(terms: DataFrame) -> DataFrame:
    """(coni, ordered): whether the coefficients of A and B differ as multisets, so that the factors have an order."""
    of = lambda part: F.sort_array(F.collect_list(F.when(F.col("part") == part, F.col("coef"))))
    return terms.groupBy("coni").agg(of("A").alias("a"), of("B").alias("b")).select("coni", (F.col("a") != F.col("b")).alias("ordered"))


def kinds(terms: DataFrame) -> DataFrame:
    """(coni, kind): number, signal, linear or quadratic."""
    sure = profile(terms)
    single = terms.where("part = 'C' and signal <> 0 and coef = 1").groupBy("coni").agg(F.count("*").alias("ones"))
    kind = F.when(~_linear(), "quadratic").when(F.col("n_signals") == 0, "number").when((F.col("n_signals") == 1) & (F.col("n_const") == 0) & (F.coalesce("ones", F.lit(0)) == 1), "signal").otherwise("linear")
    return sure.join(single, "coni", "left").select("coni", kind.alias("kind"))


def coefficients(terms: DataFrame) -> DataFrame:
    """(coni, part, coefs): sorted, as text."""
    return terms.groupBy("coni", "part").agg(joined(sorted_list("coef")).alias("coefs"))


def renamed(terms: DataFrame, mapping: DataFrame) -> DataFrame:
    """Signals by ``mapping`` (old, new); those without an entry are dropped, the constant stays."""
    kept = terms.where("signal = 0")
    moved = terms.where("signal <> 0").join(mapping.select(F.col("old").alias("signal"), "new"), "signal")
    return moved.select("coni", "part", F.col("new").alias("signal"), "coef").unionByName(kept)


def offset(terms: DataFrame, by: int) -> DataFrame:
    return terms.withColumn("signal", F.when(F.col("signal") == 0, F.lit(0).cast("long")).otherwise(F.col("signal") + by))


def numbered(signals: DataFrame) -> DataFrame:
    """(old, new): signals (signal, role) numbered from 1, outputs first, then inputs, then the rest.

    Counts by role give the first number of a role; within it a rank follows ranges of signals, so no task ranks all.
    """
    rank = F.when(F.col("role") == "output", 0).when(F.col("role") == "input", 1).otherwise(2)
    rows = signals.select("signal", rank.alias("r"), F.floor(F.col("signal") / 65536).alias("range"))
    counts = rows.groupBy("r", "range").agg(F.count("*").alias("n"))
    before = Window.orderBy("r", "range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("r", "range").orderBy("signal"))
    return rows.withColumn("own", own).join(starts, ["r", "range"]).select(F.col("signal").alias("old"), (F.col("start") + F.col("own")).alias("new"))


def subcircuit(terms: DataFrame, chosen: DataFrame, signals: DataFrame) -> DataFrame:
    """Terms of the chosen constraints, their signals renumbered."""
    part = terms.join(chosen.select("coni"), "coni", "left_semi")
    used = incidence(part).select("signal").distinct()
    return renamed(part, numbered(signals.join(used, "signal", "left_semi")))


# --- joins --------------------------------------------------------------------------------------------------


def holders(inc: DataFrame) -> DataFrame:
    """(signal, conis): the inverted index, as sorted text."""
    return inc.groupBy("signal").agg(joined(sorted_list("coni")).alias("conis"))


def only_linear(acir: DataFrame) -> DataFrame:
    """(signal, coni): signals of non-linear constraints that no product holds."""
    rows = acir.join(acir_nonlinear(acir), "coni", "left_semi")
    lin, mul = acir_incidence(rows, "lin"), acir_incidence(rows, "mul")
    return lin.join(mul.select("signal").distinct(), "signal", "left_anti").select("signal", "coni")


def shared_signals(inc: DataFrame) -> DataFrame:
    """(src, dst, weight): pairs of constraints src < dst and how many signals they share.

    A signal of d constraints gives d (d - 1) / 2 pairs; fixpoints over the graph use the incidence instead.
    """
    a, b = inc.select("signal", F.col("coni").alias("src")), inc.select("signal", F.col("coni").alias("dst"))
    return a.join(b, "signal").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))


def shared_constraints(inc: DataFrame) -> DataFrame:
    """(s1, s2), s1 < s2: signals that share a constraint."""
    a, b = inc.select("coni", F.col("signal").alias("s1")), inc.select("coni", F.col("signal").alias("s2"))
    return a.join(b, "coni").where("s1 < s2").select("s1", "s2").distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")]))


def part_neighbours(inc: DataFrame, parts: DataFrame) -> DataFrame:
    """(src, dst), src < dst: parts (coni, part_id) that share a signal."""
    held = inc.join(parts, "coni").select("signal", "part_id").distinct()
    a, b = held.select("signal", F.col("part_id").alias("src")), held.select("signal", F.col("part_id").alias("dst"))
    return a.join(b, "signal").where("src < dst").select("src", "dst").distinct()


def weighted_part_neighbours(inc: DataFrame, parts: DataFrame, weights: DataFrame) -> DataFrame:
    """(src, dst, weight) both ways; weight: how many of the constraints ``weights`` (coni) the target part has."""
    n = parts.join(weights.select("coni"), "coni", "left_semi").groupBy(F.col("part_id").alias("dst")).agg(F.count("*").alias("weight"))
    return both_ways(part_neighbours(inc, parts)).join(n, "dst", "left").select("src", "dst", F.coalesce("weight", F.lit(0)).alias("weight"))


def common_labels(left: DataFrame, right: DataFrame) -> DataFrame:
    """(label, n_left, n_right) of the labels in both colourings."""
    n = lambda df, name: df.groupBy("label").agg(F.count("*").alias(name))
    return n(left, "n_left").join(n(right, "n_right"), "label")


def viable_pairs(left: DataFrame, right: DataFrame, ordered: bool = True) -> DataFrame:
    """(lconi, rconi, lsignal, rsignal): signals of two constraints that stand in the same slots with the same coefficients.

    ordered: slots are the parts. Else a signal of both factors has one slot with its sorted pair of coefficients, and
    one of a single factor has another. pairs of constraints are given by a column ``pair`` in both tables.
    """

    def slots(df: DataFrame) -> DataFrame:
        rows = df.where("signal <> 0")
        if ordered:
            return rows.select("pair", "coni", "signal", "part", F.col("coef").cast("string").alias("c"))
        ab = rows.where("part <> 'C'").groupBy("pair", "coni", "signal").agg(F.count("*").alias("n"), joined(sorted_list("coef")).alias("c"))
        ab = ab.select("pair", "coni", "signal", F.when(F.col("n") == 2, "both").otherwise("one").alias("part"), "c")
        return ab.unionByName(rows.where("part = 'C'").select("pair", "coni", "signal", "part", F.col("coef").cast("string").alias("c")))

    def signature(df: DataFrame, side: str) -> DataFrame:
        sig = slots(df).groupBy("pair", "coni", "signal").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "part", "c"))), ";").alias("sig"))
        return sig.select("pair", F.col("coni").alias(f"{side}coni"), F.col("signal").alias(f"{side}signal"), "sig")

    return signature(left, "l").join(signature(right, "r"), ["pair", "sig"]).select("pair", "lconi", "rconi", "lsignal", "rsignal")


def arc_signals(inc: DataFrame, parts: DataFrame, arcs: DataFrame) -> DataFrame:
    """(node, signal, role): signals that an arc's ends share are outputs of its source and inputs of its target."""
    held = inc.join(parts, "coni").select("part_id", "signal").distinct()
    on = arcs.join(held.select(F.col("part_id").alias("src"), "signal"), "src").join(held.select(F.col("part_id").alias("dst"), "signal"), ["dst", "signal"])
    out = on.select(F.col("src").alias("node"), "signal", F.lit("out").alias("role")).unionByName(on.select(F.col("dst").alias("node"), "signal", F.lit("in").alias("role")))
    return out.distinct()


def as_of(values: DataFrame, starts: DataFrame, value: str = "coni", start: str = "start", name: str = "name", width: int = 65_536) -> DataFrame:
    """(value, start, name): the entry with the greatest start at or below each value; without one, none.

    Values and starts are merged within ranges of ``width`` and the last start is carried along each range in order;
    a running last over the ranges carries it on. Neither side is sorted as a whole, and no pairs are formed.
    """
    entry = F.struct(F.col(start).alias("s"), F.col(name).alias("n"))
    v = values.select(F.col(value).alias("at"), F.lit(1).alias("turn"), F.lit(None).cast(starts.select(entry.alias("x")).schema["x"].dataType).alias("x"))
    s = starts.where(F.col(start).isNotNull()).select(F.col(start).alias("at"), F.lit(0).alias("turn"), entry.alias("x"))
    rows = v.unionByName(s).withColumn("b", F.floor(F.col("at") / width))
    last = rows.where("turn = 0").groupBy("b").agg(F.max(F.struct("at", "x"))["x"].alias("x"))
    blocks = rows.select("b").distinct().join(last, "b", "left")
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("b", F.last("x", ignorenulls=True).over(before).alias("prior"))
    along = F.last("x", ignorenulls=True).over(Window.partitionBy("b").orderBy("at", "turn", "x").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("near", along).where("turn = 1").join(carried, "b", "left").withColumn("y", F.coalesce("near", "prior"))
    return out.where("y is not null").select(F.col("at").alias(value), F.col("y.s").alias(start), F.col("y.n").alias(name))


# --- groupings and rankings ---------------------------------------------------------------------------------


def histogram(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(F.col(by).alias("value")).agg(F.count("*").alias("n"))


def coefficient_classes(terms: DataFrame) -> DataFrame:
    """(class_id, coni): constraints with equal coefficients by part; a class is named by its least constraint."""
    key = lambda p: F.array_join(F.sort_array(F.collect_list(F.when(F.col("part") == p, F.col("coef")))).cast("array<string>"), ",")
    keys = terms.groupBy("coni").agg(F.concat_ws("|", key("A"), key("B"), key("C")).alias("k"))
    low = keys.groupBy("k").agg(F.min("coni").alias("class_id"))
    return keys.join(low, "k").select("class_id", "coni")


def class_sizes(classes: DataFrame) -> DataFrame:
    """(size, classes, members, squares) over the classes of each size."""
    sizes = classes.groupBy("class_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("classes"), F.sum("size").alias("members"), F.sum(F.col("size") * F.col("size")).alias("squares"))


def multiset_classes(members: DataFrame, group: str, label: str) -> DataFrame:
    """(class_id, group): groups whose members have equal multisets of labels."""
    counts = members.groupBy(group, label).agg(F.count("*").alias("n"))
    keys = counts.groupBy(group).agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws("x", F.col(label).cast("string"), "n"))), ";").alias("k"))
    low = keys.groupBy("k").agg(F.min(group).alias("class_id"))
    return keys.join(low, "k").select("class_id", group)


def degrees(inc: DataFrame) -> DataFrame:
    return inc.groupBy("signal").agg(F.count("*").alias("degree"))


def degree_average(inc: DataFrame, kind: str) -> DataFrame:
    """One row (kind, value): floored mean, lower median or smallest mode of the signals' degrees."""
    d = degrees(inc)
    if kind == "mean":
        out = d.agg(F.floor(F.sum("degree") / F.count("*")).cast("long").alias("value"))
    elif kind == "median":
        out = d.agg(F.expr("percentile_disc(0.5) within group (order by degree)").cast("long").alias("value"))
    else:
        out = d.groupBy("degree").agg(F.count("*").alias("n")).agg(F.max_by("degree", F.struct("n", -F.col("degree"))).alias("value"))
    return out.select(F.lit(kind).alias("kind"), "value")


def heaviest_signals(inc: DataFrame, ratio: float, n_signals: int) -> DataFrame:
    """Signals of the highest degrees, whole degrees at a time, until one step exceeds ``ratio`` of all signals."""
    d = degrees(inc)
    steps = d.groupBy("degree").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("degree")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return d.join(steps.withColumn("before", before).where(F.col("before") <= ratio * n_signals).select("degree"), "degree").select("signal", "degree")


def occurrences(inc: DataFrame) -> DataFrame:
    """(signal, n, first): how many constraints hold it, and the least of them."""
    return inc.groupBy("signal").agg(F.count("*").alias("n"), F.min("coni").alias("first"))


def monomials_to_add(acir: DataFrame) -> int | DataFrame:
    """(added): distinct products but each constraint's first, which its own product can hold."""
    first = F.row_number().over(Window.partitionBy("coni").orderBy("s1", "s2"))
    return acir.where("kind = 'mul'").withColumn("k", first).where("k > 1").agg(F.countDistinct("s1", "s2").alias("added"))


def summed(terms: DataFrame, p: int = 257) -> DataFrame:
    """Coefficient-wise sum of terms with equal keys; zeros go."""
    keys = [c for c in terms.columns if c != "coef"]
    return terms.groupBy(*keys).agg(Field(p).sum("coef").alias("coef")).where("coef <> 0")


def uncovered(constraints: DataFrame, parts: DataFrame) -> DataFrame:
    """Constraints that no part holds: none after a sound step."""
    return constraints.select("coni").join(parts.select("coni"), "coni", "left_anti")


def mismatched_classes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(label, n_left, n_right) where two colourings differ in the size of a class."""
    n = lambda df, name: df.groupBy("label").agg(F.count("*").alias(name))
    both = n(left, "n_left").join(n(right, "n_right"), "label", "full").fillna(0, ["n_left", "n_right"])
    return both.where("n_left <> n_right")


def dense_ids(df: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys with ids from 1 in the order of the keys."""
    return ranked(df.select(*keys).distinct(), keys, "id")


def greatest_signal(terms: DataFrame) -> DataFrame:
    """(coni, signal): the greatest signal of each linear constraint, the pivot of the plain elimination."""
    return terms.where("part = 'C' and signal <> 0").groupBy("coni").agg(F.max("signal").alias("signal"))


def rarest_signal(terms: DataFrame) -> DataFrame:
    """(coni, signal): the signal in the fewest constraints, ties to the greatest: the pivot of the sparse elimination."""
    inc = terms.where("part = 'C' and signal <> 0").select("coni", "signal").distinct()
    n = inc.groupBy("signal").agg(F.count("*").alias("n"))
    return inc.join(n, "signal").groupBy("coni").agg(F.min_by("signal", F.struct("n", -F.col("signal"))).alias("signal"))


def by_distance_vectors(distances: DataFrame) -> DataFrame:
    """(node, place): nodes in order of their sorted distances, then of their id. distances: (node, source, d)."""
    vectors = distances.groupBy("node").agg(F.sort_array(F.collect_list("d")).alias("v"))
    return ranked(vectors, ["v", "node"], "place").select("node", "place")
