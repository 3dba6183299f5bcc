"""Colour refinement of constraints and signals, and equivalence of systems.

A colour is a string of the round before hashed to a label; labels are compared within one run only. Constraints
and signals are recoloured in turn from each other's colours and the coefficients between them, until the number of
classes on both sides stays. Factors without an order take a signal's coefficients in both as a sorted pair: that forgets
which signals share a factor, so colours alone prove a difference, never equality. Every mapping is checked term by term.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.field import Field
from ..plans.fixpoint import cut, drop, iterate, ranked, swept
from .graph import constraint_components
from .relational import ordered_factors

#: Rounds after which refinement to stable colours is given up with an error.
GUARD = 1000


def slots(terms: DataFrame) -> DataFrame:
    """(coni, signal, slot): what a signal is to a constraint, as text."""
    order = ordered_factors(terms)
    rows = terms.join(order, "coni")
    plain = rows.where("ordered").groupBy("coni", "signal").agg(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "part", F.col("coef").cast("string")))), ",").alias("slot"))
    ab = F.array_join(F.sort_array(F.collect_list(F.when(F.col("part") != "C", F.lpad(F.col("coef").cast("string"), 12, "0")))), "+")
    c = F.coalesce(F.max(F.when(F.col("part") == "C", F.col("coef"))).cast("string"), F.lit("-"))
    free = rows.where("not ordered").groupBy("coni", "signal").agg(F.concat(ab, F.lit("|"), c).alias("slot"))
    return plain.unionByName(free)


def _labelled(keys: DataFrame, name: str) -> DataFrame:
    """(name, color) from (name, key): a class is named by its least member, so colours are canonical."""
    low = keys.groupBy("key").agg(F.min(name).alias("color"))
    return keys.join(low, "key").select(name, "color")


def _key(*parts: Column) -> Column:
    """128 bits of two hashes in place of a long key."""
    text = F.concat_ws("#", *parts)
    return F.md5(text)


def _bag(*columns: str | Column) -> Column:
    """Aggregate: one text for equal multisets of rows: their number, and both halves of two 64-bit hashes summed."""
    sums = []
    for salt in (1, 2):
        h = F.xxhash64(F.lit(salt), *columns)
        sums += [F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    return F.concat_ws(":", F.count("*"), *sums)


def refined(terms: DataFrame, signals: DataFrame | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((coni, color), (signal, color)), stable unless ``most`` asks for so many rounds. signals: (signal, role) with first colours; without it all are alike.

    The constant keeps a colour of its own. Each round is two grouped sums of hashes over the incidence, so a constraint's
    or signal's neighbours are never gathered in one row, however many they are.
    """
    slot = cut(slots(terms))
    used = slot.select("signal").distinct()
    if signals is None:
        first = used.withColumn("key", F.when(F.col("signal") == 0, "const").otherwise("all"))
    else:
        first = used.join(signals, "signal", "left").withColumn("key", F.when(F.col("signal") == 0, "const").otherwise(F.coalesce("role", F.lit("none"))))
    sig = cut(_labelled(first.select("signal", "key"), "signal"))
    con, seen = None, None
    for _ in range(most or GUARD):
        around = slot.join(sig, "signal").groupBy("coni").agg(_bag("color", "slot").alias("bag"))
        if con is None:
            keys = around.select("coni", F.col("bag").alias("key"))
        else:
            keys = around.join(con, "coni").select("coni", _key(F.col("color").cast("string"), "bag").alias("key"))
        old, con = con, cut(_labelled(keys, "coni"))
        back = slot.join(con, "coni").groupBy("signal").agg(_bag("color", "slot").alias("bag"))
        gone, sig = sig, cut(_labelled(back.join(sig, "signal").select("signal", _key(F.col("color").cast("string"), "bag").alias("key")), "signal"))
        drop(*[x for x in (old, gone) if x is not None])
        now = con.agg(F.countDistinct("color")).first()[0], sig.agg(F.countDistinct("color")).first()[0]
        if now == seen:
            break
        seen = now
    else:
        if most is None:
            raise RuntimeError(f"colours are not stable after {GUARD} rounds")
    return con, sig


def refined_nodes(edges: DataFrame, nodes: DataFrame, most: int = 1000) -> DataFrame:
    """(node, color): refinement of a graph's nodes (node, color) by the colours at the ends of their arcs (src, dst)."""

    def step(state: DataFrame) -> DataFrame:
        far = edges.join(state.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_list("color")).alias("l"))
        keys = state.join(far, "node", "left").select("node", _key(F.col("color").cast("string"), F.coalesce(F.array_join(F.col("l").cast("array<string>"), ","), F.lit(""))).alias("key"))
        return _labelled(keys, "node")

    return iterate(nodes, step, lambda s: s.agg(F.countDistinct("color")).first(), most)


def equal_shapes(parts: DataFrame, terms: DataFrame) -> DataFrame:
    """(part_id, class_id): parts (coni, part_id) alike after one joint refinement of all of them, each with signals of
    its own: equal multisets of constraint colours. A class is named by its least part."""
    own = terms.join(parts, "coni")
    # a signal within a part becomes a signal of its own; the constant stays
    local = own.withColumn("signal", F.when(F.col("signal") == 0, F.lit(0).cast("long")).otherwise(F.abs(F.xxhash64("part_id", "signal")) + 1)).drop("part_id")
    con, _ = refined(local)
    counts = parts.join(con, "coni").groupBy("part_id", "color").agg(F.count("*").alias("n"))
    keys = counts.groupBy("part_id").agg(_key(F.array_join(F.sort_array(F.collect_list(F.concat_ws("x", F.col("color").cast("string"), "n"))), ";")).alias("key"))
    low = keys.groupBy("key").agg(F.min("part_id").alias("class_id"))
    return keys.join(low, "key").select("part_id", "class_id")


def _forms(terms: DataFrame) -> DataFrame:
    """(coni, form): a constraint's factors and linear part in full; factors without an order are sorted."""
    entry = F.struct("signal", "coef")
    side = lambda x: F.sort_array(F.collect_list(F.when(F.col("part") == x, entry)))
    whole = terms.groupBy("coni").agg(side("A").alias("a"), side("B").alias("b"), side("C").alias("c")).join(ordered_factors(terms), "coni")
    text = lambda x: F.to_json(F.struct(F.col(x).alias("x")))
    first = F.when(F.col("ordered"), text("a")).otherwise(F.least(text("a"), text("b")))
    second = F.when(F.col("ordered"), text("b")).otherwise(F.greatest(text("a"), text("b")))
    return whole.select("coni", F.concat_ws("#", first, second, text("c")).alias("form"))


def scale_free(terms: DataFrame, f: Field) -> DataFrame:
    """(coni, shape): what neither names nor a scaling of its parts nor a swap of its factors change: each part's number of
    terms, and ratios of sums of powers of its coefficients. Different shapes prove a difference, equal ones nothing."""
    powers = {1: f.canon("coef"), 2: f.mul("coef", "coef"), 3: f.mul("coef", f.mul("coef", "coef"))}
    power = lambda x, k: (F.sum(F.when(F.col("part") == x, powers[k])) % f.p).alias(f"{x}{k}")
    sums = terms.groupBy("coni").agg(*(F.count_if(F.col("part") == x).alias(f"{x}0") for x in "ABC"), *(power(x, k) for x in "ABC" for k in (1, 2, 3)))
    sums = sums.fillna(0)
    ratio = lambda x, y, z: F.when(F.col(z) != 0, f.div(f.mul(x, y), z)).otherwise(-1)
    text = lambda x: F.concat_ws(",", f"{x}0", ratio(f"{x}1", f"{x}1", f"{x}2"), ratio(f"{x}1", f"{x}2", f"{x}3"))
    return sums.select("coni", F.concat_ws("#", F.least(text("A"), text("B")), F.greatest(text("A"), text("B")), text("C")).alias("shape"))


def surely_different(left: DataFrame, right: DataFrame, f: Field) -> bool:
    """Whether shapes of the constraints tell two systems apart, before these are scaled."""
    marked = [scale_free(df, f).groupBy("shape").agg(F.count("*").alias("n")).withColumn("n", F.col("n") * sign) for df, sign in ((left, 1), (right, -1))]
    return not marked[0].unionByName(marked[1]).groupBy("shape").agg(F.sum("n").alias("n")).where("n <> 0").isEmpty()


def same_system(left: DataFrame, right: DataFrame, left_signals: DataFrame | None = None, right_signals: DataFrame | None = None, most: int = 64, largest: int = 20_000) -> dict:
    """Whether two systems of norms are alike up to names.

    ``result`` is ``False`` with the reason; ``True`` with a mapping (``signals``: left_signal, right_signal) that makes each
    constraint of one system a constraint of the other, term by term up to the order of like factors; or ``None`` where the
    search gave up. Both are coloured in one table. Signals alone in their colour on each side are fixed; they and the
    constant cut the rest into pieces that share no open signal. Pieces of equal colours are matched by a search that
    individualises and refines, ``most`` refinements a pair of pieces; a piece of over ``largest`` constraints is given up.
    """
    mark = lambda df, side: df.withColumn("coni", F.col("coni") * 2 + side).withColumn("signal", F.when(F.col("signal") == 0, F.lit(0).cast("long")).otherwise(F.col("signal") * 2 + side))
    side = lambda df, n: swept(cut(mark(df, n).select("coni", "part", "signal", "coef")))
    both = side(left, 0).unionByName(side(right, 1))
    # coefficients alone may tell them apart, in one pass; colours only split these classes
    bags = both.groupBy("coni").agg(_bag("part", "coef", F.col("signal") == 0).alias("bag"))
    kinds = bags.groupBy(F.xxhash64(F.lit(1), "bag"), F.xxhash64(F.lit(2), "bag")).agg(F.count_if(F.col("coni") % 2 == 0).alias("l"), F.count_if(F.col("coni") % 2 == 1).alias("r"))
    if not kinds.where("l <> r").isEmpty():
        return {"result": False, "reason": "classes of different sizes (coefficients)"}
    roles = None
    if left_signals is not None and right_signals is not None:
        roles = left_signals.withColumn("signal", F.col("signal") * 2).unionByName(right_signals.withColumn("signal", F.col("signal") * 2 + 1))
    con, sig = refined(both, roles)
    for df, name in ((con, "coni"), (sig.where("signal <> 0"), "signal")):
        n = df.groupBy("color").agg(F.count_if(F.col(name) % 2 == 0).alias("l"), F.count_if(F.col(name) % 2 == 1).alias("r"))
        if not n.where("l <> r").isEmpty():
            return {"result": False, "reason": f"classes of different sizes ({name})"}
    # a fixed signal goes by its colour on both sides; colours are least members, so none is 0
    single = sig.where("signal <> 0").groupBy("color").agg(F.count("*").alias("n")).where("n = 2").select("color", F.lit(True).alias("fixed"))
    known = cut(sig.join(single, "color", "left").select("signal", "color", (F.col("fixed").isNotNull() | (F.col("signal") == 0)).alias("fixed")))
    named = cut(both.join(known, "signal"))
    pieces = constraint_components(named.where("not fixed").select("coni", "signal").distinct())
    same_name = named.withColumn("signal", F.when(F.col("fixed") & (F.col("signal") != 0), -F.col("color")).otherwise(F.col("signal")))
    closed = _forms(same_name.join(pieces, "coni", "left_anti"))
    uneven = closed.groupBy("form").agg(F.count_if(F.col("coni") % 2 == 0).alias("l"), F.count_if(F.col("coni") % 2 == 1).alias("r")).where("l <> r")
    if not uneven.isEmpty():
        return {"result": False, "reason": "constraints of fixed signals differ"}
    fixed = known.where("fixed and signal <> 0").groupBy("color").agg(F.min(F.when(F.col("signal") % 2 == 0, F.shiftright("signal", 1))).alias("left_signal"), F.min(F.when(F.col("signal") % 2 == 1, F.shiftright("signal", 1))).alias("right_signal")).select("left_signal", "right_signal")
    if pieces.isEmpty():
        return {"result": True, "reason": "all signals are fixed", "signals": fixed}
    shape = con.join(pieces, "coni").groupBy("component").agg(_bag("color").alias("shape"), F.count("*").alias("n"))
    if not shape.where(F.col("n") > largest).isEmpty():
        return {"result": None, "reason": f"a piece of over {largest} constraints has open signals"}
    rows = same_name.join(pieces, "coni").join(shape.select("component", "shape"), "component").select("shape", "component", "coni", "part", "signal", "coef", "color")

    def match(df: pd.DataFrame) -> pd.DataFrame:
        parts = [x for _, x in sorted(((int(c), x) for c, x in df.groupby("component")), key=lambda y: y[0])]
        mine = [x for x in parts if int(x.coni.iloc[0]) % 2 == 0]
        theirs = [x for x in parts if int(x.coni.iloc[0]) % 2 == 1]
        out: list[tuple] = []
        for x in mine:
            unsure = False
            for i, y in enumerate(theirs):
                found, names = match_small(x, y, most)
                unsure |= found is None
                if found:
                    out += [(1, a >> 1, b >> 1) for a, b in names.items() if a > 0]
                    del theirs[i]
                    break
            else:
                out.append((-1 if unsure else 0, None, None))
        return pd.DataFrame(out or [(0, None, None)], columns=["ok", "left_signal", "right_signal"])

    found = cut(rows.groupBy("shape").applyInPandas(match, "ok int, left_signal long, right_signal long"))
    worst = {r[0] for r in found.select("ok").distinct().collect()}
    if 0 in worst:
        return {"result": False, "reason": "a piece has no match"}
    if -1 in worst:
        return {"result": None, "reason": "the search gave up on a piece"}
    return {"result": True, "reason": "all pieces match", "signals": fixed.union(found.select("left_signal", "right_signal"))}


def same_small(left: pd.DataFrame, right: pd.DataFrame, most: int = 64) -> bool | None:
    """Whether two small systems (coni, part, signal, coef), already normalised, are alike up to names."""
    return match_small(left, right, most)[0]


def match_small(left: pd.DataFrame, right: pd.DataFrame, most: int = 64) -> tuple[bool | None, dict[int, int]]:
    """(whether two small systems are alike, the right signal of each left one): a search over colour classes, each mapping
    it ends with checked term by term. A column ``color`` gives first colours; None once ``most`` refinements are spent."""
    budget = [most]

    def table(df: pd.DataFrame) -> dict:
        out: dict = {}
        for coni, part, signal, coef in df[["coni", "part", "signal", "coef"]].itertuples(index=False):
            out.setdefault(int(coni), {}).setdefault(int(signal), {})[part] = int(coef)
        return out

    systems = [table(left), table(right)]
    if len(systems[0]) != len(systems[1]):
        return False, {}
    coefs = lambda con, part: sorted(c[part] for c in con.values() if part in c)

    def slot_of(con: dict) -> dict:
        if coefs(con, "A") != coefs(con, "B"):
            return {s: tuple(sorted(c.items())) for s, c in con.items()}
        return {s: (tuple(sorted(v for k, v in c.items() if k != "C")), c.get("C", -1)) for s, c in con.items()}

    def form(con: dict, name: dict) -> tuple:
        a, b, c = (tuple(sorted((name[s], x[part]) for s, x in con.items() if part in x)) for part in "ABC")
        return (a, b, c) if coefs(con, "A") != coefs(con, "B") else (min(a, b), max(a, b), c)

    slot = [{k: slot_of(c) for k, c in sys.items()} for sys in systems]

    def refine(color: list[dict]) -> list[dict] | None:
        n = -1
        while True:
            budget[0] -= 1
            names: dict = {}
            cons = [{k: names.setdefault(tuple(sorted((color[i][s], v) for s, v in c.items())), len(names)) for k, c in slot[i].items()} for i in (0, 1)]
            new = []
            for i in (0, 1):
                around: dict = {s: [] for s in color[i]}
                for k, c in slot[i].items():
                    for s, v in c.items():
                        around[s].append((cons[i][k], v))
                new.append({s: (color[i][s], tuple(sorted(x))) for s, x in around.items()})
            order = {x: j for j, x in enumerate(sorted(set(new[0].values()) | set(new[1].values()), key=repr))}
            color = [{s: order[x] for s, x in side.items()} for side in new]
            if sorted(color[0].values()) != sorted(color[1].values()) or sorted(cons[0].values()) != sorted(cons[1].values()):
                return None
            if len(order) == n:
                return color
            n = len(order)

    def search(color: list[dict]) -> tuple[bool | None, dict]:
        color = refine(color)
        if color is None:
            return False, {}
        sizes: dict = {}
        for s, c in color[0].items():
            sizes.setdefault(c, []).append(s)
        open_ = [(len(v), c) for c, v in sizes.items() if len(v) > 1]
        if not open_:
            there = {c: s for s, c in color[1].items()}
            names = {s: there[c] for s, c in color[0].items()}
            own = {s: s for s in color[1]}
            alike = sorted(form(c, names) for c in systems[0].values()) == sorted(form(c, own) for c in systems[1].values())
            return alike, names if alike else {}
        if budget[0] <= 0:
            return None, {}
        _, c = min(open_)
        chosen, unsure = min(sizes[c]), False
        for other in sorted(s for s, x in color[1].items() if x == c):
            got, names = search([{**color[0], chosen: -1}, {**color[1], other: -1}])
            if got:
                return True, names
            unsure |= got is None
        return (None if unsure else False), {}

    first = [{s: (-2 if s == 0 else 0) for c in sys.values() for s in c} for sys in systems]
    for colors, df in zip(first, (left, right), strict=True):
        if "color" in df:
            colors.update({int(s): int(c) for s, c in zip(df.signal, df.color, strict=True) if s != 0})
    if any((0 in f) for f in first):
        for f in first:
            f.setdefault(0, -2)
    return search(first)


def equivalent_parts(parts: DataFrame, terms: DataFrame, most: int = 64) -> DataFrame:
    """(part_id, class_id, sure): parts compared with the representatives of their shape class, one group a shape.

    A part joins the first representative it is alike; ``sure`` is false where the search gave up on one, and the part
    then stands alone.
    """
    shapes = equal_shapes(parts, terms)
    rows = terms.join(parts, "coni").join(shapes, "part_id")

    def classes(df: pd.DataFrame) -> pd.DataFrame:
        by = {k: v for k, v in df.groupby("part_id")}
        reps: list[int] = []
        out = []
        for part in sorted(by):
            home, sure = part, True
            for r in reps:
                same = same_small(by[r], by[part], most)
                sure &= same is not None
                if same:
                    home = r
                    break
            if home == part:
                reps.append(part)
            out.append((part, home, sure or home != part))
        return pd.DataFrame(out, columns=["part_id", "class_id", "sure"])

    return rows.groupBy("class_id").applyInPandas(classes, "part_id long, class_id long, sure boolean")


def shuffled(terms: DataFrame, seed: int, p: int = 257) -> DataFrame:
    """The same system under other names: constraints and signals permuted, the sides scaled, factors swapped."""
    ids = lambda df, name: ranked(df.select(name).distinct().withColumn("__h", F.xxhash64(F.lit(seed), name)), ["__h", name], "new").drop("__h")
    cons = ids(terms, "coni").select("coni", F.col("new").alias("nc"))
    sigs = ids(terms.where("signal <> 0"), "signal").select("signal", F.col("new").alias("ns"))
    rows = terms.join(cons, "coni").join(sigs, "signal", "left")
    factor = F.pmod(F.xxhash64(F.lit(seed + 1), "coni"), F.lit(p - 1)) + 1
    turn = F.pmod(F.xxhash64(F.lit(seed + 2), "coni"), F.lit(2)) == 0
    part = F.when(turn & (F.col("part") == "A"), "B").when(turn & (F.col("part") == "B"), "A").otherwise(F.col("part"))
    scaled = F.when((F.col("part") == "C") | (F.col("part") == "A"), F.pmod(F.col("coef") * factor, F.lit(p))).otherwise(F.col("coef"))
    return rows.select(F.col("nc").alias("coni"), part.alias("part"), F.coalesce("ns", F.lit(0)).alias("signal"), scaled.alias("coef"))
