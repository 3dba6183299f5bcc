"""Chats from reply trees, in DataFrame functions alone.

Messages point to their parents. Self-joins that double their reach list the messages on the path from each
leaf to its root; branches are ranked by score; each chosen path becomes one conversation, formatted as text
with the spans that a loss counts.

A turn is written as ``<|turn|>role<|text|>text<|end|>``. In roles and texts a backslash is doubled, and each
control string gets a backslash after its first character, so no control string is left in them. Reading back,
a backslash stands for the character after it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of this template and of common others.
CONTROL = (TURN, TEXT, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")


def escape(text: Column) -> Column:
    """``text`` without any control string; null counts as empty."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROL, plain)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def paths(messages: DataFrame, tree: str, node: str, parent: str, score: str | None = None, best: int | None = None) -> DataFrame:
    """(__tree, __leaf, __node, __up, __rank): each message on each chosen path from a leaf; __up counts from the leaf.

    (tree, node) must be unique. A parent that is null or missing makes its message a root; messages that lead
    into a circle of parents are left out. ``best``: how many branches of a tree stay, by the mean of
    ``score`` (null: 0) along the branch, ties to the smaller leaf; None: all.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    nodes = messages.select(F.col(tree).alias("__tree"), F.col(node).alias("__node"), F.col(parent).alias("__parent"), value.alias("__score"))
    known = nodes.select("__tree", F.col("__node").alias("__parent"))
    jumps = cut(nodes.join(known, ["__tree", "__parent"]).select("__tree", "__node", F.col("__parent").alias("__to")))
    leaves = nodes.select("__tree", "__node").join(jumps.select("__tree", F.col("__to").alias("__node")), ["__tree", "__node"], "left_anti")
    found = cut(leaves.select("__tree", F.col("__node").alias("__leaf"), "__node", F.lit(0).cast("long").alias("__up")))
    reach, total = 1, jumps.count() + 1
    while reach <= total and not jumps.isEmpty():
        ahead = found.join(jumps, ["__tree", "__node"]).select("__tree", "__leaf", F.col("__to").alias("__node"), F.col("__up") + reach)
        found = cut(found.union(ahead))
        on = jumps.select("__tree", F.col("__to").alias("__mid"), F.col("__node").alias("__from"))
        to = jumps.select("__tree", F.col("__node").alias("__mid"), "__to")
        jumps = cut(on.join(to, ["__tree", "__mid"]).select("__tree", F.col("__from").alias("__node"), "__to"))
        reach *= 2
    found = found.join(jumps.select("__tree", F.col("__node").alias("__leaf")), ["__tree", "__leaf"], "left_anti")
    if best is None:
        return found.withColumn("__rank", F.lit(1))
    scored = found.join(nodes.select("__tree", "__node", "__score"), ["__tree", "__node"]).groupBy("__tree", "__leaf").agg(F.avg("__score").alias("__mean"))
    ranked = scored.withColumn("__rank", F.row_number().over(Window.partitionBy("__tree").orderBy(F.desc("__mean"), "__leaf"))).where(F.col("__rank") <= best)
    return found.join(ranked.drop("__mean"), ["__tree", "__leaf"])


def formatted(turns: DataFrame, by: list[str], order: str, role: str, text: str) -> DataFrame:
    """(by, formatted, spans): the turns of each group in order, and (begin, length) in code points of each
    assistant's escaped text."""
    said = turns.select(*by, F.col(order).alias("at"), escape(F.col(role)).alias("role"), escape(F.col(text)).alias("text"))
    size = F.length("role") + F.length("text") + len(TURN) + len(TEXT) + len(END)
    before = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(size).over(before), F.lit(0)) + len(TURN) + F.length("role") + len(TEXT)
    placed = said.select(*by, F.struct(
        "at",
        F.concat(F.lit(TURN), "role", F.lit(TEXT), "text", F.lit(END)).alias("piece"),
        (F.col("role") == "assistant").alias("counts"),
        F.struct(begin.cast("int").alias("begin"), F.length("text").alias("length")).alias("span"),
    ).alias("turn"))
    whole = placed.groupBy(*by).agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    spans = F.transform(F.filter("turns", lambda t: t["counts"]), lambda t: t["span"])
    return whole.select(*by, F.array_join(F.col("turns.piece"), "").alias("formatted"), spans.alias("spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    each = F.filter(F.split(formatted, r"<\|end\|>"), lambda x: F.startswith(x, F.lit(TURN)))
    return F.transform(each, lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), TEXT, 1)).alias("role"),
        unescape(F.substring(x, F.locate(TEXT, x) + len(TEXT), 1 << 30)).alias("text"),
    ))


def chats(messages: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str | None = None, best: int | None = None) -> DataFrame:
    """(tree, leaf, rank, formatted, spans): one conversation for each chosen path of each reply tree.

    rank: the branch's place among those of its tree, from 1, by ``score``; 1 for all where ``best`` is None. Null roles and
    texts are empty; a very long text is one turn like any other; an empty table gives no rows; other columns are ignored.
    Null, missing and circular parents, ties and null scores: as in ``paths``.
    """
    chosen = paths(messages, tree, node, parent, score, best)
    said = messages.select(F.col(tree).alias("__tree"), F.col(node).alias("__node"), F.col(role).alias("__role"), F.col(text).alias("__text"))
    turns = chosen.join(said, ["__tree", "__node"]).withColumn("__down", -F.col("__up"))
    out = formatted(turns, ["__tree", "__leaf", "__rank"], "__down", "__role", "__text")
    return out.select(F.col("__tree").alias(tree), F.col("__leaf").alias("leaf"), F.col("__rank").alias("rank"), "formatted", "spans")


def replies(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", score: str | None = None) -> DataFrame:
    """A table of turns as reply trees: each row answers the one before it; ``score`` is carried on, if named.

    Turns that tie, and repeated rows, follow in order of role and text; a null turn comes first; rows without a
    conversation are one. The column ``tree`` holds the conversation as ``tree.id``.
    """
    order = Window.partitionBy(conv).orderBy(F.col(turn).asc_nulls_first(), F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first())
    at = F.row_number().over(order)
    rows = conversations.select(F.struct(F.col(conv).alias("id")).alias("tree"), role, text, at.cast("long").alias("node"), *([F.col(score)] if score else []))
    return rows.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
