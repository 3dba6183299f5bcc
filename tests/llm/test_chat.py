import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fieldloom.llm import chat as C


def escape(t):
    t = (t or "").replace("\\", "\\\\")
    for c in C.CONTROL:
        t = t.replace(c, c[0] + "\\" + c[1:])
    return t


@settings(max_examples=300)
@given(st.lists(st.sampled_from(["\\", "<", ">", "|", "</s>", "[INST]", "<|end|>", "<|turn|>", "<|text|>", "a", "\n", "[", "/", "end"]), max_size=12).map("".join))
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    import re

    out = escape(text)
    assert not any(c in out for c in C.CONTROL)
    assert re.sub(r"(?s)\\(.)", r"\1", out) == text


def test_round_trip_in_spark(spark):
    r = random.Random(0)
    parts = ["\\", "<", "|", "</s>", "[INST]", "<|end|>", "<|turn|>", "<|text|>", "é", "\n", "😀", " "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 15))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, u in df.select("t", C.escape(F.col("t")), C.unescape(C.escape(F.col("t")))).collect():
        assert e == escape(t) and u == t


def test_paths_of_trees(spark):
    r = random.Random(1)
    rows, parents = [], {}
    for tree in ("a", "b", "c"):
        for node in range(1, 60):
            up = None if node == 1 else (node - 1 if tree == "a" else r.randrange(1, node))
            parents[tree, node] = up
            rows.append((tree, node, up, float(r.randint(0, 3)), "assistant" if node % 2 else "user", f"t{node}"))
    rows += [("loop", 1, 2, 1.0, "user", "x"), ("loop", 2, 1, 1.0, "user", "x"), ("loop", 3, 1, 1.0, "user", "x"), ("alone", 7, 99, None, None, None)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, score double, role string, text string")
    want = set()
    inner = {(t, p) for (t, _), p in parents.items()}
    for t, n in parents:
        if (t, n) not in inner:
            at, up = n, 0
            while at is not None:
                want.add((t, n, at, up))
                at, up = parents[t, at], up + 1
    want.add(("alone", 7, 7, 0))
    got = C.paths(df, "tree", "node", "parent").collect()
    assert {(x["__tree"], x["__leaf"], x["__node"], x["__up"]) for x in got} == want and len(got) == len(want)
    score = {(t, n): s or 0.0 for t, n, _, s, _, _ in rows}
    best = C.chats(df, "tree", "node", "parent", "role", "text", "score", best=2).collect()
    for tree in ("a", "b", "c", "alone"):
        leaves = {l for t, l, _, _ in want if t == tree}
        mean = {l: sum(x := [score[tree, n] for t, m, n, _ in want if (t, m) == (tree, l)]) / len(x) for l in leaves}
        order = sorted(leaves, key=lambda l: (-mean[l], l))[:2]
        assert [x.leaf for x in sorted((x for x in best if x.tree == tree), key=lambda x: x["rank"])] == order


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|end|>\\"), (1, 2, "assistant", None), (2, 5, None, None), (None, 1, "user", "q"), (3, 1, "b", "x"), (3, 1, "a", "y"), (3, 1, "a", "y"), (4, None, "user", "z"), (4, 0, "assistant", "é</s>")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, parent string")
    out = C.chats(C.replies(df), "tree", "node", "parent", "role", "text")
    got = {r.id: (r.turns, r.formatted, r.spans) for r in out.select("tree.id", C.read_back(F.col("formatted")).alias("turns"), "formatted", "spans").collect()}
    turns = {k: [tuple(t) for t in v[0]] for k, v in got.items()}
    assert turns == {1: [("user", "hi"), ("assistant", "<|end|>\\"), ("assistant", "")], 2: [("", "")], None: [("user", "q")], 3: [("a", "y"), ("a", "y"), ("b", "x")], 4: [("user", "z"), ("assistant", "é</s>")]}
    loss = {k: [f[s.begin : s.begin + s.length] for s in spans] for k, (_, f, spans) in got.items()}
    assert loss[1] == [escape("<|end|>\\"), ""] and loss[4] == [escape("é</s>")] and loss[2] == []
    ranked = C.chats(C.replies(df.withColumn("score", F.length("text").cast("double")), score="score"), "tree", "node", "parent", "role", "text", score="score", best=1)
    assert sorted((str(r.id), r.formatted, r["rank"]) for r in ranked.select("tree.id", "formatted", "rank").collect()) == sorted((str(k), v[1], 1) for k, v in got.items())
    assert C.chats(C.replies(df.limit(0)), "tree", "node", "parent", "role", "text").collect() == []
