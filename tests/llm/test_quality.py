import random
import re
from collections import Counter, defaultdict

from fieldloom.llm import quality as Q

WS = " \t\n\x0b\f\r"


def plain(text):
    text = text or ""
    words = [w for w in re.split("[ \t\n\x0b\f\r]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(WS)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def docs_of():
    r = random.Random(0)
    text = lambda n: " ".join(r.choice("abcdefgh") + r.choice("xyz#|é") for _ in range(n))
    rows = []
    for i in range(60):
        parts = [text(r.randint(5, 30)) for _ in range(4)]
        if i % 2:
            parts.insert(r.randint(0, 4), "Please  ACCEPT our cookies")
        if i % 10 == 1:
            parts = ["please accept our\tcookies"] * 1 + [parts[0][:9], "Please accept our cookies "]
        rows.append((i, "\n".join(parts), "h1" if i % 3 else None, "x"))
    long = text(4000)
    return rows + [(60, None, "h1", "x"), (61, "", "h1", "x"), (62, long, "h1", "x"), (62, long, "h1", "x"), (None, text(40), None, None), (63, "a b c d e " * 3 + text(30), "h2", "x"), (64, "\n\n a \n", "h2", "x")]


def test_tables(spark):
    rows = docs_of()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, kept string").repartition(3)
    out = Q.quality(docs, least_texts=5, share=0.05, min_left=0.5).collect()
    assert len(out) == len(rows)
    norm = lambda x: re.sub("[ \t\n\x0b\f\r]+", " ", x.strip(" ")).lower()
    holders = defaultdict(set)
    lines = {}
    for _, t, h, _ in rows:
        lines[t or ""] = {norm(x) for x in (t or "").split("\n") if x.strip(WS)}
        for x in lines[t or ""]:
            holders[h, x].add(t or "")
    import hashlib

    tid = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want, texts = [], []
    for i, t, h, _ in rows:
        t = t or ""
        base = plain(t)
        failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
        total = sum(len(x.split()) for x in lines[t])
        n_texts = len(set().union(*(v for (g, _), v in holders.items() if g == h)))
        gone = [x for x in lines[t] if len(holders[h, x]) > max(5, 0.05 * n_texts) and min(map(tid, holders[h, x])) != tid(t)]
        lost = sum(len(x.split()) for x in gone)
        depleted = lost > 0 and (total - lost < 0.5 * total or total - lost < 10)
        want.append((i, *base, failed, not failed and not depleted, len(gone), lost))
        if not failed and not depleted:
            texts.append((i is None, i or 0, "\n".join(x for x in t.split("\n") if norm(x) not in gone)))
    assert sorted(map(key, map(tuple, out))) == sorted(map(key, want))
    assert any(not w[7] and not w[6] for w in want) and any(w[7] and w[8] for w in want)
    left = Q.kept_documents(docs, least_texts=5, share=0.05, min_left=0.5)
    assert left.columns == docs.columns
    assert sorted(key((r.doc_id,)) for r in left.collect()) == sorted(key((w[0],)) for w in want if w[7])
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in left.collect()) == sorted(texts)
    assert Q.quality(docs.limit(0)).collect() == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(docs_of(), "doc_id long, text string, source string, kept string")
    assert "Python" not in Q.quality(docs)._jdf.queryExecution().toString() and "Arrow" not in Q.quality(docs)._jdf.queryExecution().toString()


def test_large_verdict_tables_are_dealt_out(spark, monkeypatch):
    docs = spark.createDataFrame(docs_of(), "doc_id long, text string, source string, kept string").repartition(3)
    rows = lambda df: sorted(map(str, df.collect()))
    options = {"least_texts": 5, "share": 0.05, "min_left": 0.5}
    few = rows(Q.quality(docs, **options)), rows(Q.kept_documents(docs, **options))
    monkeypatch.setattr(Q, "FEW", 0)
    assert (rows(Q.quality(docs, **options)), rows(Q.kept_documents(docs, **options))) == few


def test_the_line_rule_meets_the_tables(spark):
    read = lambda sf: Q.quality(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet"))
    assert read("sf0.01").where("n_lines_lost > 0").count() > 20
    assert read("sf0.1").where("not kept and not base_failed").count() > 0
