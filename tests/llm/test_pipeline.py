"""Stages keep clean documents, stand nulls, repeats and odd columns, and agree with the operators."""

import random

import pytest

import corpus_pipeline
from fieldloom.llm import queries, simhash
from tests.llm.test_toxicity import BAD, CLEAN


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(5)
    text = lambda n: " ".join(r.choice(CLEAN) + r.choice("abcdefgh") for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        t = text(r.choice([30, 80, 200]))
        if i % 4 == 0:
            t = t + " " + " ".join(r.choice(BAD) for _ in range(4)) + " " + text(10)
        rows.append((i, t, "en", f"s{i % 5}", len(t), "x"))
        labels.append((i, 1, int(i % 4 == 0)))
    rows += [(500 + k, rows[k][1], "en", "s9", 1, None) for k in range(1, 8)]  # copies
    rows += [(600, None, None, None, None, None), (601, "", "en", "s1", 0, "y"), (602, "too short", "en", "s1", 9, "y"), (None, text(50), "en", "s1", 3, "y"), (3, rows[3][1], "en", "s3", 3, "x"), (603, text(9000), "en", "s1", 3, "y")]
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, __n string").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), rows


def test_stages(spark, folder):
    d, rows = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:3]:
        before = docs
        docs = stage(spark, before, d)
        assert docs.columns == before.columns, name
        docs = docs.persist()
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    clean = {i for i in range(400) if i % 4}
    assert clean <= set(kept["quality"]) and not {600, 601, 602} & set(kept["quality"])
    assert len(clean & set(kept["toxicity"])) > 0.93 * len(clean)  # some 80 toxic texts to learn from
    assert len([i for i in kept["toxicity"] if i is not None and i < 400 and i % 4 == 0]) < 5
    last = kept["near_duplicates"]
    assert len(last) == len(set(last)) and None in last and not set(range(500, 508)) & {i for i in last if i} - {504}
    want = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert {i for i in last if i is not None} == want - {None}
    packed = corpus_pipeline.STAGES[3][1](spark, docs, d).collect()
    assert {r.doc_id for r in packed} == set(last)


def test_run_equals_the_stages_and_stands_an_empty_table(spark, folder, tmp_path):
    d, _ = folder
    out = corpus_pipeline.run(spark, d)
    assert out.count() > 250
    for t in ("documents", "labels"):
        spark.read.parquet(f"{d}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_queries_are_ten(spark):
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11)) and set(queries.ORACLES) <= set(queries.QUERIES)
