"""Binary files under adaptive execution."""

import pytest
from pyspark.sql import functions as F

from fieldloom.sources import files

ADAPTIVE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "64k",
    "spark.sql.shuffle.partitions": "16",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def adaptive(spark):
    before = {k: spark.conf.get(k, None) for k in ADAPTIVE}
    for k, v in ADAPTIVE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_a_circuit_is_one_file_of_one_task(adaptive, tmp_path):
    adaptive.range(0, 40_000, 1, 8).selectExpr("concat('c', id % 8) as circuit_id", "id as coni", "id % 97 as signal", "id % 250 + 1 as coef").write.parquet(f"{tmp_path}/in")
    rows = adaptive.read.parquet(f"{tmp_path}/in").groupBy("circuit_id", "coni", F.lit("A").alias("part"), "signal").agg(F.sum("coef").alias("coef"))
    done = files.write_r1cs(rows, f"file://{tmp_path}/out", 257).collect()
    assert sorted(r.circuit_id for r in done) == [f"c{i}" for i in range(8)]
    got = files.read_r1cs(adaptive, f"file://{tmp_path}/out").selectExpr("regexp_extract(circuit_id, '([^/]+)[.]r1cs$', 1) as circuit_id", "coni", "part", "signal", "cast(coef as long) as coef")
    assert got.count() == 40_000 and got.exceptAll(rows).isEmpty()
