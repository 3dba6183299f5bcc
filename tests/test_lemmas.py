from fieldloom.operators import verify

COLS = "coni long, part string, signal long, coef long"


def test_constant_factors_determine(spark):
    t = spark.createDataFrame([(1, "A", 0, 3), (1, "B", 2, 1), (1, "C", 1, 1), (2, "A", 3, 2), (2, "B", 0, 5), (2, "C", 2, 1), (3, "A", 1, 1), (3, "B", 4, 1), (3, "C", 2, 1)], COLS)
    known = spark.createDataFrame([(1,)], "signal long")
    assert {r.signal for r in verify.determined(t, known).collect()} == {1, 2, 3}
