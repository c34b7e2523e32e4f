from pyspark.sql import functions as F

from papyrion.operators.heavy_keys import fold_by_key, heavy_keys
from tests.conftest import rows


def frame(spark, data):
    return spark.createDataFrame(data, "k int, v string, n int, keyvalue int, total string, `__value` int")


def test_share_is_inclusive_and_counts_repeats_and_nulls(spark):
    data = [(1, "a", i, 0, "x", 0) for i in range(5)] + [(2, "b", 1, 0, "x", 0)] * 2 + [(None, "c", 1, 0, "x", 0)] * 3
    found = rows(heavy_keys(frame(spark, data), "k", 0.2))
    assert found == [(1, 5, 10), (2, 2, 10)]
    assert rows(heavy_keys(frame(spark, data), "k", 0.21)) == [(1, 5, 10)]


def test_fold_with_distinct_counts_nulls_and_null_keys(spark):
    data = [(1, "a", 1, 0, "", 0), (1, "a", None, 0, "", 0), (1, None, 3, 0, "", 0), (None, "z", 4, 0, "", 0), (2, None, None, 0, "", 0)]
    out = fold_by_key(frame(spark, data), ["k"], {"c": F.count(F.lit(1)), "s": F.sum("n")}, {"d": "v"})
    assert rows(out) == [(None, 1, 4, 1), (1, 3, 4, 1), (2, 1, None, 0)]


def test_empty_table(spark):
    empty = frame(spark, [])
    assert rows(heavy_keys(empty, "k", 0.02)) == []
    assert rows(fold_by_key(empty, ["k"], {"c": F.count(F.lit(1))}, {"d": "v"})) == []


def test_rows_are_folded_before_the_shuffle(spark):
    plan = fold_by_key(frame(spark, [(1, "a", 1, 0, "", 0)]), ["k"], {"s": F.sum("n")})._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan
