"""Joins with hot keys against plain joins."""

from pyspark.sql import functions as F

from basalt.operators.skew import hot_keys, skew_join


def test_skew_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y")).union(spark.createDataFrame([(7, 70)], "k long, y long"))
    for how in ("inner", "left"):
        want = sorted(map(str, left.join(right, ["k"], how).collect()))
        for share in (2, 10, 1000):
            assert sorted(map(str, skew_join(left, right, ["k"], how, share).collect())) == want
    assert [r["k"] for r in hot_keys(left.groupBy("k").count(), ["k"], 3000, 10).collect()] == [7]
    assert hot_keys(left.limit(0).groupBy("k").count(), ["k"], 0) is None
    assert skew_join(left.limit(0), right, ["k"]).count() == 0
