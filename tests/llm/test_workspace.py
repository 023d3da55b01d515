from pyspark.sql import functions as F

from larkspur.llm.workspace import join_by_hot


def test_frequent_keys_join_like_others(spark):
    """A third of the rows share a key; the result is that of the plain join, with and without frequent keys."""
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 700 + 1).alias("k"), F.col("id").alias("row"))
    side = rows.where("k % 5 != 4").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("low"))
    want = sorted(tuple(r) for r in rows.join(side, "k").select("k", "row", "low").collect())
    for share in (1, 10, 100_000):
        got = join_by_hot(rows, side, ["k"], share)
        assert got.columns == ["k", "row", "low"]
        assert sorted(tuple(r) for r in got.collect()) == want
    assert side.where(F.col("n") * 10 > 3_000).count() == 1


def test_no_rows(spark):
    none = spark.createDataFrame([], "k long, n long, low long")
    assert join_by_hot(spark.range(3).select(F.col("id").alias("k")), none, ["k"]).count() == 0
