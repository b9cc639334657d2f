import math

from pyspark.sql import functions as F

from spanloom.llm import mixing


def test_counts_follow_the_distribution(spark):
    for rate in (0.3, 2.0, 40.0):
        got = spark.range(8000).select(mixing.poisson_count(F.lit(rate), "s", F.col("id")).alias("k")).agg(F.avg("k"), F.var_pop("k")).first()
        assert abs(got[0] - rate) < 5 * math.sqrt(rate / 8000) and abs(got[1] / rate - 1) < 0.15


def test_inverse_is_exact(spark):
    rows = spark.range(200).select("id", mixing.poisson_count(F.lit(3.0), "s", F.col("id")).alias("k"), mixing.unit_hash(F.lit("s"), F.col("id"), F.lit(1)).alias("u")).collect()
    for r in rows:
        k, p = 0, math.exp(-3)
        c = p
        while r["u"] >= c:
            k, p = k + 1, p * 3 / (k + 1)
            c += p
        assert r["k"] == k


def test_mix_reaches_target_shares_and_is_repeatable(spark):
    docs = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10).alias("text"), F.when(F.col("id") % 10 < 8, "big").otherwise("small").alias("source"), F.lit("c").alias("copy")
    )
    weights = spark.createDataFrame([("big", 0.5), ("small", 0.5), ("none", 1.0)], "source string, weight double")
    mixed = mixing.mix(docs, weights.filter("source <> 'none'"))
    n = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert abs(n["big"] - 3000) < 300 and abs(n["small"] - 3000) < 300
    assert "_copy" in mixed.columns and "copy" in mixed.columns
    again = mixing.mix(docs.repartition(3), weights.filter("source <> 'none'"))
    assert mixed.select("mix_key").exceptAll(again.select("mix_key")).count() == 0


def test_nulls_and_empty(spark):
    schema = "doc_id long, text string, source string"
    docs = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, "abc", None), (None, "abc", "b"), (3, "abc", None)], schema)
    mixing.mix(docs, budget_chars=100.0).collect()
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, spark.createDataFrame([("b", None), (None, -1.0)], "source string, weight double")).count() == 0
