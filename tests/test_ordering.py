"""Ranks, pages and neighbours against the plain window, with hot keys and ties."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from proofline.operators import jobs, ordering


def skewed(spark, rows=3000):
    """A third of the rows share one key, and values tie often."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 50).cast("string")))
    return spark.range(rows).select("id", key.alias("key"), (F.pmod(F.xxhash64("id"), F.lit(7))).alias("value"))


def test_global_rank_equals_the_window(spark):
    rows = skewed(spark)
    order = [F.col("value").desc(), F.col("key").asc(), F.col("id").asc()]
    ranked = {r["id"]: r["rank"] for r in ordering.global_rank(rows, order).collect()}
    plain = {r["id"]: r["n"] for r in rows.select("id", F.row_number().over(Window.orderBy(*order)).alias("n")).collect()}
    assert ranked == plain


def test_rank_in_group_equals_the_window(spark):
    rows = skewed(spark).withColumn("key", F.when(F.col("key") != "k1", F.col("key")))
    ranked = ordering.rank_in_group(rows, ["key"], [F.col("value"), F.col("id")], "nth", "members")
    window = Window.partitionBy("key")
    plain = rows.select("id", F.row_number().over(window.orderBy("value", "id")).alias("nth"), F.count("*").over(window).alias("members"))
    assert sorted(ranked.select("id", "nth", "members").collect()) == sorted(plain.collect())


def test_a_hot_key_is_spread_over_ranges(spark):
    setting = "spark.sql.adaptive.coalescePartitions.enabled"  # tiny ranges would be merged again
    spark.conf.set(setting, "false")
    try:
        ranked = ordering.global_rank(skewed(spark, 40_000), [F.col("key"), F.col("id")])
        sizes = [r["count"] for r in ranked.where("key = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set(setting, "true")
    assert len(sizes) > 1 and max(sizes) < 13_000


def test_shallow_and_deep_pages_agree(spark):
    rows = skewed(spark)
    order = [F.col("value").desc(), F.col("id").asc()]
    shallow = [r["id"] for r in ordering.page(rows, order, 100, 20).collect()]
    assert [r["id"] for r in ordering.page(rows, order, 100, 20, by_rank=True).collect()] == shallow


def test_previous_by_bucket_equals_lag(spark):
    rows = skewed(spark).withColumn("at", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(500)))
    found = ordering.previous_by_bucket(rows, ["key"], ["at", "id"], "value", F.floor(F.col("at") / 20))
    plain = rows.select("id", F.lag("value").over(Window.partitionBy("key").orderBy("at", "id")).alias("previous"))
    assert sorted(found.select("id", "previous").collect(), key=repr) == sorted(plain.collect(), key=repr)


def test_previous_in_order_equals_lag(spark):
    rows = skewed(spark).where("id % 5 <> 0")
    found = ordering.previous_in_order(rows, [F.col("id").asc()], ["id", "value"])
    plain = rows.select("id", F.lag("id").over(Window.orderBy("id")).alias("previous_id"))
    assert sorted(found.select("id", "previous_id").collect(), key=repr) == sorted(plain.collect(), key=repr)


def test_trailing_hits_equal_brute_force(spark):
    data = [(("hot" if i % 3 else "cold"), (i * i * 7) % 400) for i in range(400)]
    rows = spark.createDataFrame(data, "key string, second int").select("key", F.timestamp_seconds("second").alias("at"))
    expected = {}
    for key, second in data:
        expected[key, second] = sum(1 for k, s in data if k == key and second - 30 <= s <= second)
    found = jobs.trailing_hits(rows, "key", "at", 30).select("key", F.unix_timestamp("at").alias("s"), "hits_in_window").collect()
    assert {(r["key"], r["s"]): r["hits_in_window"] for r in found} == expected
