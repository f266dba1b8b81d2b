from pyspark.sql import functions as F

from memq.operators import skew
from memq.operators.skew import salted_join, small_side


def test_salted_join_keeps_every_row(spark):
    rows = spark.range(10_000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    unique = rows.groupBy("k").agg(F.count("*").alias("n")).withColumn("w", F.col("k") * 10)
    out = salted_join(rows, unique, ["k"], "n", per_task=100)
    assert out.count() == 10_000
    assert out.where("w != k * 10").count() == 0
    assert set(out.columns) == {"k", "v", "w"}


def test_names_with_underscores(spark):
    rows = spark.createDataFrame([(1, 2)], "k int, __k int")
    unique = spark.createDataFrame([(1, 5, 9)], "k int, n int, __w int")
    assert salted_join(rows, unique, ["k"], "n").collect() == [(1, 2, 9)]
    unique = spark.createDataFrame([(1, 5, 9)], "k int, n int, __k2 int").withColumnRenamed("__k2", "__v")
    assert salted_join(rows.withColumnRenamed("__k", "__v2"), unique, ["k"], "n").collect() == [(1, 2, 9)]


def test_left_join_and_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (1, 2), (2, 3)], "k int, v int")
    unique = spark.createDataFrame([(1, 5, "a")], "k int, n int, w string")
    assert salted_join(rows, unique, ["k"], "n").count() == 1
    assert sorted((r.v, r.w) for r in salted_join(rows, unique, ["k"], "n", "left").collect()) == [(1, None), (2, "a"), (3, None)]


def test_small_side_is_checked(spark):
    assert small_side(spark.range(5), 5) is not None
    assert small_side(spark.range(6), 5) is None
    text = spark.createDataFrame([("a" * 50, [1, 2]), (None, None)], "s string, a array<bigint>")
    assert small_side(text, 5, 66) is not None
    assert small_side(text, 5, 65) is None


def test_more_hot_keys_than_are_listed(spark, monkeypatch):
    """With thousands of hot keys none stays whole: no task key holds more rows than a task takes, up to the spread of hashes."""
    monkeypatch.setattr(skew, "LISTED", 100)
    rows = spark.range(5_000 * 40).select((F.col("id") % 5_000).alias("k"), F.col("id").alias("v"))
    rows = rows.unionByName(spark.range(9_000).select(F.lit(7).cast("bigint").alias("k"), (F.col("id") + 1_000_000).alias("v")))
    unique = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert unique.where("n > 10").count() == 5_000
    out = skew.salted_join(rows, unique.withColumn("w", F.col("k") * 2), ["k"], "n", per_task=10)
    assert out.count() == rows.count()
    assert out.where("w != k * 2").count() == 0
    listed, slots = skew._salts(skew.once(unique), ["k"], "n", 10)
    assert listed.count() == 100
    assert listed.agg(F.max("__salts")).first()[0] == 904
    assert slots.agg(F.min("__slot_salts")).first()[0] == 4


def test_the_filter_of_keys_loses_none(spark, monkeypatch):
    rows = spark.range(10_000).select(F.col("id").cast("int").alias("k"), F.lit("x").alias("__bits"))
    wanted = skew.once(spark.range(0, 10_000, 100).select(F.col("id").alias("k")))
    kept = {r.k for r in skew.may_hold(rows, wanted, ["k"]).collect()}
    assert set(range(0, 10_000, 100)) <= kept
    assert len(kept) < 2_000
    assert skew.may_hold(rows, wanted, ["k"]).columns == ["k", "__bits"]
    monkeypatch.setattr(skew, "WORDS", 1)  # far too small: more rows pass, none is lost
    assert set(range(0, 10_000, 100)) <= {r.k for r in skew.may_hold(rows, wanted, ["k"]).collect()}
    assert skew.may_hold(rows, skew.once(wanted.limit(0)), ["k"]).count() == 0
