import datetime
import random

import pytest
from pyspark.sql import functions as F

from memq.operators import delivery

DAY = datetime.datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, q, t, "x", 7) for i, q, t in rows], "line_no bigint, q string, at timestamp, id string, n int")


def got(df):
    return sorted(map(tuple, df.collect()))


def test_copies_across_and_inside_buckets(spark):
    at = lambda d: DAY + datetime.timedelta(days=d)
    rows = [(1, "a", at(0)), (2, "a", at(9)), (3, "a", at(9)), (4, "b", at(5)), (5, None, at(1)), (6, None, at(1)), (7, "c", None), (8, "c", at(3)), (9, "", at(2)), (10, "", at(2))]
    df = frame(spark, rows)
    assert got(delivery.copies(df, "q", "line_no", "at").select("q", "line_no")) == [("", 9), ("a", 1), ("a", 2), ("c", 7)]
    kept = delivery.exactly_once(df, "q", "line_no", "at")
    assert sorted(r.line_no for r in kept.collect()) == [3, 4, 5, 6, 8, 10]
    assert kept.columns == df.columns


def test_empty_and_single(spark):
    assert got(delivery.copies(frame(spark, []), "q", "line_no", "at")) == []
    assert got(delivery.copies(frame(spark, [(1, "a", DAY)]), "q", "line_no", "at")) == []
    assert got(delivery.copies(frame(spark, [(1, "a", None), (2, "a", None)]), "q", "line_no", "at")) == [("a", 1)]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, *(f"q{x}" for x in range(400))]), DAY + datetime.timedelta(hours=rng.randrange(500))) for i in range(1000)]
    last = {}
    for i, q, _ in rows:
        last[q] = i
    expected = sorted((q, i) for i, q, _ in rows if q is not None and i < last[q])
    assert got(delivery.copies(frame(spark, rows), "q", "line_no", "at").select("q", "line_no")) == expected


def test_screening_has_no_false_negatives_and_few_false_positives(spark):
    df = spark.range(20_000).select("id", F.concat(F.lit("k"), F.col("id") % 19_000).alias("q"), F.timestamp_seconds(F.col("id") * 60).alias("at"))
    storage = delivery.bucketed_storage(df, "q", "id", "at")
    hits = delivery.screen(storage, delivery.bloom_filters(storage)).select("id").distinct()
    again = {f"k{i}" for i in range(1_000)}
    found = {r.id for r in hits.collect()}
    assert again <= found
    assert len(found - again) < 0.05 * 18_000


def test_a_hot_identifier(spark):
    df = spark.range(300_000).select(F.col("id").alias("line_no"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("q"), F.timestamp_seconds("id").alias("at"))
    out = delivery.copies(df, "q", "line_no", "at")
    assert out.agg(F.count("*"), F.max("line_no")).first() == (99_999, 299_994)
