import random

import pytest
from pyspark.sql import functions as F

from memq.operators import history

SCHEMA = "line_no bigint, subj string, pred string, obj string, card string, sid string, turn int, ts bigint, n string, chunk string"


def claims(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], SCHEMA)


def got(df):
    return sorted(map(tuple, df.select("ekey", "pred", "value", "valid_from", "valid_to").collect()))


def test_versions_and_return_to_an_old_value(spark):
    rows = [(" User", "lives_in", o, "one", "s", 0, t) for o, t in (("Berlin", 100), ("BERLIN!", 200), ("Munich", 300), ("berlin", 90_000_000))]
    assert got(history.claim_history(claims(spark, rows))) == [
        ("user", "lives_in", "berlin", 100, 300), ("user", "lives_in", "berlin", 90_000_000, -1), ("user", "lives_in", "munich", 300, 90_000_000),
    ]


def test_ties_go_to_the_last_sid_then_turn(spark):
    rows = [("a", "p", "x", "one", "s1", 5, 100), ("a", "p", "y", "one", "s2", 0, 100), ("a", "p", "z", "one", "s2", 1, 100), ("a", "p", "z", "one", "s2", 1, 100)]
    assert got(history.claim_history(claims(spark, rows))) == [("a", "p", "z", 100, -1)]


def test_nulls_and_disputed_predicates(spark):
    rows = [
        ("a", "p", None, "one", "s", 0, 100), ("a", "p", "...", "one", "s", 0, 150), ("a", "p", "x", "one", None, None, 200), ("a", "p", "y", "one", "s", 0, None),
        (None, "p", "x", "one", "s", 0, 300), ("a", None, "x", "one", "s", 0, 300), ("a", "q", "x", "one", "s", 0, 100), ("a", "q", "y", None, "s", 0, None), ("a", "r", "x", "many", "s", 0, 100),
    ]
    assert got(history.claim_history(claims(spark, rows))) == [("a", "p", "x", 200, -1)]
    assert got(history.claim_history(claims(spark, []))) == []


def test_order_of_fields_does_not_matter(spark):
    rows = [("a", "p", "city: X; floor: 2", "one", "s", 0, 1), ("a", "p", "FLOOR: 2 | | city: x", "one", "s", 0, 2), ("a", "p", "city: x floor: 2", "one", "s", 0, 3)]
    assert [r[2:] for r in got(history.claim_history(claims(spark, rows)))] == [("city x floor 2", 3, -1), ("city x;floor 2", 1, 3)]


@pytest.mark.parametrize("chunk", [1, 7, 50, 10_000])
def test_chunks_never_change_the_result(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice("ab"), "p", rng.choice(["x", "y", "z"]), "one", rng.choice("st"), rng.randrange(3), rng.randrange(200)) for _ in range(300)]
    expected = []
    for e in "ab":
        last = {}
        for r in rows:
            if r[0] == e:
                last[r[6]] = max(last.get(r[6], ("", 0, "")), (r[4], r[5], r[2]))
        runs = []
        for t in sorted(last):
            if not runs or runs[-1][1] != last[t][2]:
                runs.append((t, last[t][2]))
        expected += [(e, "p", v, t, runs[i + 1][0] if i + 1 < len(runs) else -1) for i, (t, v) in enumerate(runs)]
    usable = history.usable_claims(claims(spark, rows))
    assert got(history.versions(usable, ["ekey", "pred"], "value", "ts", ["sid", "turn"], chunk)) == sorted(expected)


def test_a_hot_entity_spreads_over_chunks(spark):
    hot = spark.range(20_000).select(F.lit("u").alias("k"), (F.col("id") * 60).alias("ts"), (F.col("id") % 2).cast("string").alias("v"))
    out = history.versions(hot, ["k"], "v", "ts", [])
    assert out.count() == 20_000
    assert out.where("valid_to = -1").count() == 1
