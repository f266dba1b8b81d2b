import random

import pytest

from memq.operators import asof

CLAIMS = "subj string, pred string, obj string, sid string, turn int, ts bigint, state string, period int"


def tables(spark, claims, instances, targets):
    return (
        spark.createDataFrame(instances, "question_id string, asked_at bigint"),
        spark.createDataFrame(targets, "question_id string, subj string, pred string"),
        spark.createDataFrame([(*c, "x", 1) for c in claims], CLAIMS),
    )


def got(df):
    return sorted(map(tuple, df.select("question_id", "sid", "turn").collect()))


def test_never_a_later_value(spark):
    claims = [("User", "p", "a", "s1", 0, 100), ("user ", "p", "b", "s2", 3, 200), ("user", "p", "c", "s3", 0, 86_400 * 40)]
    asked = [("q0", 99), ("q1", 100), ("q2", 199), ("q3", 200), ("q4", 86_400 * 30), ("q5", 86_400 * 50), ("q6", None), (None, 500), ("q5", 86_400 * 50)]
    targets = [(q, "USER", "p") for q in ("q0", "q1", "q2", "q3", "q4", "q5", "q6")]
    assert got(asof.question_facts(*tables(spark, claims, asked, targets))) == [("q1", "s1", 0), ("q2", "s1", 0), ("q3", "s2", 3), ("q4", "s2", 3), ("q5", "s3", 0)]


def test_ties_nulls_and_unusable_claims(spark):
    claims = [("a", "p", "x", "s1", 9, 100), ("a", "p", "y", "s2", 1, 100), ("a", "p", "y", "s2", 1, 100), ("a", "p", None, "s3", 1, 100), ("a", "p", "!", "s4", 1, 100), ("a", "p", "x", "s5", 1, None), (None, "p", "x", "s6", 1, 100)]
    assert got(asof.question_facts(*tables(spark, claims, [("q", 100)], [("q", "a", "p"), ("q", None, "p"), ("z", "a", "p")]))) == [("q", "s2", 1)]


def test_empty_tables(spark):
    assert got(asof.question_facts(*tables(spark, [], [], []))) == []
    assert got(asof.question_facts(*tables(spark, [], [("q", 1)], [("q", "a", "p")]))) == []


@pytest.mark.parametrize("period", [1, 5, 1000])
def test_period_does_not_change_the_result(spark, period):
    rng = random.Random(period)
    changes = [(rng.choice("ab"), rng.randrange(100), rng.randrange(5)) for _ in range(200)]
    probes = [(rng.choice("abc"), rng.randrange(-5, 110)) for _ in range(100)]
    c = spark.createDataFrame(changes, "k string, ts bigint, v int")
    p = spark.createDataFrame(probes, "k string, at bigint")
    out = {(r.k, r.at): (r.ts, r.v) for r in asof.as_known(p, c, ["k"], "at", "ts", ["v"], ["v"], period).collect()}
    expected = {}
    for k, at in probes:
        known = [(ts, v) for kk, ts, v in changes if kk == k and ts <= at]
        if known:
            expected[k, at] = max(known)
    assert out == expected


def test_places_count_through_chunks(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.randrange(300), i) for i in range(200)]
    out = asof.placed(spark.createDataFrame(rows, "k string, ts bigint, i int"), ["k"], ["ts", "i"], 10)
    expected = {}
    for k in "ab":
        expected.update({r: n for n, r in enumerate(sorted(r for r in rows if r[0] == k), 1)})
    assert {(r.k, r.ts, r.i): r.place for r in out.collect()} == expected
