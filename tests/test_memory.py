import json

import pytest
from pyspark.errors import PySparkException

from memq.operators import memory

CLAIM = "line_no bigint, sid string, turn int, subj string, pred string, obj string, kind string, card string, ts bigint"


def test_statements_and_rejects(spark):
    turns = spark.createDataFrame(
        [("s", 0, "user", "hi", True), ("s", 0, "user", "hi", None), ("s", 1, "assistant", None, None), ("s", 2, "system", "x", None), (None, 0, "user", "x", None), ("t", 0, None, "x", None), ("u", 0, "user", "a" * 25_000, False)],
        "session_id string, idx int, role string, content string, has_answer boolean",
    )
    sessions = spark.createDataFrame([(1, "s", 50, 3), (2, "s", 60, 3), (3, None, 1, 1)], "line_no bigint, session_id string, ts bigint, turns int")
    out = {r.nkey: r for r in memory.statements(turns, sessions).collect()}
    assert set(out) == {"s|0", "s|1", "u|0"}
    assert (out["s|0"].ts, out["s|1"].chars, out["u|0"].nchunks, out["u|0"].ts) == (60, 0, 3, None)
    assert "has_answer" not in out["s|0"].asDict()
    assert sorted((r.role or "", r.n) for r in memory.role_rejects(turns).collect()) == [("", 1), ("system", 1)]


def test_last_rows(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z")], "line_no int, k string, v string")
    assert [r.v for r in memory.last_rows(df, ["k"], "line_no").collect()] == ["y"]


def test_drops_and_dedupe(spark):
    rows = [
        (1, "s", 9, "u", "p", "o", "fact", "one", 1), (2, "s", None, "u", "p", "o", "fact", "one", 1), (3, "s", 0, "u", " ", "o", "fact", "one", 1),
        (4, "s", 0, "u", "p", "o" * 5000, "fact", "one", 1), (5, "s", 0, "u", "p", "o", "vibe", "one", 1), (6, "s", 0, "u", "p", "o", "fact", None, 1),
        (7, "s", 0, " U ", "P", "O", "fact", "one", 1), (8, "gone", 0, "u", "p", "o", "fact", "one", 1), (9, "s", 1, None, "p", "o", "fact", "one", 1),
    ]
    turns = spark.createDataFrame([("s", 0), ("s", 1)], "session_id string, idx int")
    checked = memory.checked_claims(spark.createDataFrame(rows, CLAIM), turns)
    assert {r.reason: r.n for r in memory.claim_drops(checked).collect()} == {
        "turn_out_of_range": 2, "turn_not_an_integer": 1, "missing_or_empty_field": 2, "field_too_long": 1, "bad_kind": 1,
        "cardinality_missing_defaulted_to_many": 1, "duplicate_in_response": 1,
    }
    kept = memory.valid_claims(checked).collect()
    assert [(r.line_no, r.card) for r in kept] == [(6, "many")]


def test_claims_from_json(spark):
    ok = {"turn": 0, "subject": "u", "predicate": "p", "object": "o", "kind": "fact", "cardinality": "one"}
    items = [ok, ok | {"turn": True}, ok | {"turn": 1.0}, ok | {"turn": "1"}, ok | {"turn": None}, ok | {"turn": 9}, ok | {"subject": 3}, "text", ok | {"kind": "vibe"}]
    rows = spark.createDataFrame([("s", 2, json.dumps(items)), ("bad", 2, "{not json"), ("none", 2, None), ("object", 2, "{}")], "sid string, turns int, claims string")
    out = [r.reason for r in memory.claims_from_json(rows).orderBy("ord").collect()]
    assert out == [None, *["turn_not_an_integer"] * 4, "turn_out_of_range", "missing_or_empty_field", "not_an_object", "bad_kind"]


def test_sessions_in_order_of_time(spark):
    schema = "question_id string, haystack_session_ids array<string>, haystack_dates array<string>"
    dates = ["2023/04/10 (Mon) 17:50", "2023/04/10 (Mon) 14:47", "2023/04/10 (Mon) 17:15"]
    df = spark.createDataFrame([("q", ["a_2", "a_3", "a_1"], dates), ("q", ["a_2", "a_3", "a_1"], dates), ("n", None, None)], schema)
    slots = memory.instance_sessions(df)
    assert [r.sid for r in slots.orderBy("nth").collect()] == ["a_3", "a_1", "a_2"]
    assert memory.out_of_order(slots).first().asDict() == {"instances": 1, "stored_unsorted": 1, "loaded_unsorted": 0}
    for ids, ds in ((["a"], dates), (["a"], ["nonsense"])):
        with pytest.raises(PySparkException):
            memory.instance_sessions(spark.createDataFrame([("q", ids, ds)], schema)).collect()


def test_upper_median(spark):
    for values, expected in (([5, 1, 3], (1, 3, 5)), ([4, 1, 3, 2], (1, 3, 4)), ([2, 2, 9], (2, 2, 9))):
        df = spark.createDataFrame([(v,) for v in values], "v int")
        assert tuple(memory.upper_median(df, "v").first()) == expected


def test_prints_see_any_change(spark):
    schema = "session_id string, idx int, role string, content string"
    base = [("s", 0, "user", "a"), ("s", 1, "user", "b")]
    of = lambda rows: memory.session_prints(spark.createDataFrame(rows, schema)).first().print
    assert of(base) == of(base[::-1]) == of(base + base)
    assert len({of(base), of([("s", 0, "user", "b"), ("s", 1, "user", "a")]), of([("s", 0, "user", "a")]), of([("s", 0, "user", None), ("s", 1, "user", "b")])}) == 4
    assert memory.session_collisions(spark.createDataFrame([*base, ("s", 1, "user", "c")], schema)).collect()[0].texts == 2
