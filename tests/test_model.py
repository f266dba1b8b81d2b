import json

import pytest

from memq.operators import model


@pytest.mark.parametrize(
    ("text", "value", "rest"),
    [
        ('{"a": 1}', {"a": 1}, ""), ('Here: ```json\n[1, 2]\n``` so {there}', [1, 2], "so {there}"), ('see {this} first: {"a": {"b": 2}} and more', {"a": {"b": 2}}, "and more"),
        ('{"a": 1}\n```', {"a": 1}, ""), ("[]", [], ""),
    ],
)
def test_first_json(text, value, rest):
    assert model.first_json(text) == (value, rest)


@pytest.mark.parametrize("text", [None, "", "no json", '{"a": [1, 2', "{broken}"])
def test_nothing_complete(text):
    with pytest.raises(ValueError):
        model.first_json(text)


def test_retries():
    calls, waits = [], []

    def flaky(p):
        calls.append(p)
        if len(calls) < 3:
            raise TimeoutError
        return p

    assert model.with_retries(flaky, sleep=waits.append)("x") == "x"
    assert len(waits) == 2 and waits[1] <= 2
    with pytest.raises(ConnectionError):
        model.with_retries(lambda p: (_ for _ in ()).throw(ConnectionError()), attempts=2, sleep=waits.append)("x")
    with pytest.raises(KeyError):
        model.with_retries(lambda p: {}[p], sleep=waits.append)("x")


def test_replies(spark):
    df = spark.createDataFrame([(1, 'ok {"a": 1} done'), (2, "none"), (3, None)], "k int, reply string")
    out = {r.k: r for r in model.parse_replies(df, "k", "reply").collect()}
    assert (json.loads(out[1].value), out[1].rest) == ({"a": 1}, "done")
    assert out[2].value is None and out[3].error


def test_extract(spark):
    claim = {"turn": 0, "subject": "u", "predicate": "p", "object": "o", "kind": "fact", "cardinality": "one"}
    replies = {"good": json.dumps([claim, claim | {"turn": 5}]), "empty": "[]", "prose": "sorry", "object": "{}"}
    sessions = spark.createDataFrame([(k, 1, k) for k in (*replies, "down")], "sid string, turns int, prompt string")
    claims, status = model.extract(sessions, lambda p: replies[p])
    assert {r.sid: r.status for r in status.collect()} == {"good": "measured", "empty": "measured", "prose": "unmeasured", "object": "unmeasured", "down": "unmeasured"}
    assert [r.reason for r in claims.orderBy("ord").collect()] == [None, "turn_out_of_range"]
