import random
import re

import pytest
from pyspark.sql import functions as F

from memq.functions import text
from memq.llm import canonical

WORD = re.compile(r"[^\W_]+")
CLAIM = "line_no bigint, sid string, turn int, pred string, kind string, card string, ts bigint, subj string, obj string, id string, n int, tuple string"
SESSION = "line_no bigint, session_id string, ts bigint, turns int, session_date string"


@pytest.fixture(params=[200_000, 0], ids=["broadcast", "shuffle"])
def either(request, monkeypatch):
    """Both ways to join a dictionary."""
    monkeypatch.setattr(canonical, "BROADCAST_ROWS", request.param)


def got(df):
    return sorted(map(tuple, df.select("keep_key", "copy_key", "n_copies").collect()))


def claims(spark, rows):
    return spark.createDataFrame([(i, *r, "id", 1, "t") for i, r in enumerate(rows)], CLAIM)


def test_claims(spark, either):
    base = ("s", 1, "p", "fact", "one", 5)
    rows = [
        (*base, "User", "street: A; city: B"), (*base, " user ", "City: b | STREET: a|"), (*base, "user", "street: a city: b"), (*base, "user", None), (*base, "user", "?!"),
        ("s", 1, "p", None, None, None, "x", "v"), ("s", 1, "p", None, None, None, "X", "V."), ("s", 1, "p", None, None, 0, "x", "v"), ("s", 1, "p", "None", None, None, "x", "v"),
        (None, None, None, None, None, None, None, "v"), (None, None, None, None, None, None, None, "V"), (None, None, None, None, None, None, "", "v"),
        (*base, "u", "a; a"), (*base, "u", "a"), (*base, "u", "a;A"), ("s1", 1, "p", "fact", "one", 5, "User", "street: A; city: B"),
    ]
    assert got(canonical.claim_copies(claims(spark, rows))) == [(0, 1, 2), (5, 6, 2), (9, 10, 2), (12, 14, 2)]


def test_sessions(spark, either):
    rows = [(0, "chat-A_1", 5, 2, "x"), (1, "CHAT a 1", 5, 2, None), (2, "chat.a.1", 5, 3, "x"), (3, None, 5, 2, "x"), (4, None, 5, 2, "x"), (5, "?", 5, 2, "x"), (6, "chat a 1", 5, 2, "x"), (7, "chata1", 5, 2, "x")]
    assert got(canonical.session_copies(spark.createDataFrame(rows, SESSION))) == [(0, 1, 3), (0, 6, 3), (3, 4, 2)]


def test_empty(spark, either):
    assert got(canonical.claim_copies(claims(spark, []))) == []
    assert got(canonical.session_copies(spark.createDataFrame([], SESSION))) == []


def test_against_brute_force(spark, either):
    rng = random.Random(1)
    subj, obj = ["User", "user", "USER ", "Ann Lee", "ann_lee"], ["a; b", "B;A", "a b", "A  B", "a|b;", "", None, "...", "é"]
    rows = [(rng.choice(["s", None]), rng.choice([1, None]), "p", rng.choice(["fact", None]), "one", rng.choice([1, 2, None]), rng.choice(subj), rng.choice(obj)) for _ in range(400)]
    groups: dict = {}
    for i, r in enumerate(rows):
        pieces = sorted(" ".join(WORD.findall(x)) for x in re.split("[;|]", (r[7] or "").lower()))
        pieces = [p for p in pieces if p]
        if pieces:
            groups.setdefault((*r[:6], tuple(WORD.findall(r[6].lower())), tuple(pieces)), []).append(i)
    expected = sorted((g[0], i, len(g)) for g in groups.values() for i in g[1:])
    assert got(canonical.claim_copies(claims(spark, rows))) == expected


def test_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(canonical, "BROADCAST_ROWS", 0)
    rows = [("s", 1, "p", "fact", "one", 5, "u", "v" if i % 3 else f"x{i}") for i in range(3000)]
    out = canonical.claim_copies(claims(spark, rows))
    assert out.count() == 1999
    assert {r.n_copies for r in out.collect()} == {2000}


@pytest.mark.parametrize(
    ("kind", "values", "groups"),
    [
        ("double", ["1.2", "1.7", "1.2", "0.0", "-0.0", "double('NaN')", "double('NaN')", "null", "null"], 5),
        ("decimal(20,4)", ["1.2", "1.7", "1.2", "1.20001", "null"], 3),
        ("timestamp", ["timestamp'2024-01-01 00:00:00.1'", "timestamp'2024-01-01 00:00:00.2'", "timestamp'2024-01-01 00:00:00.1'", "null"], 3),
        ("date", ["date'2024-01-01'", "date'2024-01-02'", "date'2024-01-01'", "date'1970-01-01'", "null"], 4),
        ("boolean", ["true", "false", "true", "null", "null"], 3),
        ("binary", ["x'00'", "x'01'", "x'00'", "null"], 3),
        ("bigint", ["0", "null", "1", "0"], 3),
    ],
)
def test_types_of_columns_that_must_be_equal(spark, kind, values, groups):
    rows_ = " union all ".join(f"select {i} as line_no, cast({v} as {kind}) as x, 'A, b' as t" for i, v in enumerate(values))
    out = canonical.collapse(canonical.encode(spark.sql(rows_), "line_no", ["x"], {"t": F.array(text.spaced_words("t"))}, []), "line_no")
    assert out.count() == groups


def test_a_type_without_a_place_in_a_tuple_is_refused(spark):
    with pytest.raises(TypeError):
        canonical.encode(spark.sql("select 1 as line_no, array(1) as x, 'a' as t"), "line_no", ["x"], {"t": F.array("t")}, [])
