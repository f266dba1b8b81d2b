import hashlib
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memq.functions import keys, report, terms, text, timeparse


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", list: "array<string>", type(None): "string", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(
    ("raw", "stem"),
    [("plans", "plan"), ("planning", "plan"), ("planned", "plan"), ("shoes", "shoe"), ("passes", "pass"), ("kits", "kit"), ("gas", "gas"), ("bus", "bus"), ("buying", "buying"), ("studies", "study"), ("pass", "pas")],
)
def test_stems_in_both_forms(spark, raw, stem):
    assert one(spark, F.expr(terms.stem_sql("w")), w=raw) == stem
    assert one(spark, terms.terms("w"), w=raw) == [stem]


def test_terms_of_a_question(spark):
    assert one(spark, terms.terms("w"), w="What did I do?") == []
    assert one(spark, terms.terms("w"), w="planning_hiking_trip Café") == ["plan", "hiking", "trip", "caf"]
    assert one(spark, terms.terms("w"), w=None) == []
    assert one(spark, terms.terms("w", stemming=False), w="what SHOES do I own") == ["shoes"]


def test_words_values_entities(spark):
    assert one(spark, text.words("w"), w="Été_2 — naïve!") == ["été", "2", "naïve"]
    assert one(spark, text.words("w"), w="") == []
    assert one(spark, text.words("w"), w=None) is None
    assert one(spark, text.value("w"), w="b: 2; ;a 1|") == "a 1;b 2"
    assert one(spark, text.value("w"), w=" ?! ") is None
    assert one(spark, text.value("w"), w=None) is None
    assert one(spark, text.entity("w"), w="\tUSER   's Cousin\n") == "user 's cousin"
    assert one(spark, text.strip("w"), w="  a b\n") == "a b"


def test_normal_object_and_predicate(spark):
    a = one(spark, keys.normal_object("w"), w="Berlin, Germany")
    assert a == one(spark, keys.normal_object("w"), w="berlin_germany") == "berlin germany"
    assert one(spark, keys.predicate("w"), w="  Lives  In ") == "lives_in"


def test_keys(spark):
    digits = hashlib.sha256(b"Claim|k").hexdigest()[:13]
    assert one(spark, keys.stable_id("Claim", "w"), w="k") == max(1, int(digits, 16)) < 2**52
    assert one(spark, keys.statement_key(F.col("s"), F.col("i")), s="a", i=3) == "a|3"
    turns = [("user", "hi"), ("assistant", "yo")]
    df = spark.createDataFrame([(turns,)], "turns array<struct<role:string,content:string>>")
    expected = hashlib.sha256("".join(f"{r}\0{c}\1" for r, c in turns).encode()).hexdigest()[:16]
    assert df.select(keys.content_hash("turns")).first()[0] == expected
    pairs = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (2, "c")], "id int, k string")
    assert [r.id for r in keys.collisions(pairs, "id", "k").collect()] == [2]


@pytest.mark.parametrize("bad", ["2023/04/10 (Tue) 23:07", "", "2023-04-10T23:07", None, "2023/02/30 (Thu) 10:00", "2023/04/10 23:07"])
def test_dates_that_are_rejected(spark, bad):
    assert one(spark, timeparse.try_epoch("w"), w=bad) is None
    with pytest.raises(PySparkException):
        one(spark, timeparse.epoch("w"), w=bad)


def test_dates(spark):
    assert one(spark, timeparse.epoch("w"), w="2023/04/10 (Mon) 23:07") == 1681168020
    assert one(spark, timeparse.human_date("w"), w=1681138020) == "2023-04-10 (Mon)"
    assert one(spark, timeparse.human_date(F.col("w").cast("bigint")), w=None) == "unknown"
    assert one(spark, timeparse.minute("w"), w=1681138020) == "1681138020  (2023-04-10 14:47)"
    assert [one(spark, timeparse.tolerance_label("w"), w=s) for s in (0, 3600, 21600, 86400, 604800)] == ["strict", "+1h", "+6h", "+1d", "+7d"]


def test_report_expressions(spark):
    assert [one(spark, report.read_verdict("w"), w=v) for v in ("true", " Yes", "INCORRECT", "no", "maybe", None)] == ["correct", "correct", "incorrect", "incorrect", "unjudged", "unjudged"]
    assert [one(spark, report.says_not_in_memory("w"), w=v) for v in ("not in memory", "NOT_IN_MEMORY", "", None, "Berlin")] == [True, True, True, True, False]
    assert one(spark, report.strip_fences("w"), w="```json\n[1]\n```") == "[1]"
    assert one(spark, report.one_line("w", 5), w=" a \n b c d") == "a b c"
    assert one(spark, report.ratio(F.lit(165), F.lit(234)), w=1) == 0.7051
    assert one(spark, report.ratio(F.lit(1), F.lit(0)), w=1) is None
    assert one(spark, report.conversion(F.lit(0.7222), F.lit(0.9306)), w=1) == 0.776
    assert one(spark, report.conversion(F.lit(0.0), F.lit(0.9306)), w=1) is None
    assert one(spark, report.is_abstention("w"), w="gpt4_x_abs") is True
    assert one(spark, report.status("w"), w=" Answered ") == "answered"


def test_chunks_and_back(spark):
    for s in ("", "a" * 12_000, "a" * 12_001, "é" * 30_000):
        parts = one(spark, report.chunks("w"), w=s)
        assert "".join(parts) == s and len(parts) == max(1, -(-len(s) // 12_000))
    assert one(spark, report.join_chunks("w", F.lit(2)), w=["hello ", "world"]) == "hello world"
    for broken in (["a", None], ["a"]):
        df = spark.createDataFrame([(broken,)], T.StructType([T.StructField("w", T.ArrayType(T.StringType()))]))
        with pytest.raises(PySparkException):
            df.select(report.join_chunks("w", F.lit(2))).collect()


def test_stopwords_are_plain_words():
    assert len(set(terms.STOPWORDS)) == len(terms.STOPWORDS)
    assert all(re.fullmatch("[a-z0-9]+", w) for w in terms.STOPWORDS)
