import pytest

from memq.operators import lookup


def test_by_key(spark):
    t = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "k string, v int, found_at string")
    w = spark.createDataFrame([("a",), ("zz",), (None,), ("a",)], "k string")
    assert {(r.k, r.v, r.found) for r in lookup.by_key(t, "k", w).collect()} == {("a", 1, True), ("zz", None, False), (None, None, False)}
    assert lookup.by_key(t.limit(0), "k", w).where("found").count() == 0


def test_property_of(spark):
    t = spark.createDataFrame([("a", 1), ("b", None), ("c", 1), ("c", 2)], "k string, v int")
    assert lookup.property_of(t, "k", "a", "v") == 1
    assert lookup.property_of(t, "k", "b", "v", 7) == 7
    assert lookup.property_of(t, "k", "none", "v") is None
    with pytest.raises(ValueError):
        lookup.property_of(t, "k", "c", "v")


def test_parameters_are_values(spark):
    t = spark.createDataFrame([("a' or '1'='1", 1), ("b", 2)], "k string, v int")
    assert lookup.run(t, "select v from {t} where k = :k", k="a' or '1'='1").first().v == 1
    assert lookup.run(t, "select v from {t} where k = :k", k="x' or '1'='1").count() == 0
