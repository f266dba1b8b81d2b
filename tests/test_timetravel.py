from pyspark.sql import functions as F

from memq.operators import timetravel

SCHEMA = "line_no bigint, pred string, subj string, obj string, ts bigint"


def facts(spark, *values, subj="user"):
    return spark.createDataFrame([(i, "p", subj, v, t) for i, (v, t) in enumerate(values)], SCHEMA)


def test_changed_facts(spark):
    of = lambda *v: [tuple(r) for r in timetravel.changed_facts(facts(spark, *v)).select("values", "mentions", "span").collect()]
    assert of(("a", 1), ("a", 2)) == []
    assert of(*[(str(i), i) for i in range(30)]) == []
    assert of(*[("Lisbon", i) for i in range(10)], *[("Porto", 20 + i) for i in range(10)]) == [(2, 20, 29)]
    assert of(("a", 1), ("b", None), (None, 3)) == []
    assert of(*[("ab"[i % 2], i) for i in range(41)]) == []
    two = facts(spark, ("a", 1)).union(facts(spark, ("b", 2), subj="other"))
    assert timetravel.changed_facts(two).count() == 0


def test_order_of_facts(spark):
    f = spark.createDataFrame([("p", "x", 3, 5, 10), ("p", "y", 2, 5, 10), ("p", "z", 2, 5, 90)], "pred string, subj string, values int, mentions int, span bigint")
    chain = spark.createDataFrame([("p", "x", 4)], "pred string, subj string, chain int")
    assert [r.subj for r in timetravel.ranked_facts(f, chain).orderBy("place").collect()] == ["x", "z", "y"]
    assert [r.subj for r in timetravel.ranked_facts(f, chain, probe=2).orderBy("place").collect()] == ["z", "y"]


def test_marks(spark):
    def of(rows):
        df = spark.createDataFrame([(rows,)], "rows array<struct<ts:bigint,obj:string>>")
        return df.select(timetravel.marks(F.col("rows"))).first()[0]

    assert of([(100, "A"), (200, "A"), (300, "B")]) == [100 - 86_400, 100, 300]
    assert of([(100, "A"), (100, "B"), (200, "B"), (300, "A")]) == [100 - 86_400, 100, 200, 300]
    many = of([(i, "AB"[i % 2]) for i in range(50)])
    assert len(many) == 7 and many[1] == 0 and many[-1] == 49
    assert many[1:] == [round(i * 49 / 5) for i in range(6)]


def test_marks_of_changed_facts(spark):
    c = facts(spark, ("a", 100), ("a", 150), ("b", 200))
    out = timetravel.change_marks(c, timetravel.changed_facts(c)).orderBy("mark").collect()
    assert [r.mark for r in out] == [100 - 86_400, 100, 200]
