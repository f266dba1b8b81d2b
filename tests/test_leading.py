import random

import pytest
from pyspark.sql import functions as F

from memq.functions import terms
from memq.operators import gate, leading


def tables(spark, seed):
    """Texts with a few very common words, so that many documents tie, and questions of which some have no rare word."""
    rng = random.Random(seed)
    often, seldom = [f"c{i}x" for i in range(5)], [f"r{i}x" for i in range(25)]
    pick = lambda a, b: " ".join(rng.choices(often, k=rng.randrange(a)) + rng.choices(seldom, k=rng.randrange(b)))
    docs = [(f"d{rng.randrange(10**6):06}-{i}", pick(4, 3)) for i in range(400)] + [(f"e{i:03}", "c0x c1x r0x") for i in range(60)] + [("f", ""), ("g", None)]
    asked = [(f"q{i}", pick(4, 3)) for i in range(25)] + [("q25", "c0x"), ("q26", "c0x r0x"), ("q27", "c1x"), ("q28", "the"), ("q29", None), ("q30", "c0x")]
    return spark.createDataFrame(docs, "key string, t string"), spark.createDataFrame(asked, "q string, question string")


@pytest.mark.parametrize(("limit", "common"), [(1, 3), (5, 0), (5, 5), (5, 48), (70, 4)])
def test_same_as_all_pairs(spark, limit, common):
    docs, asked = tables(spark, limit + common)
    contribs = gate.contributions(asked, gate.index(docs, "key", F.col("t")), "q", F.col("question"))
    expected = {tuple(r) for r in gate.search(contribs, limit).select("q", "key", "score", "rank").collect()}
    hits, matched = leading.leading(asked, docs, "q", F.col("question"), "key", F.col("t"), limit, common=common)
    found = [tuple(r) for r in hits.select("q", "key", "score", "rank").collect()]
    assert len(found) == len(set(found)) and set(found) == expected
    pairs = contribs.join(hits.select("q", "key"), ["q", "key"]).select("q", "key", "term", "contrib")
    assert sorted(map(tuple, matched.collect())) == sorted(map(tuple, pairs.collect()))


def test_common_terms_make_no_pairs_of_questions_and_documents(spark, monkeypatch):
    docs = spark.range(3000).select(F.concat(F.lit("d"), F.lpad("id", 5, "0")).alias("key"), F.concat(F.lit("user likes n"), "id").alias("t"))
    asked = spark.range(200).select(F.concat(F.lit("q"), "id").alias("q"), F.concat(F.lit("what does the user like of n"), "id").alias("question"))
    written = []
    keep = leading.materialize
    monkeypatch.setattr(leading, "materialize", lambda df: (out := keep(df), written.append(out.count()))[0])
    hits, _ = leading.leading(asked, docs, "q", F.col("question"), "key", F.col("t"), 3)
    assert hits.count() == 600 and max(written) <= 3000
    assert [r.key for r in hits.where("q = 'q7'").orderBy("rank").collect()] == ["d00007", "d00000", "d00001"]


def test_no_documents_and_no_questions(spark):
    docs, asked = tables(spark, 1)
    for d, a in ((docs.limit(0), asked), (docs, asked.limit(0))):
        hits, matched = leading.leading(a, d, "q", F.col("question"), "key", F.col("t"), 5)
        assert hits.count() == 0 and matched.count() == 0


def test_front_keeps_scores_between_two_shown_ones(spark):
    rows = [(1, 1, 2000), (1, 2, 1500), (1, 3, 1499), (1, 4, 900)]
    got = leading.front(leading.materialize(spark.createDataFrame(rows, "g int, s int, nano bigint")), "g", "s", 1)
    assert {r.s for r in got.collect()} == {1, 2}


def test_stem_of_a_word_and_of_a_column(spark):
    words = "live lives running runs stopped cities carries address addresses plan plans gas bus national wedding madly rationalization abed bbed fitted ing".split()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in df.select("w", F.expr(terms.stem_sql("w")).alias("s")).collect()} == {w: terms.stem(w) for w in words}


def test_codes_without_a_vocabulary(spark):
    df = spark.createDataFrame([("a", "The Running runs, 5 KM"), ("b", None)], "key string, t string")
    assert {r.key: r.code for r in terms.coded(df, "key", F.col("t"), None).collect()} == {"a": "4 5 km run run", "b": "0"}
    assert {r.key: r.code for r in terms.coded(df, "key", F.col("t"), {"run"}, memo=1).collect()} == {"a": "4 run run", "b": "0"}
