import random

import pytest
from pyspark.sql import functions as F

from memq.operators import chains

SCHEMA = "line_no bigint, sid string, turn int, subj string, pred string, obj string, card string, ts bigint"


def claims(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA)


def links(spark, rows):
    return sorted(map(tuple, chains.supersedes(claims(spark, rows)).select("later", "earlier").collect()))


def said(*values, card="one", pred="lives_in", subj="user"):
    return [(f"s{t}", 0, subj, pred, v, card, t) for v, t in values]


def test_replace_restate_return(spark):
    assert links(spark, said(("Berlin", 100), ("Munich", 200))) == [(1, 0)]
    assert links(spark, said(("Berlin", 100), ("Berlin", 200), ("Berlin", 300))) == []
    assert links(spark, said(("Berlin", 100), ("Munich", 200), ("Berlin", 300))) == [(1, 0), (2, 1)]
    assert links(spark, said(("Berlin", 100), ("Berlin", 200), ("Munich", 300), ("Berlin", 400))) == [(2, 0), (3, 2)]
    assert links(spark, said(("Berlin, Germany", 100), ("berlin_germany", 200))) == []


def test_file_order_subject_case_and_other_predicates(spark):
    assert links(spark, said(("Munich", 300), ("Berlin", 100))) == [(0, 1)]
    assert links(spark, said(("Berlin", 100), subj="User") + said(("Munich", 200), subj="  user ")) == [(1, 0)]
    assert links(spark, said(("Berlin", 100)) + said(("ACME", 200), pred="works_at")) == []


def test_accumulating_disputed_and_missing(spark):
    assert links(spark, said(("a", 1), ("b", 2), ("c", 3), card="many", pred="owns")) == []
    rows = said(("a", 1), ("b", 2), pred="owns") + said(("c", 3), card="many", pred="owns")
    assert links(spark, rows) == []
    assert [tuple(r) for r in chains.disputes(claims(spark, rows)).collect()] == [("owns", 2, 1)]
    assert links(spark, said(("a", 1), ("b", 2), card=None)) == []
    assert links(spark, []) == []
    assert links(spark, [("s", 0, None, "p", "a", "one", 1), ("s", 0, "u", None, "a", "one", 1), ("s", 0, "u", "p", None, "one", 1), ("s", 0, "u", "p", "a", "one", None)]) == []


@pytest.mark.parametrize("chunk", [1, 9, 60, 100_000])
def test_chunks_against_brute_force(spark, chunk):
    rng = random.Random(chunk)
    rows = [(rng.choice("ab"), rng.randrange(250), rng.choice("xyz"), i) for i in range(300)]
    expected = []
    for g in "ab":
        head = None
        for _, t, v, i in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[3])):
            if head is None or head[1] != v:
                if head is not None:
                    expected.append((i, head[0]))
                head = (i, v)
    df = spark.createDataFrame(rows, "g string, ts bigint, v string, k bigint")
    out = chains.run_links(df, ["g"], ["ts"], "v", "k", chunk)
    assert sorted(map(tuple, out.select("later", "earlier").collect())) == sorted(expected)


def test_walks_and_paths(spark):
    chain = spark.createDataFrame([(4, 3), (3, 2), (2, 1)], "later int, earlier int")
    assert sorted(map(tuple, chains.walk(chain).where("start = 4").collect())) == [(4, 1, 3), (4, 2, 2), (4, 3, 1)]
    assert chains.walk(chain, spark.createDataFrame([(3,)], "x int")).count() == 2
    assert chains.walk(chain, hops=1).count() == 3
    found = {r.hops: r.path for r in chains.paths(chain).where("start = 4").collect()}
    assert found == {1: [4, 3], 2: [4, 3, 2], 3: [4, 3, 2, 1]}
    assert chains.paths(chain).where((F.col("start") == 4) & (F.col("target") == 1)).count() == 1
