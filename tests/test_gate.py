import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from memq.functions import terms
from memq.operators import gate

CLAIMS = [
    ("k_tokyo", "s3", "user", "lives_in", "Tokyo", "fact"), ("k_chicago", "s1", "user", "lives_in", "Chicago", "fact"),
    ("k_shoes", "s2", "user", "owns", "Brooks running shoes", "fact"), ("k_null", None, "user", None, None, None),
]


@pytest.fixture(scope="module")
def parts(spark):
    docs = spark.createDataFrame(CLAIMS, "key string, sid string, subj string, pred string, obj string, kind string")
    return docs, gate.index(docs, "key", terms.claim_document())


def ask(spark, parts, *questions):
    q = spark.createDataFrame(list(enumerate(questions)), "q int, question string")
    return gate.contributions(q, parts[1], "q", F.col("question"))


def test_ranking(spark, parts):
    found = gate.search(ask(spark, parts, "Where do I live?", "what shoes do I own?", "quantum chromodynamics", "what did I do?", None)).collect()
    by = {q: [r.key for r in sorted(found, key=lambda r: r["rank"]) if r.q == q] for q in range(5)}
    assert by == {0: ["k_chicago", "k_tokyo"], 1: ["k_shoes"], 2: [], 3: [], 4: []}


def test_terms_are_shown(spark, parts):
    c = ask(spark, parts, "running shoes of the user")
    t = {r.key: [x.term for x in r.terms] for r in gate.matched_terms(c, gate.search(c)).collect()}
    assert t["k_shoes"] == ["run", "shoe", "user"]
    assert t["k_null"] == ["user"]


def test_sessions_return_claims_that_did_not_match(spark):
    docs = spark.createDataFrame([("a1", "A", "kit one"), ("a2", "A", "kit two"), ("a3", "A", "glue"), ("b1", "B", "kit"), ("n", None, "kit")], "key string, sid string, t string")
    q = spark.createDataFrame([(1, "kits")], "q int, question string")
    c = gate.contributions(q, gate.index(docs, "key", F.col("t")), "q", F.col("question"))
    out = {r.key: r.score for r in gate.search_sessions(c, docs.select("key", "sid"), sessions=1).collect()}
    assert set(out) == {"a1", "a2", "a3"} and out["a3"] == 0 and out["a1"] > 0
    assert {r.key for r in gate.search_sessions(c, docs.select("key", "sid"), sessions=1, per_session=1).collect()} == {"a1"}


def test_scores_against_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}x" for i in range(30)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randrange(0, 12))) for _ in range(80)]
    docs = spark.createDataFrame([(f"d{i:02}", t) for i, t in enumerate(texts)], "key string, t string")
    asked = [" ".join(rng.choices(vocabulary, k=4)) for _ in range(6)]
    q = spark.createDataFrame(list(enumerate(asked)), "q int, question string")
    got = {(r.q, r.key): r.score for r in gate.search(gate.contributions(q, gate.index(docs, "key", F.col("t")), "q", F.col("question")), 1000).collect()}
    counts = [Counter(t.split()) for t in texts]
    avg = sum(sum(c.values()) for c in counts) / len(counts)
    df = Counter(w for c in counts for w in c)
    expected = {}
    for i, question in enumerate(asked):
        for j, c in enumerate(counts):
            s = 0.0
            for w in set(question.split()):
                if c[w]:
                    idf = math.log(1 + (len(texts) - df[w] + 0.5) / (df[w] + 0.5))
                    s += idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avg))
            if s > 0:
                expected[i, f"d{j:02}"] = s
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-5 for k in got)


def test_no_embeddings():
    with pytest.raises(NotImplementedError):
        gate.EmbeddingGate()


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], "key string, t string")
    q = spark.createDataFrame([(1, "kits")], "q int, question string")
    assert gate.search(gate.contributions(q, gate.index(docs, "key", F.col("t")), "q", F.col("question"))).count() == 0
