import random

import numpy as np
import pytest

from memq.llm import spans


def brute(texts, span):
    first, many = {}, set()
    for i, t in enumerate(texts):
        for j in range(len(t or "") - span + 1):
            if first.setdefault(t[j : j + span], i) != i:
                many.add(t[j : j + span])
    out = {}
    for i, t in enumerate(texts):
        hit = np.zeros(len(t or ""), int)
        for j in range(len(t or "") - span + 1):
            if t[j : j + span] in many:
                hit[j : j + span] = 1
        if hit.any():
            out[i] = int(hit.sum())
    return out


def got(spark, texts, span, anchor):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, anchor string, span int")
    return {r.doc_id: r.shared_chars for r in spans.shared_chars(df, "doc_id", "text", span, anchor).collect()}


@pytest.fixture(params=[50_000, 5], ids=["plain", "salted"])
def either(request, monkeypatch):
    monkeypatch.setattr(spans, "PER_TASK", request.param)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, either, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choices("abé👍 \n", k=rng.randrange(20, 200))) for _ in range(6)]
    texts = [None, "", "short"]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            b = rng.choice(base)
            s = rng.randrange(len(b))
            parts += [b[s : s + rng.randrange(10, 150)], "".join(rng.choices("xyz", k=rng.randrange(0, 30)))]
        texts.append("".join(parts))
    expected = brute(texts, 30)
    assert expected
    assert got(spark, texts, 30, 10) == expected


def test_repeats_copies_and_runs(spark, either):
    texts = ["a" * 100, "a" * 35 + "b" * 35, "ab" * 50, "ab" * 20, "c" * 60 + "d" * 60, "c" * 60 + "d" * 60, "c" * 29 + "e", "same text inside one document " * 4]
    assert got(spark, texts, 30, 10) == brute(texts, 30)


def test_a_passage_in_very_many_documents(spark, either):
    rng = random.Random(9)
    shared = "".join(rng.choices("abcdefgh", k=80))
    texts = ["".join(rng.choices("uvwxyz", k=40)) + shared + "".join(rng.choices("uvwxyz", k=40)) for _ in range(300)]
    assert got(spark, texts, 30, 10) == brute(texts, 30)


def test_empty_and_production_size(spark):
    assert got(spark, [], 30, 10) == {}
    rng = random.Random(4)
    a = "".join(rng.choices("abcdefghij ", k=200_000))
    assert got(spark, [a, "x" * 50 + a[5_000:5_300], "y" + a[9_000:9_299]], 300, 100) == {0: 300, 1: 300}


def test_sliding_minimum():
    rng = np.random.default_rng(0)
    for n, w in ((1, 1), (7, 3), (50, 50), (64, 8), (65, 8)):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        assert (spans._sliding_min(x, w) == [x[i : i + w].min() for i in range(n - w + 1)]).all()
