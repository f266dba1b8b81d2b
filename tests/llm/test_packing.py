import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from memq.llm import packing


def check(lengths, capacity):
    used: dict = {}
    bins = 0
    slack = 0
    for first, times, take in packing.fill(lengths, capacity):
        assert first == bins and times > 0
        size = sum(k * n for k, n in take.items())
        assert 0 < size <= capacity
        bins += times
        slack += times * (capacity - size)
        for k, n in take.items():
            used[k] = used.get(k, 0) + n * times
    assert used == {k: n for k, n in lengths.items() if n}
    return bins, slack


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 9)))
def test_every_item_once_within_capacity(lengths):
    check(lengths, 40)


def test_close_to_the_least_possible():
    rng = random.Random(0)
    lengths: dict = {}
    for _ in range(5_000):
        k = min(2048, int(rng.paretovariate(0.8) * 20))
        lengths[k] = lengths.get(k, 0) + 1
    bins, _ = check(lengths, 2048)
    total = sum(k * n for k, n in lengths.items())
    halves = sum(n for k, n in lengths.items() if k > 1024)
    assert bins <= max(-(-total // 2048), halves) * 1.01 + 1


def test_steps_depend_on_lengths_not_items():
    lengths = {k: 10**9 + k for k in range(1, 300)}
    assert len(packing.fill(lengths, 2048)) < 20_000
    check(lengths, 2048)


def test_bad_lengths():
    for bad in ({0: 1}, {41: 1}):
        with pytest.raises(ValueError):
            packing.fill(bad, 40)
    assert packing.fill({}, 40) == []


def test_frame(spark):
    enc = packing.encoder(packing.TOKENIZER, packing.vocabulary(packing.TOKENIZER))
    texts = ["", None, "one two three", "one two three", "word " * 300, " ".join(map(str, range(400))), "é" * 200]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id bigint, text string, container string, rank int")
    out = packing.assign(df, "doc_id", "text", capacity=100).collect()
    by: dict = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.piece_no)):
        by.setdefault(r.doc_id, []).append(r)
    for i, t in enumerate(texts):
        n = len(enc.encode_ordinary(t or ""))
        assert sum(r.n_tokens for r in by[i]) == n
        assert [r.token_from for r in by[i]] == [100 * j for j in range(len(by[i]))]
        assert len(by[i]) == max(1, -(-n // 100))
    assert {r.container for i in (0, 1) for r in by[i]} == {-1}
    loads: dict = {}
    for r in out:
        if r.container >= 0:
            loads[r.container] = loads.get(r.container, 0) + r.n_tokens
    assert max(loads.values()) <= 100 and sorted(loads) == list(range(len(loads)))
    assert packing.assign(df.limit(0), "doc_id", "text").count() == 0


def test_ranks_of_a_hot_length(spark, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 50)
    df = spark.range(1_000).selectExpr("id as doc_id", "'a b c' as text")
    out = packing.assign(df, "doc_id", "text", capacity=10)
    loads = {r["container"]: r["n"] for r in out.groupBy("container").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "n").collect()}
    assert set(loads.values()) <= {9, 3} and len(loads) == 334
