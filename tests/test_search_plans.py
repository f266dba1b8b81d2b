"""Searches come from leading.leading() and never list each pair of a question and a claim that share a term."""

import pytest

from memq.operators import answering, chains, gate, leading
from memq.plans import registry

SEARCHES = [
    "answer_record",
    "bm25_sessions",
    "gather_report",
    "answer_status",
    "bm25_terms",
    "gather_sessions",
    "evidence_items",
    "gather_asof",
    "gather_terms",
    "rendered_evidence",
]


class Searched(Exception):
    pass


@pytest.mark.parametrize("name", SEARCHES)
def test_search_does_not_list_all_pairs(spark, small, monkeypatch, name):
    def searched(*_, **__):
        raise Searched

    def all_pairs(*_, **__):
        raise AssertionError("all pairs are listed")

    monkeypatch.setattr(leading, "leading", searched)
    monkeypatch.setattr(gate, "contributions", all_pairs)
    with pytest.raises(Searched):
        registry.QUERIES[name](spark, small)


def test_gather_terms_makes_no_evidence(spark, small, monkeypatch):
    def evidence(*_, **__):
        raise AssertionError("turns or replaced claims are read")

    monkeypatch.setattr(answering, "evidence_items", evidence)
    monkeypatch.setattr(chains, "supersedes", evidence)
    assert registry.QUERIES["gather_terms"](spark, small).columns == ["q", "hits", "kept", "terms"]


def test_gather_sessions_takes_every_question(spark, small, tmp_path):
    (tmp_path / "claims.parquet").symlink_to(f"{small}/claims.parquet")
    ids = ["00000001", "00000032", "gpt4_no_number", None]
    asked = [(i, "What does the user like?", 2_000_000_000) for i in ids]
    spark.createDataFrame(asked, "question_id string, question string, asked_at bigint").write.parquet(f"{tmp_path}/instances.parquet")
    found = [(r.q, r.n) for r in registry.QUERIES["gather_sessions"](spark, str(tmp_path)).collect()]
    assert sorted(found) == [(q, n) for q in sorted(ids[:3]) for n in range(1, 7)]
