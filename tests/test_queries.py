"""Every registered core query against its SQL over the smallest tables, and over empty ones."""

import pytest
from compare import duck, duck_rows, rows

from memq.plans import registry


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, small, con, name):
    df = registry.QUERIES[name](spark, small)
    columns, expected = duck_rows(con, registry.SQL[name])
    assert columns == sorted(df.columns)
    assert rows(df) == expected


@pytest.fixture(scope="module")
def empty(spark, small, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("sessions", "turns", "claims", "instances", "question_targets", "answers", "documents", "eval_items"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return str(d)


#: Queries that are one row of counts whatever the input.
ONE_ROW = {
    "score_retrieval", "retrieval_drops", "tally", "abstention", "report_headline", "dataset_stats", "turns_per_session", "out_of_order", "property_filters", "chain_summary", "claim_load", "ingest_summary", "claim_lookup", "evidence_items",
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_on_empty_tables(spark, empty, name):
    expected = 3 if name == "cache_states" else 1 if name in ONE_ROW else 0  # three states, each counted
    assert registry.QUERIES[name](spark, empty).count() == expected


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.SQL)

