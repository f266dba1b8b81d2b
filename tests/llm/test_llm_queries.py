import pytest
from compare import duck, duck_rows, rows

from memq.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    if name in queries.SQL:
        columns, expected = duck_rows(duck(small), queries.SQL[name])
        assert columns == sorted(df.columns)
        assert rows(df) == expected
    else:
        assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_on_empty_tables(spark, small, name, tmp_path):
    for t in ("sessions", "turns", "claims", "answers", "documents", "eval_items"):
        spark.read.parquet(f"{small}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == (name == "p7_integrity")  # one row of counts


def test_columns_of_the_found_queries(spark, small):
    expected = {
        "p1_found": ["session_id", "idx", "hard_cut"], "p3_found": ["line_no", "defect"], "p5_found": ["src", "keep_key", "copy_key", "n_copies"],
        "p8_found": ["doc_id", "item_id"], "p9_found": ["doc_id", "shared_chars"],
    }
    assert {n: queries.QUERIES[n](spark, small).columns for n in expected} == expected
