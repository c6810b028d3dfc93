import pytest
from oracle import same_rows

import __spark_entry__ as entry
from foliospark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_are_those_of_sql(spark, data, name):
    assert same_rows(queries.QUERIES[name](spark, data), queries.SQL[name], data)


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_queries_without_sql_run(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_columns_of_the_found_queries(spark, data):
    want = {1: ["table_name", "rec_id"], 2: ["line_id"], 3: ["page_uid"], 4: ["page_uid"], 6: ["table_name", "rec_id"], 8: ["item_id", "doc_id"], 9: ["doc_id_a", "doc_id_b"]}
    for n, columns in want.items():
        df = entry.queries()[f"p{n}_found"](spark, data)
        assert df.columns == columns and df.count() == df.distinct().count()
    ids = entry.queries()["p7_ids"](spark, data)
    assert ids.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
