import pytest
from oracle import same_rows

import __spark_entry__ as entry
from foliospark import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_are_those_of_sql(spark, data, name):
    rows = same_rows(queries.QUERIES[name](spark, data), queries.SQL[name], data)
    assert rows, "the comparison must not be of nothing"


@pytest.mark.parametrize("name", sorted(queries.QUERIES.keys() - queries.SQL.keys()))
def test_queries_without_sql_run(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert queries.QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()


def test_ranges_of_pages_with_gaps_of_their_own(spark, data):
    got = entry.queries()["mismatch_ranges"](spark, data).collect()
    assert got and any("," in r.ranges for r in got)
