from foliospark.operators.diff import diff_tables, difference_counts, difference_rows

SCHEMA = "id long, v string, n int, at int, differences string, side string"


def diff(spark, left, right, **more):
    a, b = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)
    return diff_tables(a, b, ["id"], ["v", "n"], "at", ("a", "b"), **more)


def rows(df):
    return sorted((str(r.id), r.difference) for r in difference_rows(df, ["id"]).collect())


def test_sides_fields_nulls_and_versions(spark):
    left = [(1, "x", 1, 1, "", ""), (1, "old", 9, 0, "", ""), (2, None, None, 1, None, None), (3, "only", 1, 1, "", ""), (4, "", 1, 1, "", ""), (None, "k", 1, None, "", ""), (5, "s", 5, 1, "", ""), (5, "s", 5, 1, "", "")]
    right = [(1, "x", 1, 7, "other", ""), (2, None, 3, 1, "", ""), (6, "only", 1, 1, "", ""), (4, None, 1, 1, "", ""), (None, "K", 1, 1, "", ""), (5, "s", 5, 3, "", "")]
    found = diff(spark, left, right)
    assert rows(found) == [("2", "n"), ("3", "only_in_a"), ("4", "v"), ("6", "only_in_b"), ("None", "v")]
    assert {r.difference: r.n for r in difference_counts(found).collect()} == {"n": 1, "v": 2, "only_in_a": 1, "only_in_b": 1}


def test_values_stand_as_they_are_without_digest(spark):
    found = diff(spark, [(1, "a", 1, 1, "", "")], [(1, "b", 1, 1, "", "")], digest=False).first()
    assert [(d.field, d.left_value, d.right_value) for d in found.differences] == [("v", "a", "b")]
    long = "x" * 300_000
    assert rows(diff(spark, [(1, long, 1, 1, "", "")], [(1, long + "y", 1, 1, "", "")])) == [("1", "v")]


def test_empty_tables(spark):
    row = [(1, "a", 1, 1, "", "")]
    assert rows(diff(spark, row, [])) == [("1", "only_in_a")] and rows(diff(spark, [], row)) == [("1", "only_in_b")] and rows(diff(spark, [], [])) == []


def test_sides_meet_without_a_second_shuffle(spark):
    plan = diff(spark, [(1, "a", 1, 1, "", "")], [(1, "b", 1, 1, "", "")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
