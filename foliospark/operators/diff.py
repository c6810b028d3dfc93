"""Differences between two copies of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRESENT, KEY, KEY_NULL = "__present", "__k{}", "__n{}"
#: A present row's null, which must not look like an absent row's.
LONG = (T.StringType, T.BinaryType)


def _compared(df: DataFrame, column: str, digest: bool) -> Column:
    """What stands for a value in the comparison: itself, or the digest of a text of any length."""
    kind = df.schema[column].dataType
    return F.sha2(df[column].cast("binary"), 256) if digest and isinstance(kind, LONG) else df[column]


def latest_state(df: DataFrame, keys: list[str], fields: list[str], version: str | None, digest: bool) -> DataFrame:
    """One row a key: the fields of its newest version, with key columns fit for a null-safe equi-join.

    Combined before the shuffle, so a key delivered millions of times moves one row a map task."""
    default = {"string": "", "boolean": False}
    key_columns = []
    for i, key in enumerate(keys):
        kind = df.schema[key].dataType
        key_columns += [F.coalesce(df[key], F.lit(default.get(kind.typeName(), 0)).cast(kind)).alias(KEY.format(i)), df[key].isNull().alias(KEY_NULL.format(i))]
    state = F.struct(*([df[version].alias("v")] if version else []), *(_compared(df, f, digest).alias(f"f{i}") for i, f in enumerate(fields)))
    names = [n for i in range(len(keys)) for n in (KEY.format(i), KEY_NULL.format(i))]
    return df.select(*key_columns, state.alias("state")).groupBy(*names).agg(F.max("state").alias("state"))


def diff_tables(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], version: str | None = None, sides: tuple[str, str] = ("left", "right"), digest: bool = True) -> DataFrame:
    """Every key on which two tables disagree: the keys, `side` and `differences`.

    side is `only_in_<left>`, `only_in_<right>` or `both`; differences is an array of (field,
    left_value, right_value) over the fields that differ, values as strings, empty for a key of one
    side. With `digest`, texts and binaries are compared and shown as their SHA-256, so the width
    of the shuffle does not depend on the length of the texts; without it they stand as they are.

    Null keys match each other; null equals null only, an empty text is not null. Of several rows
    of a key the one with the greatest `version` counts (null versions count as oldest; among
    equals the greatest state). Other columns of either table, whatever their names, are ignored.
    Empty tables give every row of the other side. Both sides are hashed by key once; the full
    outer join takes over that partitioning, so no row moves twice."""
    names = [n for i in range(len(keys)) for n in (KEY.format(i), KEY_NULL.format(i))]
    a = latest_state(left, keys, fields, version, digest).withColumnRenamed("state", "a")
    b = latest_state(right, keys, fields, version, digest).withColumnRenamed("state", "b")
    both = a.join(b, names, "full_outer")
    entries = F.filter(
        F.array(
            *(
                F.when(~F.col(f"a.f{i}").eqNullSafe(F.col(f"b.f{i}")), F.struct(F.lit(f).alias("field"), F.col(f"a.f{i}").cast("string").alias("left_value"), F.col(f"b.f{i}").cast("string").alias("right_value")))
                for i, f in enumerate(fields)
            )
        ),
        lambda x: x.isNotNull(),
    )
    side = F.when(F.col("b").isNull(), f"only_in_{sides[0]}").when(F.col("a").isNull(), f"only_in_{sides[1]}").otherwise("both")
    keys_back = [F.when(~F.col(KEY_NULL.format(i)), F.col(KEY.format(i))).alias(k) for i, k in enumerate(keys)]
    found = both.select(*keys_back, side.alias("side"), F.when(side == "both", entries).otherwise(F.slice(entries, 1, 0)).alias("differences"))
    return found.where((F.col("side") != "both") | (F.size("differences") > 0))


def difference_rows(differences: DataFrame, keys: list[str]) -> DataFrame:
    """`diff_tables` as one row per difference: the keys and `difference`, a side or a field name."""
    one = F.when(F.col("side") == "both", F.transform("differences", lambda d: d["field"])).otherwise(F.array("side"))
    return differences.select(*keys, F.explode(one).alias("difference"))


def difference_counts(differences: DataFrame) -> DataFrame:
    """Rows per kind of difference."""
    return difference_rows(differences, []).groupBy("difference").agg(F.count("*").alias("n"))
