"""A query's rows beside those of its SQL."""

import os

import duckdb


def canonical(value):
    if isinstance(value, float):
        return repr(round(value, 6))
    if isinstance(value, dict):
        return str(sorted((str(k), canonical(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return str(value)


def rows_of_sql(sql, folder, columns):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for file in os.listdir(folder):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{folder}/{file}')")
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    assert sorted(names) == columns
    return sorted(tuple(canonical(row[names.index(c)]) for c in columns) for row in done.fetchall())


def same_rows(df, sql, folder):
    columns = sorted(df.columns)
    got = sorted(tuple(canonical(r.asDict(True)[c]) for c in columns) for r in df.collect())
    assert got == rows_of_sql(sql, folder, columns)
    return got
