import random
import re

from foliospark.llm import boilerplate as B

SCHEMA = "line_id long, book_id long, publisher string, page_num int, top double, text string, ingested_at int, depth string, run string"


def norm(text):
    return re.sub(r"\d+", "0", " ".join(text.lower().split()))


def brute(rows, least):
    books = {}
    for _, book, source, _, _, text, *_ in rows:
        if text is not None and book is not None:
            books.setdefault((source, norm(text)), set()).add(book)
    return {r[0] for r in rows if r[0] is not None and r[5] is not None and len(books.get((r[2], norm(r[5])), ())) >= least}


def made(seed, hot=0.35):
    rng = random.Random(seed)
    rows, n = [], 0
    for book in range(60):
        source = "big" if rng.random() < hot else f"p{rng.randint(0, 4)}"
        for page in range(1, 4):
            for top in range(rng.randint(1, 9)):
                n += 1
                kind = rng.random()
                text = "Page %d of %d" % (page, rng.randint(1, 99)) if kind < 0.3 else "All  RIGHTS reserved" if kind < 0.4 else None if kind < 0.45 else f"rare {rng.choice('abcdefg')}" if kind < 0.6 else f"own line {n} {rng.choice('xyz')}" + "q" * (n % 50)
                rows.append((n, None if n % 97 == 0 else book, None if n % 53 == 0 else source, page if n % 41 else None, float(top), text, 0, "d", "r"))
                if n % 10 == 0:
                    rows.append(rows[-1][:6] + (1, "d", "r"))
    return rows


def test_lines_are_those_of_brute_force(spark):
    for seed in (1, 2):
        rows = made(seed)
        df = spark.createDataFrame(rows, SCHEMA)
        got = {r.line_id for r in B.repeated_lines(df).collect()}
        assert got == brute(rows, 5) and got


def test_chunks_of_the_order_do_not_matter(spark):
    rows = made(3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in B.repeated_lines(df).collect()}
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in (1, 7):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            assert {tuple(r) for r in B.repeated_lines(df).collect()} == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_blocks_of_lines(spark):
    rows = []
    for book in range(6):
        for top, text in enumerate(["Notice", "of all rights", "and more", f"own {'abcdef'[book]}"]):
            rows.append((book * 10 + top, book, "p", 1, float(top), text, 0, "", ""))
    got = {r.line_id: r.block_lines for r in B.repeated_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: v for k, v in got.items() if k < 10} == {0: 3, 1: 2, 2: 1}


def test_what_is_left(spark):
    rows = made(4)
    df = spark.createDataFrame(rows, SCHEMA)
    left = B.own_pages(df, B.repeated_lines(df))
    gone = brute(rows, 5)
    kept = {r[0]: r[5] for r in rows if r[5] is not None and r[0] not in gone}
    assert left.agg({"lines": "sum"}).first()[0] == len(kept) and sorted("\n".join(r.text for r in left.collect()).split("\n")) == sorted(kept.values())


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert B.repeated_lines(df).count() == 0 and B.own_pages(df, B.repeated_lines(df)).count() == 0
    one = spark.createDataFrame([(1, 1, "p", 1, 1.0, "x" * 200_000, 0, "", ""), (2, 1, "p", 1, 1.0, "", 0, "", "")], SCHEMA)
    assert B.repeated_lines(one).count() == 0
