"""Lines that return in book after book of one source.

Each line stands for its text by an identifier; the suffix array over all sources is the sorted
order of the identifier sequences that begin at each line, DEPTH identifiers deep. It is built by
one range shuffle, so a source or a line of any frequency spreads over many tasks. Neighbours in
the order with a common prefix form the repeated blocks: one of d lines is a run of suffixes that
agree in d identifiers, and it goes if its run holds enough books. Runs that a chunk of the order
cuts are settled from the chunks' parts; a part sends at most as many books as decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.session import cut

DEPTH, MIN_BOOKS = 4, 5
#: Identifier of the place after a page's last line; a line's own is never zero.
END = 0


def same_text(text: Column) -> Column:
    """Lower case, trimmed, each run of white space one blank, each run of digits one sign."""
    space = r"[\s\x1c-\x1f\x85]+"
    low = F.regexp_replace(F.lower(text), f"(?U)^{space}|{space}$", "")
    return F.regexp_replace(F.regexp_replace(low, f"(?U){space}", " "), r"\p{Nd}+", "0")


def suffixes(lines: DataFrame, source: str, book: str, page: str, top: str, line: str, text: str, depth: int) -> DataFrame:
    """(line, book, h, i0..): each line with the identifiers from it on, within its page."""
    norm = same_text(lines[text])
    one = lines.where(lines[text].isNotNull() & lines[line].isNotNull()).select(
        lines[line].cast("long").alias("line"), lines[book].cast("long").alias("book"), lines[page].alias("page"), lines[top].alias("top"),
        F.xxhash64(F.lit(1), norm, lines[source]).alias("h"), F.xxhash64(lines[source], norm).alias("i0"),
    )
    placed = one.withColumn("i0", F.when(F.col("i0") == END, 1).otherwise(F.col("i0"))).repartition("book", "page").dropDuplicates(["book", "page", "line"])
    order = Window.partitionBy("book", "page").orderBy("top", "line")
    return placed.select("line", "book", "h", "i0", *(F.coalesce(F.lead("i0", d).over(order), F.lit(END)).alias(f"i{d}") for d in range(1, depth)))


FOUND = T.StructType([T.StructField("line", T.LongType()), T.StructField("depth", T.IntegerType()), T.StructField("run", T.LongType()), T.StructField("books", T.ArrayType(T.LongType()))])


def _chunk(batch: pa.RecordBatch, depth: int, least: int) -> pa.RecordBatch:
    """The lines of a chunk's settled runs (run null), those of its cut runs, and the cut runs' books."""
    line, book = (batch.column(i).fill_null(0).to_numpy(zero_copy_only=False) for i in (0, 1))
    keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, batch.num_columns)]
    known = ~np.asarray(batch.column(1).is_null())
    n, out = len(line), {k: [] for k in FOUND.names}

    def put(lines, d, runs, books) -> None:
        for name, values in zip(FOUND.names, (lines, [d] * len(books), runs, books)):
            out[name].extend(values)

    new = np.ones(n, bool)
    new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
    prefix = keys[0].copy()
    for d in range(1, depth + 1):
        if d > 1:
            new[1:] |= keys[d][1:] != keys[d][:-1]
            with np.errstate(over="ignore"):
                prefix = (prefix ^ keys[d]) * np.int64(-7046029254386353131) + np.int64(d)
        whole = keys[d] != END
        run = np.cumsum(new) - 1
        pairs = np.unique(np.stack([run[known], book[known]]), axis=1)
        counts = np.bincount(pairs[0], minlength=run[-1] + 1)
        cut = np.zeros(run[-1] + 1, bool)
        cut[[0, -1]] = True
        settled = np.flatnonzero(((counts >= least) & ~cut)[run] & whole)
        put(line[settled].tolist(), d, [None] * len(settled), [None] * len(settled))
        for r in {0, int(run[-1])}:
            rows = np.flatnonzero((run == r) & whole)
            if len(rows):
                key = int(prefix[rows[0]])
                books = pairs[1][pairs[0] == r][:least].tolist()
                put([None], d, [key], [books])
                put(line[rows].tolist(), d, [key] * len(rows), [None] * len(rows))
    return pa.RecordBatch.from_arrays([pa.array(out["line"], pa.int64()), pa.array(out["depth"], pa.int32()), pa.array(out["run"], pa.int64()), pa.array(out["books"], pa.list_(pa.int64()))], FOUND.names)


def repeated_lines(lines: DataFrame, source: str = "publisher", book: str = "book_id", page: str = "page_num", top: str = "top", line: str = "line_id", text: str = "text", least: int = MIN_BOOKS, depth: int = DEPTH) -> DataFrame:
    """(line_id, block_lines): each line that begins a block of like lines found in `least` books of its source.

    block_lines is the longest such block, up to `depth` lines. As a block of one line is a block,
    these are exactly the lines whose text `least` books of the source hold. Rows of null text or
    id are no case; a null source is a source; a null book counts as none; null pages and places
    come first; rows of one line id in a page count once. Empty tables give no row."""
    order = suffixes(lines, source, book, page, top, line, text, depth)
    keys = ["h", *(f"i{d}" for d in range(depth))]
    array = order.select("line", "book", *keys).repartitionByRange(*keys, "line").sortWithinPartitions(*keys, "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _chunk(batch, depth, least)

    chunks = cut(array.mapInArrow(run, FOUND))
    decided = chunks.where("line IS NULL").select("depth", "run", F.explode("books").alias("b")).groupBy("depth", "run").agg(F.countDistinct("b").alias("n")).where(F.col("n") >= least).select("depth", "run")
    late = chunks.where("line IS NOT NULL AND run IS NOT NULL").join(decided, ["depth", "run"]).select("line", "depth")
    return chunks.where("line IS NOT NULL AND run IS NULL").select("line", "depth").unionByName(late).groupBy(F.col("line").alias("line_id")).agg(F.max("depth").alias("block_lines"))


def own_pages(lines: DataFrame, repeated: DataFrame, book: str = "book_id", page: str = "page_num", top: str = "top", line: str = "line_id", text: str = "text") -> DataFrame:
    """(book_id, page_num, lines, text): each page's remaining lines in their order; a page of none is left out."""
    kept = lines.select(lines[line].alias("line_id"), lines[book].alias("book_id"), lines[page].alias("page_num"), lines[top].alias("top"), lines[text].alias("text"))
    kept = kept.where("text IS NOT NULL").join(repeated.select("line_id"), "line_id", "left_anti").dropDuplicates(["line_id"])
    pages = kept.groupBy("book_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("top", "line_id", "text"))).alias("l"))
    return pages.select("book_id", "page_num", F.size("l").alias("lines"), F.array_join(F.col("l.text"), "\n").alias("text"))
