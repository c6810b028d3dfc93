"""The queries of the text operators by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import boilerplate, encodings, leaks, lookalikes, quality, scans, spans, tokenize
from foliospark.session import cut, table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Page texts and text segments as records; the source is who made the text."""
    pages, segments = table(spark, folder, "page_text"), table(spark, folder, "text_segment")
    return encodings.records([("page_text", pages, "page_uid", "raw_text", "extractor"), ("text_segment", segments, "segment_id", "text", "publisher")])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records with a stretch read in a wrong encoding."""
    rows = _records(spark, folder)
    return encodings.garbled(rows, encodings.learn(rows))


def p1_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Their texts as written."""
    rows = _records(spark, folder)
    return encodings.restored(rows, encodings.learn(rows))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Lines whose text returns in five books of their publisher."""
    return boilerplate.repeated_lines(table(spark, folder, "page_line")).select("line_id")


def p2_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages without those lines."""
    lines = table(spark, folder, "page_line")
    return boilerplate.own_pages(lines, boilerplate.repeated_lines(lines))


def p2_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Each such line with the lines of the longest repeated block that begins at it."""
    return boilerplate.repeated_lines(table(spark, folder, "page_line"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of prose with damage of scanning or page layout."""
    return scans.repaired_pages(table(spark, folder, "page_text"), table(spark, folder, "book"), only_damaged=True).select("page_uid").distinct()


def p3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """All pages of prose as running paragraphs."""
    return scans.repaired_pages(table(spark, folder, "page_text"), table(spark, folder, "book"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pages that are a list, a table or junk."""
    return quality.not_prose(p4_figures(spark, folder))


def p4_figures(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's figures and kind."""
    return quality.page_figures(table(spark, folder, "page_text"), table(spark, folder, "book"))


def _lookalikes(spark: SparkSession, folder: str) -> DataFrame:
    """Suspect words of the records that are not garbled; only records with suspects are judged."""
    rows = _records(spark, folder)
    suspects = cut(lookalikes.suspect_records(rows, encodings.words_of(F.col("text"))))
    return lookalikes.occurrences(suspects).join(encodings.garbled(suspects, encodings.learn(rows)), ["table_name", "rec_id"], "left_anti")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that hold look-alike characters."""
    return _lookalikes(spark, folder).select("table_name", "rec_id").distinct()


def p6_unified(spark: SparkSession, folder: str) -> DataFrame:
    """Their texts in one consistent form."""
    return lookalikes.unified(_records(spark, folder), _lookalikes(spark, folder))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return tokenize.encode_column(table(spark, folder, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text again, from its ids."""
    return tokenize.decode_column(p7_ids(spark, folder), "doc_id", "ids")


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items and the documents that hold at least eight consecutive words of them."""
    return leaks.leaked_pairs(leaks.window_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    """How much of an item a document holds, by windows of eight words.

    At this window and a similarity of 0.8 a window with one changed word is no near copy; `window_hits`
    finds such copies with longer windows and a greater radius."""
    return leaks.leak_report(leaks.window_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of documents with a common substring of 240 code points."""
    at = spans.surroundings(table(spark, folder, "documents"))
    return spans.shared_pairs(at, spans.verified_contexts(at))


def p9_share(spark: SparkSession, folder: str) -> DataFrame:
    """How much of each document stands in another."""
    documents = table(spark, folder, "documents")
    at = spans.surroundings(documents)
    return spans.shared_share(documents, at, spans.verified_contexts(at, pairs=False))


def p9_components(spark: SparkSession, folder: str) -> DataFrame:
    """The clusters of documents linked by shared spans."""
    at = spans.surroundings(table(spark, folder, "documents"))
    return spans.components(at, cut(spans.verified_contexts(at, pairs=False)))


WINDOWS = r"""
WITH w AS (SELECT {key}, regexp_extract_all(replace(lower(text), 'ς', 'σ'), '[\p{{L}}\p{{N}}]+') AS l FROM {table} WHERE text IS NOT NULL),
p AS (SELECT {key}, l, unnest(generate_series(1, len(l) - 7)) AS i FROM w WHERE len(l) >= 8)
SELECT DISTINCT {key}, array_to_string(l[i:i + 7], ' ') AS s FROM p
"""
P2 = r"""
WITH l AS (SELECT DISTINCT line_id, book_id, publisher, page_num, top, text FROM page_line WHERE text IS NOT NULL),
n AS (SELECT *, regexp_replace(trim(regexp_replace(lower(text), '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '\p{Nd}+', '0', 'g') AS k FROM l),
r AS (SELECT publisher, k FROM n GROUP BY publisher, k HAVING count(DISTINCT book_id) >= 5),
f AS (SELECT n.line_id FROM n JOIN r ON n.publisher IS NOT DISTINCT FROM r.publisher AND n.k = r.k)
"""
#: Blocks of any depth up to the four of the query: runs of lines of one page whose texts return together in five books.
P2_BLOCKS = P2.replace("f AS (SELECT n.line_id FROM n", "f0 AS (SELECT n.line_id FROM n") + """,
o AS (SELECT line_id, book_id, publisher, k, lead(k, 1) OVER w AS k1, lead(k, 2) OVER w AS k2, lead(k, 3) OVER w AS k3 FROM n WINDOW w AS (PARTITION BY book_id, page_num ORDER BY top NULLS FIRST, line_id)),
b1 AS (SELECT publisher, k, 1 AS d, NULL AS x, NULL AS y, NULL AS z FROM o GROUP BY publisher, k HAVING count(DISTINCT book_id) >= 5),
b2 AS (SELECT publisher, k, k1 FROM o WHERE k1 IS NOT NULL GROUP BY ALL HAVING count(DISTINCT book_id) >= 5),
b3 AS (SELECT publisher, k, k1, k2 FROM o WHERE k2 IS NOT NULL GROUP BY ALL HAVING count(DISTINCT book_id) >= 5),
b4 AS (SELECT publisher, k, k1, k2, k3 FROM o WHERE k3 IS NOT NULL GROUP BY ALL HAVING count(DISTINCT book_id) >= 5)
SELECT o.line_id, max(CASE WHEN b4.k IS NOT NULL THEN 4 WHEN b3.k IS NOT NULL THEN 3 WHEN b2.k IS NOT NULL THEN 2 ELSE 1 END)::INT AS block_lines FROM o
JOIN b1 ON o.publisher IS NOT DISTINCT FROM b1.publisher AND o.k = b1.k LEFT JOIN b2 ON o.publisher IS NOT DISTINCT FROM b2.publisher AND o.k = b2.k AND o.k1 = b2.k1
LEFT JOIN b3 ON o.publisher IS NOT DISTINCT FROM b3.publisher AND o.k = b3.k AND o.k1 = b3.k1 AND o.k2 = b3.k2
LEFT JOIN b4 ON o.publisher IS NOT DISTINCT FROM b4.publisher AND o.k = b4.k AND o.k1 = b4.k1 AND o.k2 = b4.k2 AND o.k3 = b4.k3 GROUP BY o.line_id
"""
P8 = f"""
SELECT DISTINCT item_id, doc_id FROM ({WINDOWS.format(key="item_id", table="benchmark")}) JOIN ({WINDOWS.format(key="doc_id", table="documents")}) USING (s)
"""
P9 = """
WITH p AS (SELECT doc_id, text, unnest(generate_series(1, length(text) - 239)) AS i FROM documents WHERE length(text) >= 240),
h AS (SELECT DISTINCT doc_id, md5(substr(text, i, 240)) AS s FROM p)
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM h a JOIN h b ON a.s = b.s AND a.doc_id < b.doc_id
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_restored, p2_found, p2_pages, p2_blocks, p3_found, p3_repaired, p4_found, p4_figures, p6_found, p6_unified, p7_ids, p7_round_trip, p8_found, p8_report, p9_found, p9_share, p9_components)}
SQL = {
    "p2_found": P2 + "SELECT DISTINCT line_id FROM f",
    "p2_pages": P2 + "SELECT book_id, page_num, count(*) AS lines, string_agg(text, chr(10) ORDER BY top, line_id) AS text FROM l WHERE line_id NOT IN (SELECT line_id FROM f) GROUP BY book_id, page_num",
    "p2_blocks": P2_BLOCKS,
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_found": P8,
    "p9_found": P9,
}
