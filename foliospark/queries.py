"""The queries of the core by name, and the SQL that gives the same rows.

Queries on tables that lack a feature derive it first, by an expression that the SQL repeats; each
says so. Every query runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.config import DEFAULTS
from foliospark.functions import text as X
from foliospark.functions.images import image_info
from foliospark.functions.layout import is_caption, nearest_column
from foliospark.operators import lines as lines_of
from foliospark.operators import pages as pages_of
from foliospark.operators.diff import diff_tables, difference_counts, difference_rows
from foliospark.plans import package, tree
from foliospark.plans.label import classify, label_blocks
from foliospark.session import cut, table
from foliospark.sources.markup import epub_html, epub_pages, html_to_docbook, layout_tables, parse_epub, parse_layout
from foliospark.validation import compile_type, violations

FLAGSHIP = "qa_flags"
MARKERS = DEFAULTS["pdf"]["list_markers"]
QUERIES: dict = {}
SQL: dict[str, str] = {}

#: White space as the normalising functions have it, for SQL.
WS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PAGES = "pages AS (SELECT book_id AS doc_id, page_num, extractor, raw_text, norm_text, checksum, has_ocr, page_uid FROM page_text QUALIFY row_number() OVER (PARTITION BY book_id, page_num ORDER BY page_uid DESC) = 1)"
MIRROR = "mirror AS (SELECT book_id AS doc_id, page_num, norm_text, checksum, page_uid FROM (SELECT * FROM page_mirror QUALIFY row_number() OVER (PARTITION BY page_uid ORDER BY ingested_at DESC) = 1) QUALIFY row_number() OVER (PARTITION BY book_id, page_num ORDER BY page_uid DESC) = 1)"
LINES = "lines AS (SELECT DISTINCT line_id, book_id AS doc_id, page_num, page_height, top, left_pos AS l, height, coalesce(font_size, 0) AS font_size, text, publisher FROM page_line WHERE text IS NOT NULL)"


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words_sql(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{WS}]+'))"


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """The last page of each number in a book."""
    rows = table(spark, d, "page_text").select(F.col("book_id").alias("doc_id"), "page_num", "page_uid", "extractor", "raw_text", "norm_text", "checksum", "has_ocr")
    return pages_of.last_of(rows, ["doc_id", "page_num"], "page_uid")


def _mirror(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page_mirror").select("page_uid", "ingested_at", F.col("book_id").alias("doc_id"), "page_num", "norm_text", "checksum")
    newest = pages_of.last_of(rows, ["page_uid"], "ingested_at")
    return pages_of.last_of(newest.drop("ingested_at"), ["doc_id", "page_num"], "page_uid").withColumn("has_ocr", F.lit(False))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "page_line").where("text IS NOT NULL")
    return rows.select("line_id", F.col("book_id").alias("doc_id"), "page_num", "page_width", "page_height", "top", F.col("left_pos").alias("left"), "height", F.coalesce("font_size", F.lit(0.0)).alias("font_size"), "text", "publisher").distinct()


def _assembled(spark: SparkSession, d: str) -> DataFrame:
    """The stored lines with their stored segments, in the form that labelling takes."""
    rows = _lines(spark, d)
    segments = lines_of.segment_lines(table(spark, d, "text_segment").where("text IS NOT NULL").select("line_id", "seg_ord", "left_pos", "width", "font_size", "text"))
    own = F.array(F.struct(F.col("left"), F.lit(0).alias("ord"), F.lit(0.0).alias("width"), F.col("font_size"), F.col("text")))
    joined = rows.join(segments.select("line_id", "segments"), "line_id", "left")
    return joined.withColumn("segments", F.coalesce("segments", own)).withColumn("page_ord", F.coalesce("page_num", F.lit(0))).withColumn("line_ord", F.col("line_id"))


def _text_lines(spark: SparkSession, d: str) -> DataFrame:
    """documents cut at line ends: (doc_id, page_num, raw_text)."""
    return pages_of.split_pages(table(spark, d, "documents"), "doc_id", "text", "\n")


TEXT_LINES = "tl AS (SELECT doc_id, unnest(generate_series(1, len(p))) AS page_num, unnest(p) AS raw_text FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents WHERE text IS NOT NULL))"

# pages and quality


@query(f"SELECT doc_id, regexp_replace(text, '[{WS}]+', ' ', 'g') AS norm_text FROM documents")
def normalize_collapse(spark: SparkSession, d: str) -> DataFrame:
    """White space of all documents collapsed."""
    return table(spark, d, "documents").select("doc_id", X.collapse(F.col("text")).alias("norm_text"))


@query(f"SELECT doc_id, regexp_replace(text, '[{WS}]+', ' ', 'g') AS norm_text, CASE WHEN text <> regexp_replace(text, '[{WS}]+', ' ', 'g') THEN 1 ELSE 0 END AS events FROM documents WHERE text IS NOT NULL")
def normalize_events(spark: SparkSession, d: str) -> DataFrame:
    """Normalised documents with the number of rules that changed them; after collapsing no line end is left to join."""
    made = table(spark, d, "documents").where("text IS NOT NULL").withColumn("n", X.normalized(F.col("text")))
    return made.select("doc_id", F.col("n.text").alias("norm_text"), F.size("n.events").alias("events"))


#: Letters, digits and underscores around a hyphen at a line's end.
BROKEN = r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)"
CAPITALS = "upper({0}) = {0} AND lower({0}) <> {0}"


@query(
    f"""WITH {PAGES}, s AS (SELECT doc_id, page_num, string_split_regex(raw_text, '{BROKEN}') AS p, regexp_extract_all(raw_text, '{BROKEN}', 1) AS l, regexp_extract_all(raw_text, '{BROKEN}', 2) AS r FROM pages WHERE raw_text IS NOT NULL)
SELECT doc_id, page_num, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || CASE WHEN i > len(l) THEN '' WHEN {CAPITALS.format("l[i]")} AND {CAPITALS.format("r[i]")} THEN l[i] || '-' || r[i] ELSE l[i] || r[i] END), '') AS norm_text FROM s"""
)
def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    """Pages with words joined across line ends, line ends kept."""
    return _pages(spark, d).where("raw_text IS NOT NULL").select("doc_id", "page_num", X.dehyphenate(F.col("raw_text")).alias("norm_text"))


@query(f"WITH {TEXT_LINES} SELECT * FROM tl")
def page_split(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut into numbered pieces; line ends stand for form feeds."""
    return _text_lines(spark, d)


@query("SELECT doc_id, sha256(text) AS checksum FROM documents")
def page_checksum(spark: SparkSession, d: str) -> DataFrame:
    """SHA-256 of each document."""
    return table(spark, d, "documents").select("doc_id", X.checksum(F.col("text")).alias("checksum"))


@query(f"WITH {PAGES} SELECT doc_id, page_num, checksum IS NOT DISTINCT FROM sha256(norm_text) AS checksum_holds FROM pages")
def checksum_audit(spark: SparkSession, d: str) -> DataFrame:
    """Whether stored checksums are those of the stored texts."""
    return _pages(spark, d).select("doc_id", "page_num", F.col("checksum").eqNullSafe(X.checksum(F.col("norm_text"))).alias("checksum_holds"))


@query(f"SELECT doc_id, length(text) AS chars, {words_sql('text')} AS words FROM documents WHERE text IS NOT NULL")
def page_counts(spark: SparkSession, d: str) -> DataFrame:
    """Code points and words of each document."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.length("text").cast("long").alias("chars"), X.word_count(F.col("text")).cast("long").alias("words"))


@query(r"SELECT s AS sign, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[^\x00-\x7F]')) AS s FROM documents) GROUP BY s")
def special_char_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How often each code point beyond 127 stands in the documents."""
    signs = pages_of.special_counts(table(spark, d, "documents").select("doc_id", F.col("text").alias("norm_text")))
    return signs.groupBy("sign").agg(F.sum("n").alias("n"))


@query(f"WITH {PAGES}, {MIRROR} SELECT p.doc_id, p.page_num FROM pages p LEFT JOIN mirror m ON p.doc_id = m.doc_id AND p.page_num = m.page_num WHERE m.norm_text IS NULL OR p.norm_text <> m.norm_text")
def extractor_mismatch(spark: SparkSession, d: str) -> DataFrame:
    """Pages that the second extraction, here the mirror, lacks or has otherwise."""
    return pages_of.mismatched_pages(_pages(spark, d), _mirror(spark, d))


IMAGE_ONLY = f"io AS (SELECT doc_id, page_num FROM pages p WHERE {strip_sql("coalesce(norm_text, '')")} = '' AND NOT EXISTS (SELECT 1 FROM mirror m WHERE m.doc_id = p.doc_id AND m.page_num = p.page_num AND {strip_sql("coalesce(m.norm_text, '')")} <> ''))"


@query(f"WITH {PAGES}, {MIRROR}, {IMAGE_ONLY} SELECT * FROM io")
def image_only_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages blank in both extractions."""
    return pages_of.image_only_pages(_pages(spark, d), _mirror(spark, d))


@query(f"WITH {PAGES}, {MIRROR}, {IMAGE_ONLY} SELECT p.doc_id, p.page_num, io.doc_id IS NOT NULL AS has_ocr FROM pages p LEFT JOIN io ON p.doc_id = io.doc_id AND p.page_num = io.page_num")
def ocr_flags(spark: SparkSession, d: str) -> DataFrame:
    """Each page, marked if it is to be read again."""
    pages = _pages(spark, d)
    return pages_of.with_ocr_flag(pages, pages_of.image_only_pages(pages, _mirror(spark, d))).select("doc_id", "page_num", "has_ocr")


QUALITY = f"""q AS (SELECT p.doc_id, p.page_num, length(coalesce(p.norm_text, '')) AS chars_in, length(coalesce(m.norm_text, '')) AS chars_out,
{words_sql("coalesce(p.norm_text, '')")} AS words_in, {words_sql("coalesce(m.norm_text, '')")} AS words_out, p.checksum AS checksum_in,
CASE WHEN m.doc_id IS NULL THEN '' ELSE m.checksum END AS checksum_out,
list_filter([CASE WHEN m.doc_id IS NULL THEN 'missing_output_page' END,
 CASE WHEN m.doc_id IS NOT NULL AND coalesce(p.norm_text, '') <> coalesce(m.norm_text, '') THEN 'text_mismatch' END,
 CASE WHEN m.doc_id IS NOT NULL AND length(coalesce(p.norm_text, '')) <> length(coalesce(m.norm_text, '')) THEN 'char_count_diff' END], lambda f: f IS NOT NULL) AS flags,
false AS has_ocr FROM pages p LEFT JOIN mirror m ON p.doc_id = m.doc_id AND p.page_num = m.page_num)"""


@query(f"WITH {PAGES}, {MIRROR}, {QUALITY} SELECT * FROM q")
def qa_flags(spark: SparkSession, d: str) -> DataFrame:
    """Quality of each page against its counterpart."""
    return pages_of.page_quality(_pages(spark, d), _mirror(spark, d))


@query(f"WITH {PAGES}, {MIRROR}, {QUALITY} SELECT doc_id, count(*) AS total_pages, count(*) FILTER (WHERE len(flags) > 0) AS flagged_pages, flatten(list(flags ORDER BY page_num NULLS FIRST)) AS flags FROM q GROUP BY doc_id")
def qa_summary(spark: SparkSession, d: str) -> DataFrame:
    """Quality of each book."""
    return pages_of.quality_summary(_pages(spark, d), _mirror(spark, d)).drop("special_chars")


@query(
    f"WITH {PAGES}, {MIRROR}, met AS (SELECT m.doc_id, m.norm_text FROM mirror m SEMI JOIN pages p ON p.doc_id = m.doc_id AND p.page_num = m.page_num), "
    r"s AS (SELECT doc_id, unnest(regexp_extract_all(norm_text, '[^\x00-\x7F]')) AS sign FROM (SELECT doc_id, norm_text FROM pages UNION ALL SELECT doc_id, norm_text FROM met)) SELECT doc_id, sign, count(*) AS n FROM s GROUP BY ALL"
)
def qa_special_chars(spark: SparkSession, d: str) -> DataFrame:
    """The signs of both sides of each book."""
    return pages_of.quality_summary(_pages(spark, d), _mirror(spark, d)).select("doc_id", F.explode("special_chars").alias("sign", "n"))


@query(f"WITH {PAGES}, {MIRROR}, {QUALITY} SELECT 'book-' || doc_id AS file, page_num AS page, chars_in, chars_out, words_in, words_out, checksum_in, checksum_out, array_to_string(flags, ';') AS flags, 'no' AS has_ocr, CASE WHEN len(flags) > 0 THEN 'discrepancy' ELSE 'ok' END AS status FROM q")
def qa_report_rows(spark: SparkSession, d: str) -> DataFrame:
    """The rows of the quality report."""
    return pages_of.report_rows(qa_flags(spark, d), F.concat(F.lit("book-"), F.col("doc_id").cast("string")))


@query(f"WITH {PAGES}, n AS (SELECT DISTINCT doc_id, page_num FROM pages WHERE page_num IS NOT NULL), g AS (SELECT doc_id, page_num, page_num - row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS i FROM n), s AS (SELECT doc_id, min(page_num) AS a, max(page_num) AS b FROM g GROUP BY doc_id, i) SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM s GROUP BY doc_id")
def page_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Page numbers of each book as ranges; ranges with gaps are those of `mismatch_ranges`."""
    return pages_of.page_ranges(_pages(spark, d))


@query(f"WITH {PAGES}, {MIRROR}, n AS (SELECT DISTINCT p.doc_id, p.page_num FROM pages p LEFT JOIN mirror m ON p.doc_id = m.doc_id AND p.page_num = m.page_num WHERE p.page_num IS NOT NULL AND (m.norm_text IS NULL OR p.norm_text <> m.norm_text)), g AS (SELECT doc_id, page_num, page_num - row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS i FROM n), s AS (SELECT doc_id, min(page_num) AS a, max(page_num) AS b FROM g GROUP BY doc_id, i) SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM s GROUP BY doc_id")
def mismatch_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Page numbers that the mirror lacks or has otherwise, of each book as ranges; their gaps are the tables' own."""
    return pages_of.page_ranges(pages_of.mismatched_pages(_pages(spark, d), _mirror(spark, d)))


# lines


@query(
    """WITH s AS (SELECT DISTINCT line_id, left_pos, seg_ord, text FROM text_segment WHERE text IS NOT NULL AND text <> ''), o AS (SELECT *, lag(text) OVER (PARTITION BY line_id ORDER BY left_pos, seg_ord) AS b FROM s)
SELECT line_id, string_agg(CASE WHEN b IS NULL OR b LIKE '% ' OR text LIKE ' %' THEN text ELSE ' ' || text END, '' ORDER BY left_pos, seg_ord) AS text FROM o GROUP BY line_id"""
)
def line_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines' texts put together from their segments."""
    rows = table(spark, d, "text_segment").where("text <> ''").select("line_id", "seg_ord", "left_pos", "width", "font_size", "text")
    return lines_of.segment_lines(rows).select("line_id", "text")


@query("SELECT line_id, max(left_pos + coalesce(width, 0)) AS line_right FROM text_segment WHERE text IS NOT NULL GROUP BY line_id")
def line_right(spark: SparkSession, d: str) -> DataFrame:
    """Where each line ends."""
    rows = table(spark, d, "text_segment").where("text IS NOT NULL").select("line_id", "seg_ord", "left_pos", "width", "font_size", "text")
    return lines_of.segment_lines(rows).select("line_id", F.col("right").alias("line_right"))


@query()
def column_places(spark: SparkSession, d: str) -> DataFrame:
    """Column positions of each line's segments."""
    rows = table(spark, d, "text_segment").where("text IS NOT NULL").select("line_id", "seg_ord", "left_pos", "width", "font_size", "text")
    return lines_of.segment_lines(rows).select("line_id", "columns")


COLUMNS = [54.0, 200.0, 320.5, 480.0]


@query(f"SELECT segment_id, list_position(x, list_min(x)) - 1 AS c FROM (SELECT DISTINCT segment_id, list_transform({COLUMNS}, lambda c: abs(c - left_pos)) AS x FROM text_segment WHERE left_pos IS NOT NULL)")
def nearest_columns(spark: SparkSession, d: str) -> DataFrame:
    """The nearest of four columns for each segment."""
    rows = table(spark, d, "text_segment").where("left_pos IS NOT NULL").select("segment_id", "left_pos").distinct()
    return rows.select("segment_id", nearest_column(F.col("left_pos"), F.array(*map(F.lit, COLUMNS))).alias("c"))


@query(f"WITH {LINES} SELECT line_id, round(lead(top) OVER (PARTITION BY doc_id, page_num ORDER BY top, line_id) - top, 6) AS gap FROM lines")
def line_gaps(spark: SparkSession, d: str) -> DataFrame:
    """How far below the next line of the page is."""
    return lines_of.with_gap(_lines(spark, d), ["doc_id", "page_num"], ["top", "line_id"]).select("line_id", F.round("gap", 6).alias("gap"))


BODY = f"body AS (SELECT doc_id, coalesce(median(CASE WHEN length({strip_sql('text')}) >= 30 AND font_size > 0 THEN font_size END), median(CASE WHEN font_size > 0 THEN font_size END), 12.0) AS body FROM lines GROUP BY doc_id)"


@query(f"WITH {LINES}, {BODY} SELECT * FROM body")
def body_size_median(spark: SparkSession, d: str) -> DataFrame:
    """The body size of each book."""
    return lines_of.body_sizes(_lines(spark, d))


T = strip_sql("text")
FEATURES = f"""f0 AS (SELECT lines.*, body.body, {T} AS t FROM lines JOIN body USING (doc_id)),
f1 AS (SELECT *, {words_sql('t')} AS w, font_size <> 0 AND font_size >= body + 2 AS heading_font FROM f0),
f AS (SELECT *, t = '' OR (length(t) <= 4 AND regexp_matches(t, '^\\p{{Nd}}+$') AND coalesce(page_height, 0) > 0 AND (top < page_height * 0.08 OR top > page_height * 0.9)) OR (length(t) <= 30 AND starts_with(lower(t), 'copyright')) AS skipped,
t <> '' AND page_num <= 2 AND (CASE WHEN coalesce(page_height, 0) <> 0 THEN top <= page_height * 0.45 ELSE top <= 400 END) AND (font_size >= body + 6 OR (font_size >= body + 4 AND w <= 12)) AS title_like,
t <> '' AND heading_font AND (regexp_matches(t, '(?i)\\bchapter\\b') OR regexp_matches(t, '(?i)^(?:chapter|chap\\.|unit|lesson|module)\\b') OR (coalesce(page_height, 0) <> 0 AND top <= page_height * 0.45) OR w <= 10) AS chapter_like,
regexp_matches(t, '(?i)^index\\b') AND heading_font AS index_like, regexp_matches(t, '(?i)^table of contents$') AND heading_font AS contents_like,
t <> '' AND (regexp_matches(t, '(?i)^(?:section|sec\\.|part)\\b') OR (font_size >= body + 1.5 AND w <= 14) OR (w <= 8 AND upper(t) = t AND lower(t) <> t AND font_size >= body)) AS section_like,
regexp_matches(t, '(?i)^(?:figure|fig\\.|table)\\s+\\d+') AS caption_like, regexp_matches(t, '(?i)\\bchapter\\b') AS keyword,
CASE WHEN regexp_matches(t, '^[•—–-]') THEN 'itemized' WHEN regexp_matches(t, '^(?:\\(?\\d+[.)]|[A-Za-z][.)])[ \\t]+') THEN 'ordered' END AS list_type FROM f1)"""
FLAGS = ["skipped", "heading_font", "title_like", "chapter_like", "index_like", "contents_like", "section_like", "caption_like", "keyword"]


def _features(spark: SparkSession, d: str) -> DataFrame:
    return lines_of.line_features(_lines(spark, d), MARKERS)


@query(f"WITH {LINES}, {BODY}, {FEATURES} SELECT line_id, {', '.join(FLAGS)}, list_type FROM f")
def line_predicates(spark: SparkSession, d: str) -> DataFrame:
    """What every line looks like by itself, all predicates."""
    return _features(spark, d).select("line_id", *FLAGS, "list_type")


@query(f"WITH {LINES}, {BODY}, {FEATURES} SELECT line_id FROM f WHERE skipped")
def header_footer_filter(spark: SparkSession, d: str) -> DataFrame:
    """Page numbers in the outer bands and copyright lines."""
    return _features(spark, d).where("skipped").select("line_id")


@query(f"WITH {LINES}, {BODY}, {FEATURES} SELECT line_id FROM f WHERE section_like")
def section_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines that look like section headings."""
    return _features(spark, d).where("section_like").select("line_id")


# documents have headings and captions that page lines lack
CAPTIONS = f"WITH {TEXT_LINES} SELECT doc_id, page_num FROM tl WHERE regexp_matches({strip_sql('raw_text')}, '(?i)^(?:figure|fig\\.|table)\\s+\\d+')"


@query(CAPTIONS)
def caption_filter(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that are captions."""
    return _text_lines(spark, d).where(is_caption(F.col("raw_text"))).select("doc_id", "page_num")


ITEM = r"""CASE WHEN regexp_matches(t, '^[•—–-]') THEN substr(t, 2) WHEN regexp_matches(t, '^(?:\(?\d+[.)]|[A-Za-z][.)])[ \t\r\f]+') THEN regexp_replace(t, '^(?:\(?\d+[.)]|[A-Za-z][.)])[ \t\r\f]+', '') END"""


@query(
    f"WITH {TEXT_LINES}, s AS (SELECT doc_id, page_num, {strip_sql('raw_text')} AS t FROM tl), i AS (SELECT *, {ITEM} AS rest FROM s) "
    f"SELECT doc_id, page_num, CASE WHEN regexp_matches(t, '^[•—–-]') THEN 'itemized' ELSE 'ordered' END AS list_type, coalesce(nullif({strip_sql('rest')}, ''), t) AS item FROM i WHERE rest IS NOT NULL"
)
def list_items(spark: SparkSession, d: str) -> DataFrame:
    """List items among the documents' lines, without marker or number."""
    item = X.list_item(X.strip(F.col("raw_text")), MARKERS)
    return _text_lines(spark, d).withColumn("i", item).where("i.list_type IS NOT NULL").select("doc_id", "page_num", F.col("i.list_type").alias("list_type"), F.col("i.item").alias("item"))


@query(
    f"WITH {LINES}, {BODY}, {FEATURES} SELECT line_id, CASE WHEN skipped THEN 'skipped' WHEN index_like THEN 'index' WHEN contents_like THEN 'toc' WHEN title_like THEN 'book_title' WHEN chapter_like THEN 'chapter' "
    "WHEN section_like THEN 'section' WHEN caption_like THEN 'caption' WHEN list_type IS NOT NULL THEN 'list_item' ELSE 'para' END AS label FROM f"
)
def label_precedence(spark: SparkSession, d: str) -> DataFrame:
    """The label of each line by itself."""
    df = _features(spark, d)
    return df.select("line_id", lines_of.single_labels(df).alias("label"))


@query(
    f"""WITH {LINES}, b AS (SELECT *, lag(page_num) OVER w AS p0, lag(top) OVER w AS t0, lag(l) OVER w AS l0, lag(height) OVER w AS h0 FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY page_num, top, line_id)),
c AS (SELECT *, CASE WHEN page_num = p0 AND top - t0 <= greatest(height, h0) * 1.9 + 2 AND NOT (abs(l0 - l) > 60 AND top - t0 > least(height, h0) * 1.1) AND l - l0 >= -80 THEN 0 ELSE 1 END AS brk FROM b),
n AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY page_num, top, line_id ROWS UNBOUNDED PRECEDING) AS para FROM c)
SELECT doc_id, para::BIGINT AS para, any_value(page_num) AS page_num, count(*) AS lines, string_agg({T}, chr(10) ORDER BY page_num, top, line_id) AS text FROM n GROUP BY doc_id, para"""
)
def paragraph_merge(spark: SparkSession, d: str) -> DataFrame:
    """Lines in paragraphs by gap and indent."""
    return lines_of.paragraphs(_lines(spark, d), ["page_num", "top", "line_id"]).select("doc_id", "para", "page_num", "lines", "text")


@query(
    f"""WITH {TEXT_LINES}, k AS (SELECT doc_id, page_num, CASE WHEN regexp_matches(raw_text, '^[•—–-]') THEN 'itemized' WHEN regexp_matches(raw_text, '^(?:\\(?\\d+[.)]|[A-Za-z][.)])[ \\t\\r\\f]+') THEN 'ordered' END AS kind FROM tl),
b AS (SELECT *, CASE WHEN row_number() OVER w > 1 AND lag(kind) OVER w IS NOT DISTINCT FROM kind THEN 0 ELSE 1 END AS brk FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)),
n AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT doc_id, island::BIGINT AS island, kind, count(*) AS items FROM n WHERE kind IS NOT NULL GROUP BY ALL"""
)
def list_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of list items of one kind."""
    rows = _text_lines(spark, d).select("doc_id", "page_num", X.list_item(F.col("raw_text"), MARKERS)["list_type"].alias("kind"))
    runs = lines_of.islands(rows, ["doc_id"], ["page_num"], F.col("kind"))
    return runs.where("kind IS NOT NULL").groupBy("doc_id", "island", "kind").agg(F.count("*").alias("items"))


MADE_LABEL = "CASE WHEN page_num % 31 = 0 THEN 'index' WHEN page_num % 11 = 1 THEN 'chapter' WHEN page_num % 4 = 2 THEN 'section' ELSE 'para' END"


@query(
    f"""WITH {TEXT_LINES}, k AS (SELECT doc_id, page_num, {MADE_LABEL} AS label, row_number() OVER (PARTITION BY doc_id ORDER BY page_num) AS r FROM tl),
m AS (SELECT *, coalesce(max(CASE WHEN label = 'chapter' THEN r END) OVER w, 0) AS c, coalesce(max(CASE WHEN label = 'section' THEN r END) OVER w, 0) AS s, coalesce(max(CASE WHEN label = 'index' THEN r END) OVER w, 0) AS i FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY page_num ROWS UNBOUNDED PRECEDING))
SELECT doc_id, page_num, CASE WHEN i > c THEN 'index' || i WHEN s > greatest(c, i) THEN 'section' || s WHEN c > i THEN 'chapter' || c ELSE 'root' END AS container FROM m"""
)
def container_resolution(spark: SparkSession, d: str) -> DataFrame:
    """What each line is in, of headings made by line number, as the lines have few."""
    return lines_of.containers(_text_lines(spark, d), ["doc_id"], ["page_num"], F.expr(MADE_LABEL)).select("doc_id", "page_num", "container")


# blocks and trees


#: Of ten lines one is a chapter, a section, an item and a caption each; thirty lines make a page, a gap of 20 joins them.
MADE_KIND = "CASE page_num % 10 WHEN 0 THEN 'chapter' WHEN 3 THEN 'section' WHEN 5 THEN 'list_item' WHEN 6 THEN 'caption' ELSE 'para' END"
MADE_TEXT = "CASE page_num % 10 WHEN 0 THEN 'Chapter ' || page_num WHEN 3 THEN 'Section ' || page_num WHEN 5 THEN '• item ' || page_num WHEN 6 THEN 'Figure ' || page_num || ' shows it' ELSE 'this is a line of the body and its number is ' || page_num END"
MADE_BLOCKS = f"""ml AS (SELECT doc_id, page_num AS n, 1 + page_num // 30 AS p, 100 + page_num % 30 * 20.0 AS top, {MADE_KIND} AS label, {MADE_TEXT} AS t FROM tl),
mk AS (SELECT *, CASE WHEN label = 'para' AND lag(label) OVER w = 'para' AND lag(p) OVER w = p THEN 0 ELSE 1 END AS brk FROM ml WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
mb AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS b FROM mk),
blocks AS (SELECT doc_id, (b - 1)::INT AS block_ord, min(label) AS label, string_agg(CASE WHEN label = 'list_item' THEN substr(t, 3) ELSE t END, chr(10) ORDER BY n) AS text, min(p)::INT AS page_num, min(top) AS top, max(top) + 10 - min(top) AS height FROM mb GROUP BY doc_id, b)"""


def _made_blocks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("page_num")
    lines = _text_lines(spark, d).select(
        "doc_id", F.floor(n / 30).cast("int").alias("page_ord"), (F.floor(n / 30) + 1).cast("int").alias("number"), F.lit(600.0).alias("page_width"), F.lit(900.0).alias("page_height"), n.cast("long").alias("line_ord"),
        (100 + n % 30 * 20.0).alias("top"), F.lit(50.0).alias("left"), F.lit(10.0).alias("height"), F.when(n % 10 == 0, 13.0).otherwise(10.0).alias("font_size"), F.expr(MADE_TEXT).alias("text"),
    )
    lines = lines.withColumnRenamed("number", "page_num").withColumn("segments", F.array(F.struct(F.col("left"), F.lit(0).alias("ord"), F.lit(200.0).alias("width"), F.col("font_size"), F.col("text"))))
    return label_blocks(lines, None, MARKERS)


@query(f"WITH {TEXT_LINES}, {MADE_BLOCKS} SELECT * FROM blocks")
def label_made(spark: SparkSession, d: str) -> DataFrame:
    """Labelled blocks of lines made by number: chapters by word and size, sections, items, captions, merged paragraphs."""
    return _made_blocks(spark, d).select("doc_id", "block_ord", "label", "text", "page_num", "top", "height")


@query(
    f"""WITH {TEXT_LINES}, {MADE_BLOCKS}, e AS (SELECT doc_id, unnest(CASE label WHEN 'chapter' THEN ['chapter', 'title'] WHEN 'section' THEN ['sect1', 'title'] WHEN 'list_item' THEN ['itemizedlist', 'listitem', 'para'] ELSE ['para'] END) AS tag, text FROM blocks
UNION ALL SELECT DISTINCT doc_id, 'book', NULL FROM tl)
SELECT doc_id, tag, count(*) AS n, string_agg(CASE WHEN tag IN ('para', 'title') THEN text END, '|' ORDER BY text) AS texts FROM e GROUP BY doc_id, tag"""
)
def tree_made(spark: SparkSession, d: str) -> DataFrame:
    """The elements of the trees of those blocks; captions without a figure are paragraphs, each item a list of its own."""
    nodes = tree.build_tree(_made_blocks(spark, d))
    text = F.when(F.col("tag").isin("para", "title"), F.col("text"))
    return nodes.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.nullif(F.array_join(F.array_sort(F.collect_list(text)), "|"), F.lit("")).alias("texts"))


@query()
def label_documents(spark: SparkSession, d: str) -> DataFrame:
    """Books as labelled blocks."""
    return label_blocks(_assembled(spark, d), None, MARKERS)


@query(
    f"""WITH {TEXT_LINES}, n AS (SELECT doc_id, page_num AS n, page_num // 6 AS run FROM tl WHERE page_num % 6 > 0)
SELECT doc_id, count(*) AS n_rows, 3 AS n_columns, min(n) * 20.0 AS top, string_agg('a' || n || ' | b' || n || ' | c', chr(10) ORDER BY n) AS text FROM n GROUP BY doc_id, run HAVING count(*) >= 2"""
)
def table_made(spark: SparkSession, d: str) -> DataFrame:
    """Tables among lines made by number: five rows of three columns, each a little aside of the last, then a line of text."""
    n = F.col("page_num")
    cell = lambda left, text, k: F.struct(F.lit(left) + n % 3, F.lit(k), F.lit(40.0), F.lit(10.0), text).cast(lines_of.SEGMENT)
    row = F.array(cell(250.0, F.lit("c"), 2), cell(50.0, F.concat(F.lit("a"), n.cast("string")), 0), cell(150.0, F.concat(F.lit("b"), n.cast("string")), 1))
    lines = _text_lines(spark, d).withColumn("segments", F.when(n % 6 == 0, F.array(cell(50.0, F.lit("a line of text between the tables"), 0))).otherwise(row))
    lines = lines.select("doc_id", F.lit(0).alias("page_ord"), n.cast("long").alias("line_ord"), F.lit(3).alias("number"), F.lit(600.0).alias("page_width"), F.lit(90000.0).alias("page_height"), (n * 20.0).alias("top"), F.lit(50.0).alias("left"), F.lit(12.0).alias("height"), F.lit(10.0).alias("font_size"), X.clean_join(F.col("segments")).alias("text"), "segments").withColumnRenamed("number", "page_num")
    return label_blocks(lines, None, MARKERS).where("label = 'table'").select("doc_id", F.size("rows").cast("long").alias("n_rows"), F.size(F.col("rows")[0]).alias("n_columns"), "top", "text")


@query()
def table_detect(spark: SparkSession, d: str) -> DataFrame:
    """Tables found among the books' lines."""
    return label_documents(spark, d).where("label = 'table'").select("doc_id", "block_ord", "page_num", F.size("rows").alias("n_rows"), F.size(F.col("rows")[0]).alias("n_columns"), "text")


@query(f"WITH {TEXT_LINES}, {MADE_BLOCKS} SELECT doc_id, block_ord, label, CASE WHEN length(text) >= 20 THEN 'long' ELSE 'unsure' END AS classifier_label, least(length(text) / 20.0::DOUBLE, 1.0) AS classifier_confidence FROM blocks")
def classify_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of made lines with the label of a classifier that is surer the longer a text is; it abstains below certainty."""
    judge = lambda label, text: F.struct(F.lit("long").alias("label"), F.least(F.length(text) / 20.0, F.lit(1.0)).alias("confidence"))
    return classify(_made_blocks(spark, d), judge, 1.0, "unsure").select("doc_id", "block_ord", "label", "classifier_label", "classifier_confidence")


@query()
def docbook_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Books as trees."""
    return tree.with_info(cut(tree.build_tree(label_documents(spark, d))))


@query()
def book_fragments(spark: SparkSession, d: str) -> DataFrame:
    """The parts that books are split into."""
    return tree.fragments(docbook_nodes(spark, d))


def _layout_files(spark: SparkSession, d: str) -> DataFrame:
    """Layout XML of each book, written from its lines: one fontspec per size, entities escaped."""
    esc = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    size = F.col("font_size").cast("string")
    node = F.format_string('<text top="%s" left="%s" width="10" height="%s" font="f%s">%s</text>', F.col("top").cast("string"), F.col("left").cast("string"), F.col("height").cast("string"), size, esc(F.col("text")))
    rows = _lines(spark, d).where("page_num IS NOT NULL")
    pages = rows.groupBy("doc_id", "page_num").agg(F.first("page_width").alias("w"), F.first("page_height").alias("h"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_id", node.alias("x")))), lambda s: s["x"]), "").alias("t"), F.array_join(F.array_sort(F.collect_set(F.format_string('<fontspec id="f%s" size="%s" family="Plain"/>', size, size))), "").alias("f"))
    page = F.format_string('<page number="%d" width="%s" height="%s">%s%s</page>', "page_num", F.col("w").cast("string"), F.col("h").cast("string"), "f", "t")
    return pages.groupBy("doc_id").agg(F.concat(F.lit("<pdf2xml>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", page.alias("x")))), lambda s: s["x"]), ""), F.lit("</pdf2xml>")).alias("content"))


@query(f"WITH {LINES} SELECT doc_id, page_num, count(*) AS nodes, count(DISTINCT font_size) AS sizes FROM lines WHERE page_num IS NOT NULL GROUP BY ALL")
def layout_parse(spark: SparkSession, d: str) -> DataFrame:
    """Layout files, written from the lines, read again: text nodes and sizes by page."""
    fonts, texts, _ = layout_tables(parse_layout(_layout_files(spark, d)))
    sized = lines_of.with_font_size(texts, fonts)
    return sized.groupBy("doc_id", "page_num").agg(F.count("*").alias("nodes"), F.countDistinct("font_size").alias("sizes"))


@query()
def line_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Lines put together from the text nodes of layout files."""
    fonts, texts, _ = layout_tables(parse_layout(_layout_files(spark, d)))
    return lines_of.assemble_lines(lines_of.with_font_size(texts, fonts)).select("doc_id", "page_num", "line_ord", "top", "left", "font_size", F.size("segments").alias("segments"), "text")


@query("WITH s AS (SELECT DISTINCT segment_id, publisher, segment_id % 7 AS font_id, font_size FROM text_segment), f AS (SELECT publisher, k AS font_id, 8 + k + (CASE WHEN k % 2 = 0 THEN 0 ELSE 0.5 END) AS size FROM publisher, (SELECT unnest(range(5)) AS k)) SELECT segment_id, coalesce(CASE WHEN f.font_id IS NOT NULL THEN f.size::DOUBLE ELSE s.font_size END, 0) AS font_size FROM s LEFT JOIN f ON s.publisher = f.publisher AND s.font_id = f.font_id")
def font_join(spark: SparkSession, d: str) -> DataFrame:
    """Sizes from font tables made per publisher, with an older state of each entry; fonts without one keep the node's size."""
    nodes = table(spark, d, "text_segment").select("segment_id", F.col("publisher").alias("doc_id"), (F.col("segment_id") % 7).alias("font_id"), F.col("font_size").alias("size")).distinct()
    made = table(spark, d, "publisher").select(F.col("publisher").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"))
    specs = made.select("doc_id", F.col("k").cast("long").alias("font_id"), (8 + F.col("k") + F.when(F.col("k") % 2 == 0, 0.0).otherwise(0.5)).cast("string").alias("size"), F.lit(2).alias("ord"))
    return lines_of.with_font_size(nodes, specs.unionByName(specs.withColumn("size", F.lit("99")).withColumn("ord", F.lit(1)))).select("segment_id", "font_size")


@query(f"WITH {TEXT_LINES}, n AS (SELECT doc_id, page_num, max(page_num) OVER (PARTITION BY doc_id) AS last FROM tl) SELECT doc_id, 'f' || page_num || '.png' AS ref, 'line ' || (page_num + CASE WHEN page_num < last THEN 1 ELSE -1 END) AS caption FROM n WHERE page_num % 5 = 0")
def caption_attach(spark: SparkSession, d: str) -> DataFrame:
    """Figures and their captions in trees built of blocks made by line number.

    Every fifth line is a figure with a caption before and one after it: the later one counts."""
    n = F.col("page_num")
    rows = _text_lines(spark, d).withColumn("label", F.when(n % 5 == 0, "figure").when((n % 5).isin(1, 4), "caption").otherwise("para"))
    made = rows.select("doc_id", n.cast("int").alias("block_ord"), "label", F.concat(F.lit("line "), n.cast("string")).alias("text"), F.lit(0.0).alias("left"), F.lit(None).cast("array<array<string>>").alias("rows"), F.when(F.col("label") == "figure", F.concat(F.lit("f"), n.cast("string"), F.lit(".png"))).alias("src"), F.lit(None).cast("string").alias("list_type"), F.lit(None).cast("string").alias("chapter_role"))
    return package.image_nodes(cut(tree.build_tree(made))).select("doc_id", "ref", "caption")


INDEX_TEXT = r"regexp_replace(regexp_replace(regexp_replace(raw_text, '\.{2,}', ' ', 'g'), '[WS]+', ' ', 'g'), '^ | $', '', 'g')".replace("WS", WS)


@query(
    rf"""WITH {TEXT_LINES}, c AS (SELECT doc_id, page_num, {INDEX_TEXT} AS t FROM tl),
r AS (SELECT *, regexp_matches(t, '(?is),\s*(see(?:\s+also)?)\s+(.*)$') AS has_ref FROM c),
b AS (SELECT *, CASE WHEN has_ref THEN regexp_replace(regexp_replace(t, '(?is),\s*(see(?:\s+also)?)\s+(.*)$', ''), '[, ]+$', '') ELSE t END AS before FROM r),
p AS (SELECT *, regexp_matches(before, '([0-9][0-9A-Za-z\s,–-]*)$') AS has_pages FROM b)
SELECT doc_id, page_num, regexp_replace(CASE WHEN has_pages THEN regexp_replace(regexp_replace(before, '([0-9][0-9A-Za-z\s,–-]*)$', ''), '[,;: ]+$', '') ELSE before END, '^[, ]+|[, ]+$', '', 'g') AS entry,
CASE WHEN has_pages THEN trim(regexp_extract(before, '([0-9][0-9A-Za-z\s,–-]*)$', 1)) END AS pages,
CASE WHEN has_ref THEN trim(regexp_extract(t, '(?is),\s*(see(?:\s+also)?)\s+(.*)$', 1) || ' ' || trim(regexp_extract(t, '(?is),\s*(see(?:\s+also)?)\s+(.*)$', 2))) END AS reference FROM p"""
)
def index_entries(spark: SparkSession, d: str) -> DataFrame:
    """The documents' lines taken as index lines: entry, pages, reference."""
    part = X.index_parts(X.index_text(F.col("raw_text")))
    return _text_lines(spark, d).select("doc_id", "page_num", part["entry"].alias("entry"), part["pages"].alias("pages"), part["reference"].alias("reference"))


MADE_NODES = "CASE WHEN page_num = 1 THEN 'toc' WHEN page_num % 9 = 8 THEN 'index' WHEN page_num % 3 = 0 THEN 'chapter' ELSE 'para' END"
MADE_TITLE = "CASE WHEN page_num % 6 = 0 THEN 'Appendix ' || chr((65 + page_num % 5)::INT) WHEN page_num % 2 = 0 THEN '' ELSE 'Part ' || page_num END"


def _made_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A tree per document of its lines: node kinds and titles go by line number, as sections are apart already."""
    rows = _text_lines(spark, d).withColumn("kind", F.expr(MADE_NODES)).withColumn("title", F.expr(MADE_TITLE.replace("::INT", "")))
    attrs = F.when(F.col("kind") == "toc", F.create_map(F.lit("role"), F.lit("toc"))).otherwise(F.create_map().cast("map<string,string>"))
    tag = F.when(F.col("kind") == "toc", "chapter").when((F.col("kind") == "chapter") & (F.col("page_num") % 6 == 0), "appendix").otherwise(F.col("kind"))
    me = (F.col("page_num") * 2).cast("int")
    body = rows.select("doc_id", me.alias("node_id"), F.lit(0).alias("parent_id"), F.col("page_num").cast("int").alias("ord"), tag.alias("tag"), F.when(F.col("kind") == "para", F.col("raw_text")).alias("text"), attrs.alias("attrs"), F.array(F.lit(0), me).alias("path"))
    titled = rows.where("kind <> 'para' AND title <> ''").select("doc_id", (me + 1).alias("node_id"), me.alias("parent_id"), F.lit(0).alias("ord"), F.lit("title").alias("tag"), F.col("title").alias("text"), F.create_map().cast("map<string,string>").alias("attrs"), F.array(F.lit(0), me, me + 1).alias("path"))
    roots = rows.select("doc_id").distinct().select("doc_id", F.lit(0).alias("node_id"), F.lit(None).cast("int").alias("parent_id"), F.lit(0).alias("ord"), F.lit("book").alias("tag"), F.lit(None).cast("string").alias("text"), F.create_map().cast("map<string,string>").alias("attrs"), F.array(F.lit(0)).alias("path"))
    return roots.unionByName(body).unionByName(titled)


FRAGMENTS = f"""k AS (SELECT doc_id, page_num, {MADE_NODES} AS kind0, {MADE_TITLE} AS t FROM tl), c AS (SELECT * FROM k WHERE kind0 <> 'para'),
n AS (SELECT *, row_number() OVER w AS frag_ord, sum(CASE WHEN kind0 = 'chapter' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY page_num ROWS UNBOUNDED PRECEDING) AS num FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY page_num)),
fr AS (SELECT doc_id, frag_ord, CASE kind0 WHEN 'toc' THEN 'toc' WHEN 'index' THEN 'Index' ELSE 'Ch' || lpad(num::BIGINT::VARCHAR, 3, '0') END AS entity,
CASE kind0 WHEN 'toc' THEN 'TableOfContents.xml' WHEN 'index' THEN 'Index.xml' ELSE 'Ch' || lpad(num::BIGINT::VARCHAR, 3, '0') || '.xml' END AS filename, CASE kind0 WHEN 'toc' THEN 'toc' ELSE 'chapter' END AS kind,
CASE kind0 WHEN 'chapter' THEN t WHEN 'toc' THEN coalesce(nullif(t, ''), 'Table of Contents') ELSE coalesce(nullif(t, ''), 'Index') END AS title,
CASE WHEN kind0 = 'chapter' AND page_num % 6 = 0 THEN 'appendix' ELSE kind0 END AS section_type, num FROM n)"""


@query(f"WITH {TEXT_LINES}, {FRAGMENTS} SELECT doc_id, frag_ord, entity, filename, kind, title, section_type FROM fr")
def chapter_numbering(spark: SparkSession, d: str) -> DataFrame:
    """The parts of made trees, numbered; the first line of each is a table of contents."""
    return tree.fragments(_made_nodes(spark, d)).drop("node_id")


@query(f"WITH {TEXT_LINES}, {FRAGMENTS} SELECT doc_id, frag_ord, CASE WHEN entity = 'toc' THEN 'TOC' WHEN entity = 'Index' THEN 'Index' WHEN section_type = 'appendix' THEN 'Appendix' || right(title, 1) ELSE 'Ch' || lpad(num::BIGINT::VARCHAR, 4, '0') END AS code, CASE WHEN entity = 'toc' THEN 'TOC' WHEN entity = 'Index' THEN 'Index' WHEN section_type = 'appendix' THEN 'Appendix ' || right(title, 1) ELSE num::BIGINT::VARCHAR END AS label FROM fr")
def chapter_code(spark: SparkSession, d: str) -> DataFrame:
    """Codes and labels of those parts."""
    code = tree.chapter_code(F.col("entity"), F.col("section_type"), F.col("title"))
    return tree.fragments(_made_nodes(spark, d)).select("doc_id", "frag_ord", code["code"].alias("code"), code["label"].alias("label"))


@query(f"WITH {TEXT_LINES}, {FRAGMENTS} SELECT doc_id, list(coalesce(nullif(title, ''), filename) || ' (' || filename || ')' ORDER BY frag_ord) AS entries FROM fr WHERE kind = 'chapter' GROUP BY doc_id")
def toc_listing(spark: SparkSession, d: str) -> DataFrame:
    """Tables of contents of those trees."""
    return tree.contents(tree.fragments(_made_nodes(spark, d)))


@query(f"WITH {TEXT_LINES} SELECT doc_id, count(*) FILTER (WHERE {MADE_NODES} <> 'para') AS titled, count(*) AS children FROM tl GROUP BY doc_id")
def tree_info(spark: SparkSession, d: str) -> DataFrame:
    """Children of made trees after each was given its info element, which is not counted."""
    nodes = tree.with_info(_made_nodes(spark, d))
    kids = nodes.where("parent_id = 0 AND tag <> 'bookinfo'")
    return kids.groupBy("doc_id").agg(F.count_if(F.col("tag") != "para").alias("titled"), F.count("*").alias("children"))


@query("SELECT doc_id, section_type AS label, CASE section_type WHEN 'title' THEN 'title' WHEN 'caption' THEN 'caption' ELSE 'para' END AS tag, CASE WHEN section_type = 'section' THEN 'section' END AS role, text FROM documents")
def block_elements(spark: SparkSession, d: str) -> DataFrame:
    """The plain mapping of blocks to elements, documents' section types as labels."""
    rows = table(spark, d, "documents").select("doc_id", F.lit(0).alias("block_ord"), F.col("section_type").alias("label"), "text")
    return tree.block_elements(rows).join(rows.select("doc_id", "label"), "doc_id").select("doc_id", "label", "tag", "role", "text")


# images


def _made_images(spark: SparkSession, d: str) -> DataFrame:
    """Images made from parts: each brand a document, two parts, figures of up to three images, every seventh image unsaved."""
    return table(spark, d, "part").select(
        F.substring("p_brand", 7, 2).cast("long").alias("doc_id"), (F.col("p_partkey") % 2).alias("part"), F.col("p_partkey").alias("node_id"),
        F.when(F.col("p_partkey") % 5 != 0, F.floor(F.col("p_partkey") / 7) * 7).alias("figure"), (F.col("p_partkey") % 7 != 3).alias("saved"),
    )


MADE_IMAGES = "im AS (SELECT substr(p_brand, 7, 2)::BIGINT AS doc_id, p_partkey % 2 AS part, p_partkey AS node_id, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey // 7) * 7 END AS figure, p_partkey % 7 <> 3 AS saved FROM part)"


@query(
    f"""WITH {MADE_IMAGES}, a AS (SELECT *, bool_or(saved) OVER (PARTITION BY doc_id, part, figure) AS any_saved, count(*) OVER (PARTITION BY doc_id, part, figure) AS size, row_number() OVER (PARTITION BY doc_id, part, figure ORDER BY node_id) AS place FROM im),
n AS (SELECT *, sum(CASE WHEN figure IS NOT NULL THEN (any_saved AND place = 1)::INT ELSE saved::INT END) OVER (PARTITION BY doc_id, part ORDER BY (figure IS NULL)::INT, coalesce(figure, node_id), node_id ROWS UNBOUNDED PRECEDING) AS number FROM a)
SELECT doc_id, part, node_id, number::BIGINT AS number, CASE WHEN figure IS NULL OR size = 1 THEN '' ELSE chr((96 + place)::INT) END AS letter FROM n WHERE saved"""
)
def figure_numbering(spark: SparkSession, d: str) -> DataFrame:
    """Numbers and letters of saved images, of figures made from parts."""
    return package.number_figures(_made_images(spark, d)).select("doc_id", "part", "node_id", "number", "letter")


IMAGE_NAME = "lower(replace(p_type, ' ', '_')) || '_' || (p_partkey % 11) || CASE p_partkey % 6 WHEN 0 THEN '_logo' WHEN 1 THEN '_texture' WHEN 2 THEN '_tm' ELSE '' END || '.png'"


@query(
    f"WITH n AS (SELECT p_partkey, {IMAGE_NAME} AS name, p_partkey % 4 = 0 AS fig, p_partkey % 9 = 1 AS info, CASE p_partkey % 10 WHEN 3 THEN 'Background' WHEN 4 THEN 'decorative' END AS role FROM part) "
    "SELECT p_partkey, CASE WHEN fig THEN 'content' WHEN info THEN 'decorative' WHEN regexp_matches(name, 'logo|watermark|copyright|trademark|tm|brand') THEN 'decorative' WHEN regexp_matches(name, 'background|texture|gradient|border|pattern') THEN 'background' WHEN lower(role) IN ('decorative', 'background') THEN lower(role) ELSE 'content' END AS class FROM n"
)
def image_classify(spark: SparkSession, d: str) -> DataFrame:
    """Classes of images whose names, places and roles are made from parts."""
    rows = table(spark, d, "part")
    role = F.when(F.col("p_partkey") % 10 == 3, "Background").when(F.col("p_partkey") % 10 == 4, "decorative")
    return rows.select("p_partkey", package.image_class(F.concat(F.lit("a/b/"), F.expr(IMAGE_NAME)), F.col("p_partkey") % 4 == 0, F.col("p_partkey") % 9 == 1, role).alias("class"))


@query(f"WITH n AS (SELECT substr(p_brand, 7, 2)::BIGINT AS doc_id, p_partkey, {IMAGE_NAME} AS name FROM part) SELECT doc_id, p_partkey, row_number() OVER (PARTITION BY doc_id, name ORDER BY p_partkey) = 1 AS first FROM n")
def shared_media_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Of images with one file name in a document, which is stored."""
    rows = table(spark, d, "part").select(F.substring("p_brand", 7, 2).cast("long").alias("doc_id"), "p_partkey", F.concat(F.lit("x/"), (F.col("p_partkey") % 3).cast("string"), F.lit("/"), F.expr(IMAGE_NAME)).alias("ref"))
    return package.first_of_name(rows.select("doc_id", "ref", "p_partkey"), ["p_partkey"]).select("doc_id", "p_partkey", "first")


@query("SELECT p_partkey, p_size > 0 AND p_retailprice::INT % 200 > 0 AND (p_size * 4 < 72 OR p_retailprice::INT % 200 < 72) AS low, p_partkey % 3 = 0 OR regexp_matches(p_name, '(?i)figure\\s+\\d') AS referenced FROM part")
def image_flags(spark: SparkSession, d: str) -> DataFrame:
    """Low resolution and references, of sizes and ids made from parts."""
    rows = table(spark, d, "part")
    return rows.select("p_partkey", package.is_low_resolution(F.col("p_size") * 4, F.round("p_retailprice").cast("int") % 200).alias("low"), package.is_referenced(F.when(F.col("p_partkey") % 3 == 0, "f"), F.col("p_name")).alias("referenced"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN p_size ELSE 0 END AS width, CASE WHEN p_partkey % 3 < 2 THEN p_size * 3 ELSE 0 END AS height, CASE p_partkey % 3 WHEN 0 THEN 'PNG' WHEN 1 THEN 'GIF' ELSE 'TIF' END AS format FROM part")
def image_inspect(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of image headers made from parts: PNG, GIF and neither."""
    w, h = F.lpad(F.hex(F.col("p_size")), 8, "0"), F.lpad(F.hex(F.col("p_size") * 3), 8, "0")
    little = lambda c: F.concat(F.substring(c, 7, 2), F.substring(c, 5, 2))
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), w, h))
    gif = F.unhex(F.concat(F.lit("474946383961"), little(w), little(h)))
    data = F.when(F.col("p_partkey") % 3 == 0, png).when(F.col("p_partkey") % 3 == 1, gif).otherwise(F.encode("p_name", "UTF-8"))
    return table(spark, d, "part").select("p_partkey", image_info(data, F.lit(".tif")).alias("i")).select("p_partkey", "i.width", "i.height", "i.format")


@query(
    f"""WITH {TEXT_LINES}, {FRAGMENTS}, f2 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, filename ORDER BY frag_ord) AS r FROM fr)
SELECT doc_id, doc_id::VARCHAR AS name, ['Book.xml'] || list(CASE WHEN r = 1 THEN filename ELSE replace(filename, '.xml', '_' || r || '.xml') END ORDER BY frag_ord) || ['media/', 'media/Book_Images/', 'media/Book_Images/Chapters/', 'media/Book_Images/Shared/', 'media/Book_Images/Metadata/', 'media/Book_Images/Metadata/image_catalog.xml', 'media/Book_Images/Metadata/image_manifest.csv'] AS files FROM f2 GROUP BY doc_id"""
)
def bundle_listing(spark: SparkSession, d: str) -> DataFrame:
    """The files in the bundle of each made tree."""
    nodes = cut(_made_nodes(spark, d))
    media = spark.createDataFrame([], "doc_id long, ref string, content binary")
    return package.bundles(nodes, media, "book.dtd").select("doc_id", "name", "files")


# strings, files and keys


@query("SELECT doc_id, CASE WHEN n < 1024 THEN n || 'B' WHEN n < 1048576 THEN printf('%.1fKB', n / 1024.0::DOUBLE) ELSE printf('%.1fMB', n / 1048576.0::DOUBLE) END AS size FROM (SELECT doc_id, octet_length(encode(text)) * (1 + doc_id % 3 * 700) AS n FROM documents WHERE text IS NOT NULL)")
def file_size_format(spark: SparkSession, d: str) -> DataFrame:
    """Sizes for reading; of documents' bytes, some multiplied to reach all units."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.file_size(F.octet_length("text").cast("long") * (1 + F.col("doc_id") % 3 * 700)).alias("size"))


@query("SELECT book_id, nullif(regexp_replace(isbn, '[^0-9A-Za-z]', '', 'g'), '') AS isbn FROM book")
def isbn_clean(spark: SparkSession, d: str) -> DataFrame:
    """ISBNs of letters and digits."""
    return table(spark, d, "book").select("book_id", X.isbn(F.col("isbn")).alias("isbn"))


@query("SELECT book_id, coalesce(nullif(regexp_replace(title, '[^0-9A-Za-z_-]', '', 'g'), ''), 'book') AS base FROM book")
def basename_sanitise(spark: SparkSession, d: str) -> DataFrame:
    """File names made of titles."""
    return table(spark, d, "book").select("book_id", X.basename(F.col("title")).alias("base"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS text FROM documents")
def xml_space(spark: SparkSession, d: str) -> DataFrame:
    """XML's white space normalised."""
    return table(spark, d, "documents").select("doc_id", X.xml_space(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(CASE WHEN doc_id % 2 = 0 THEN '{urn:x}' || section_type ELSE section_type END, '^\\{[^}]*\\}', '') AS tag FROM documents")
def local_names(spark: SparkSession, d: str) -> DataFrame:
    """Tags without the namespace that every second one is given."""
    tag = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("{urn:x}"), "section_type")).otherwise(F.col("section_type"))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("section_type").isNotNull(), X.local_name(tag)).alias("tag"))


def _made_epubs(spark: SparkSession, d: str) -> DataFrame:
    """E-books made of books: 1 to 3 chapters of a heading and a paragraph, manifest ids twice, every fifth spine with an entry that no item has."""
    import io
    import zipfile

    import pandas as pd

    def make(batches):
        for pdf in batches:
            made = []
            for book in pdf["book_id"].tolist():
                out, n = io.BytesIO(), 1 + book % 3
                items = "".join(f'<item id="c{k}" href="old{k}.xhtml"/><item id="c{k}" href="text/c{k}.xhtml"/>' for k in range(n))
                refs = "".join(f'<itemref idref="c{k}"/>' for k in range(n)) + ('<itemref idref="lost"/>' if book % 5 == 0 else "")
                with zipfile.ZipFile(out, "w") as z:
                    z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>')
                    z.writestr("OPS/book.opf", f'<package xmlns="urn:o"><manifest>{items}</manifest><spine>{refs}</spine></package>')
                    for k in range(n):
                        z.writestr(f"OPS/text/c{k}.xhtml", f"<html><body><h1>Part {k}</h1><p>of <b>book</b> {book}</p></body></html>")
                    z.writestr("OPS/cover.png", b"x" * (book % 7 + 1))
                made.append(out.getvalue())
            yield pd.DataFrame({"doc_id": pdf["book_id"], "content": made})

    return parse_epub(table(spark, d, "book").select("book_id").mapInPandas(make, "doc_id long, content binary"))


EPUBS = "ep AS (SELECT book_id AS doc_id, unnest(generate_series(0, book_id % 3)) AS k FROM book)"


@query(f"WITH {EPUBS} SELECT doc_id, k::INT AS pos, 'c' || k AS id, 'text/c' || k || '.xhtml' AS href FROM ep")
def spine_join(spark: SparkSession, d: str) -> DataFrame:
    """Spines resolved against their manifests, in which of items with one id the last counts."""
    return _made_epubs(spark, d).where("kind = 'spine'").select("doc_id", "pos", "id", "href")


@query("SELECT book_id AS doc_id, (1 + book_id % 3)::INT AS pos, 'lost' AS id FROM book WHERE book_id % 5 = 0")
def spine_missing(spark: SparkSession, d: str) -> DataFrame:
    """Spine entries without a manifest item."""
    return _made_epubs(spark, d).where("kind = 'missing'").select("doc_id", "pos", "id")


@query(f"WITH {EPUBS} SELECT doc_id, (2 * k + c + 1)::INT AS page_num, CASE c WHEN 0 THEN 'Part ' || k ELSE 'of  book  ' || doc_id END AS raw_text FROM ep, (SELECT unnest([0, 1]) AS c)")
def epub_text(spark: SparkSession, d: str) -> DataFrame:
    """The text blocks of e-books as pages, numbered in spine order."""
    return epub_pages(_made_epubs(spark, d))


@query("SELECT book_id AS doc_id, 'OPS/cover.png' AS ref, (book_id % 7 + 1)::INT AS size FROM book")
def epub_media(spark: SparkSession, d: str) -> DataFrame:
    """The images in e-books."""
    return _made_epubs(spark, d).where("kind = 'media'").select("doc_id", F.col("href").alias("ref"), F.length("content").alias("size"))


@query(f"WITH {EPUBS}, e AS (SELECT doc_id, unnest(['title', 'para']) AS tag, k FROM ep UNION ALL SELECT DISTINCT doc_id, 'book', NULL FROM ep) SELECT doc_id, tag, count(*) AS n, max(CASE tag WHEN 'title' THEN 'Part ' || k WHEN 'para' THEN 'of book ' || doc_id END) AS most FROM e GROUP BY doc_id, tag")
def epub_nodes(spark: SparkSession, d: str) -> DataFrame:
    """E-books as trees: headings are titles, paragraphs paragraphs."""
    nodes = html_to_docbook(epub_html(_made_epubs(spark, d)), "doc_id", "html")
    return nodes.groupBy("doc_id", "tag").agg(F.count("*").alias("n"), F.max("text").alias("most"))


@query("SELECT book_id, arg_max(norm_text, page_uid) AS last_text FROM (SELECT * FROM page_text WHERE norm_text IS NOT NULL) GROUP BY book_id")
def last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Of rows with one key the last."""
    rows = table(spark, d, "page_text").where("norm_text IS NOT NULL").select("book_id", "page_uid", F.col("norm_text").alias("last_text"))
    return pages_of.last_of(rows, ["book_id"], "page_uid").select("book_id", "last_text")


@query()
def html_nodes(spark: SparkSession, d: str) -> DataFrame:
    """HTML, made of the documents' paragraphs under a heading, as document nodes."""
    esc = F.replace(F.replace(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><body><h1>"), F.coalesce("entity", F.lit("")), F.lit("</h1><p>"), F.replace(esc, F.lit("\n"), F.lit("<p>")), F.lit("</body></html>"))
    return html_to_docbook(table(spark, d, "documents").withColumn("html", html), "doc_id", "html")


#: A small type of our own, to check made trees with.
TYPE = """
<!ENTITY % parts "chapter|appendix|index|para">
<!ELEMENT book (bookinfo?, (%parts;)+)> <!ELEMENT bookinfo (title)> <!ELEMENT title (#PCDATA)> <!ELEMENT para (#PCDATA)>
<!ELEMENT chapter (title, para*)> <!ELEMENT appendix (title, para+)> <!ELEMENT index (title?)> <!ATTLIST chapter role CDATA #IMPLIED id ID #IMPLIED>
"""


@query(
    f"WITH {TEXT_LINES}, k AS (SELECT doc_id, page_num, {MADE_NODES} AS kind, {MADE_TITLE} AS t FROM tl) "
    "SELECT doc_id, page_num * 2 AS node_id, 'appendix' AS tag, 'content_model' AS rule, 'title' AS detail FROM k WHERE kind = 'chapter' AND page_num % 6 = 0"
)
def dtd_validate(spark: SparkSession, d: str) -> DataFrame:
    """What made trees have that a small type does not allow: appendixes without text."""
    return violations(_made_nodes(spark, d), compile_type(TYPE))


# two copies of a table

MIRRORED = ["page_num", "norm_text", "checksum"]
P5 = """
WITH a AS (SELECT * FROM page_text QUALIFY row_number() OVER (PARTITION BY page_uid ORDER BY ingested_at DESC) = 1),
b AS (SELECT * FROM page_mirror QUALIFY row_number() OVER (PARTITION BY page_uid ORDER BY ingested_at DESC) = 1),
j AS (SELECT coalesce(a.page_uid, b.page_uid) AS page_uid, a.page_uid IS NULL AS no_a, b.page_uid IS NULL AS no_b,
  a.page_num IS DISTINCT FROM b.page_num AS d1, a.norm_text IS DISTINCT FROM b.norm_text AS d2, a.checksum IS DISTINCT FROM b.checksum AS d3
  FROM a FULL JOIN b ON a.page_uid = b.page_uid),
r AS (SELECT page_uid, 'only_in_text' AS difference FROM j WHERE no_b
UNION ALL SELECT page_uid, 'only_in_mirror' FROM j WHERE no_a
UNION ALL SELECT page_uid, 'page_num' FROM j WHERE NOT no_a AND NOT no_b AND d1
UNION ALL SELECT page_uid, 'norm_text' FROM j WHERE NOT no_a AND NOT no_b AND d2
UNION ALL SELECT page_uid, 'checksum' FROM j WHERE NOT no_a AND NOT no_b AND d3)
"""


def _differences(spark: SparkSession, d: str) -> DataFrame:
    return diff_tables(table(spark, d, "page_text"), table(spark, d, "page_mirror"), ["page_uid"], MIRRORED, "ingested_at", ("text", "mirror"))


@query(P5 + "SELECT * FROM r")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per difference between page_text and page_mirror."""
    return difference_rows(_differences(spark, d), ["page_uid"])


@query(P5 + "SELECT difference, count(*) AS n FROM r GROUP BY difference")
def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Differences by kind."""
    return difference_counts(_differences(spark, d))
