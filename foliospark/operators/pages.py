"""Pages: splitting, comparing two extractions, and quality metrics.

A page table has doc_id, page_num, norm_text, checksum and has_ocr. Of several rows of a page the
one with the greatest `ord` counts, where a frame has that column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import checksum, normalized, special_signs, strip, word_count

PAGE = ["doc_id", "page_num"]


def split_pages(documents: DataFrame, doc: str, text: str, separator: str = "\f", keep_last_empty: bool = True) -> DataFrame:
    """(doc_id, page_num, raw_text): a text cut at each separator, numbered from 1; null texts have no page."""
    parts = F.split(documents[text], separator, -1)
    if not keep_last_empty:
        parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return documents.select(documents[doc].alias("doc_id"), F.posexplode(parts).alias("p", "raw_text")).select("doc_id", (F.col("p") + 1).alias("page_num"), "raw_text")


def normalize_pages(pages: DataFrame, collapse: bool = True, dehyphenate: bool = True) -> DataFrame:
    """The pages with norm_text, events and checksum made from raw_text."""
    made = pages.withColumn("__n", normalized(F.col("raw_text"), collapse, dehyphenate))
    return made.withColumn("norm_text", F.col("__n.text")).withColumn("events", F.col("__n.events")).withColumn("checksum", checksum(F.col("norm_text"))).drop("__n")


def last_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, the one with the greatest `order`; combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("__s"))
    return newest.select(*keys, *(F.col("__s")[c].alias(c) for c in rest))


def mismatched_pages(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, page_num): pages of the first extraction that the second lacks or has otherwise."""
    other = second.select(*PAGE, F.col("norm_text").alias("other"))
    return first.select(*PAGE, "norm_text").join(other, PAGE, "left").where(F.col("other").isNull() | (F.col("norm_text") != F.col("other"))).select(*PAGE)


def image_only_pages(first: DataFrame, second: DataFrame) -> DataFrame:
    """(doc_id, page_num): pages blank in the first extraction and not filled in the second."""
    blank = lambda c: strip(F.coalesce(c, F.lit(""))) == ""
    filled = second.where(~blank(F.col("norm_text"))).select(*PAGE)
    return first.where(blank(F.col("norm_text"))).select(*PAGE).join(filled, PAGE, "left_anti")


def with_ocr_flag(pages: DataFrame, image_pages: DataFrame) -> DataFrame:
    """The pages, has_ocr true on those of `image_pages`."""
    marked = image_pages.select(*PAGE).distinct().withColumn("__ocr", F.lit(True))
    return pages.drop("has_ocr").join(marked, PAGE, "left").withColumn("has_ocr", F.coalesce("__ocr", F.lit(False))).drop("__ocr")


def page_quality(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row per page of `before`: counts, checksums, flags and has_ocr against its page in `after`.

    A page without counterpart has zeros, an empty checksum and the flag missing_output_page; texts
    that differ give text_mismatch, lengths that differ char_count_diff. Pages of `after` alone are
    left out. Null texts count as empty."""
    text = lambda c: F.coalesce(c, F.lit(""))
    right = after.select(*PAGE, text(F.col("norm_text")).alias("out_text"), F.col("checksum").alias("out_sum"), F.col("has_ocr").alias("out_ocr"), F.lit(True).alias("there"))
    both = before.select(*PAGE, text(F.col("norm_text")).alias("in_text"), F.col("checksum").alias("in_sum")).join(right, PAGE, "left")
    there = F.coalesce("there", F.lit(False))
    out = text(F.col("out_text"))
    flags = F.filter(
        F.array(
            F.when(~there, "missing_output_page"),
            F.when(there & (F.col("in_text") != out), "text_mismatch"),
            F.when(there & (F.length("in_text") != F.length(out)), "char_count_diff"),
        ),
        lambda f: f.isNotNull(),
    )
    return both.select(
        *PAGE,
        F.length("in_text").alias("chars_in"), F.length(out).alias("chars_out"),
        word_count(F.col("in_text")).alias("words_in"), word_count(out).alias("words_out"),
        F.col("in_sum").alias("checksum_in"), F.when(there, F.col("out_sum")).otherwise("").alias("checksum_out"),
        flags.alias("flags"), F.coalesce("out_ocr", F.lit(False)).alias("has_ocr"),
    )


def special_counts(pages: DataFrame) -> DataFrame:
    """(doc_id, sign, n): how often each code point beyond 127 stands in a document's pages."""
    return pages.select("doc_id", F.explode(special_signs(F.col("norm_text"))).alias("sign")).groupBy("doc_id", "sign").agg(F.count("*").alias("n"))


def quality_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, total_pages, flagged_pages, flags, special_chars) of each document.

    flags has every page's flags in page order; special_chars counts the signs of both sides, thus
    twice where they are equal."""
    pages = page_quality(before, after)
    totals = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.count_if(F.size("flags") > 0).alias("flagged_pages"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "flags"))), lambda p: p["flags"])).alias("flags"))
    met = after.join(before.select(*PAGE).distinct(), PAGE, "left_semi")
    signs = special_counts(before.select("doc_id", "norm_text").unionByName(met.select("doc_id", "norm_text"))).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("sign", "n")))).alias("special_chars"))
    return totals.join(signs, "doc_id", "left").withColumn("special_chars", F.coalesce("special_chars", F.create_map().cast("map<string,bigint>")))


def report_rows(quality: DataFrame, file: Column) -> DataFrame:
    """The quality rows as a report shows them: strings for flags, has_ocr and status."""
    return quality.select(
        file.alias("file"), F.col("page_num").alias("page"), "chars_in", "chars_out", "words_in", "words_out", "checksum_in", "checksum_out",
        F.concat_ws(";", "flags").alias("flags"), F.when(F.col("has_ocr"), "yes").otherwise("no").alias("has_ocr"), F.when(F.size("flags") > 0, "discrepancy").otherwise("ok").alias("status"),
    )


def page_ranges(pages: DataFrame) -> DataFrame:
    """(doc_id, ranges): a document's page numbers as `1-3,5,8-9`. Null numbers are left out."""
    numbered = pages.select(*PAGE).where(F.col("page_num").isNotNull()).distinct()
    island = F.col("page_num") - F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num"))
    spans = numbered.withColumn("island", island).groupBy("doc_id", "island").agg(F.min("page_num").alias("a"), F.max("page_num").alias("b"))
    one = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    sorted_spans = F.array_sort(F.collect_list(F.struct("a", one.alias("s"))))
    return spans.groupBy("doc_id").agg(F.array_join(F.transform(sorted_spans, lambda x: x["s"]), ",").alias("ranges"))
