"""Files that arrive in a folder, processed as a stream that ends when all are done.

An addition to the batch conversions: each file is read once, by the stream's checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators.pages import normalize_pages
from foliospark.sources.markup import epub_pages, parse_epub


def incoming(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(doc_id, path, content) of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder).select(F.xxhash64("path").alias("doc_id"), "path", "content")


def page_stream(spark: SparkSession, folder: str, target: str, checkpoint: str):
    """Pages of arriving e-books appended to a Parquet table; returns the started query.

    Batches are numbered and their output replaced as a whole, so a batch run again adds nothing."""

    def store(batch: DataFrame, number: int) -> None:
        normalize_pages(epub_pages(parse_epub(batch))).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return incoming(spark, folder, "*.epub").writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_pages(pages: DataFrame, delay: str = "30 days") -> DataFrame:
    """Pages per day and extractor of a stream with event time ingested_at; what comes later than `delay` is dropped."""
    return pages.withWatermark("ingested_at", delay).groupBy(F.window("ingested_at", "1 day"), "extractor").agg(F.count("*").alias("pages"), F.count_if(F.col("has_ocr")).alias("scanned"))
