"""The conversions end to end, each a plan over many documents at once."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import config
from foliospark.functions.text import basename, isbn
from foliospark.operators.lines import assemble_lines, with_font_size
from foliospark.operators.pages import image_only_pages, mismatched_pages, normalize_pages, page_quality, page_ranges, with_ocr_flag
from foliospark.plans.label import classify, label_blocks
from foliospark.plans.package import bundles
from foliospark.plans.tree import build_tree, with_info
from foliospark.session import cut
from foliospark.sources.markup import epub_html, epub_pages, html_to_docbook, layout_tables, parse_epub, parse_layout

#: The stylesheet that every bundle names and holds; a file of the configuration (docbook.stylesheet) takes its place.
STYLESHEET = "book.css"
PLAIN_STYLE = b"title { font-weight: bold } para, title, figure { display: block }\n"


@dataclass
class Converted:
    """The tables of a conversion; lazy, each computed where it is asked for."""

    pages: DataFrame
    quality: DataFrame
    nodes: DataFrame
    bundles: DataFrame
    mismatches: DataFrame | None = None
    image_only: DataFrame | None = None
    errors: DataFrame | None = None


def instructions(href: str = STYLESHEET) -> list[tuple[str, str]]:
    return [("xml-stylesheet", f'type="text/css" href="{href}"')]


def assets(settings: dict) -> dict[str, bytes]:
    """Files beside the documents of a bundle, by name."""
    path = settings["docbook"].get("stylesheet")
    return {STYLESHEET: Path(path).read_bytes() if path else PLAIN_STYLE}


def book_names(nodes: DataFrame) -> DataFrame:
    """(doc_id, name): the first isbn of each tree that has one, letters and digits only, fit for a file name."""
    found = nodes.where("tag = 'isbn'").select("doc_id", "node_id", isbn(F.col("text")).alias("isbn")).where("isbn IS NOT NULL")
    return found.groupBy("doc_id").agg(basename(F.min_by("isbn", "node_id")).alias("name"))


def _classified(blocks: DataFrame, settings: dict, classifier) -> DataFrame:
    """The blocks through the classifier, if the settings enable it, with their threshold and label of abstention."""
    own = settings.get("classifier", {})
    return classify(blocks, classifier if own.get("enabled") else None, own.get("threshold", 0.85), own.get("abstain_label", "abstain"))


def convert_layouts(first: DataFrame, second: DataFrame, layouts: DataFrame, media: DataFrame, settings: dict | None = None, strict: bool = False, ocr: bool = False, read_again: DataFrame | None = None, classifier=None) -> Converted:
    """Two extractions of page texts (doc_id, page_num, raw_text) and the layout files (doc_id, content) to bundles.

    `strict` raises if the extractions differ on any page. With `ocr`, image-only pages are flagged,
    or those of `read_again` where the files were read again already; which to read again is `to_read_again`. Quality compares pages with themselves as
    extracted and normalised, so its flags show duplicates only."""
    settings = settings or config.DEFAULTS
    rules = config.Normalization.of(settings)
    a, b = (normalize_pages(x, rules.collapse, rules.dehyphenate) for x in (first, second))
    mismatches, blank = mismatched_pages(a, b), image_only_pages(a, b)
    if strict and (bad := mismatches.limit(1).collect()):
        raise ValueError(f"the extractions differ, first on page {bad[0].page_num} of {bad[0].doc_id}")
    pages = with_ocr_flag(a, blank if read_again is None else read_again) if ocr else a.withColumn("has_ocr", F.lit(False))
    entries = parse_layout(layouts)
    fonts, texts, images = layout_tables(entries)
    blocks = _classified(label_blocks(assemble_lines(with_font_size(texts, fonts)), images, settings["pdf"]["list_markers"]), settings, classifier)
    nodes = with_info(cut(build_tree(blocks, settings["docbook"]["root"])))
    return Converted(pages, page_quality(pages, pages), nodes, bundles(nodes, media, settings["docbook"]["dtd_system"], names=book_names(nodes), instructions=instructions(), assets=assets(settings)), mismatches, blank, entries.where("kind = 'error'").select("doc_id", F.col("content").alias("error")))


def to_read_again(first: DataFrame, second: DataFrame, settings: dict | None = None) -> DataFrame:
    """The image-only pages of two extractions."""
    rules = config.Normalization.of(settings or config.DEFAULTS)
    return image_only_pages(*(normalize_pages(x, rules.collapse, rules.dehyphenate) for x in (first, second)))


def ocr_requests(converted: Converted) -> DataFrame:
    """(doc_id, ranges): the pages to read again."""
    return page_ranges(converted.image_only)


def convert_epubs(files: DataFrame, settings: dict | None = None, strict: bool = False) -> Converted:
    """E-book files (doc_id, content) to bundles; `strict` raises if a text block is blank."""
    settings = settings or config.DEFAULTS
    rules = config.Normalization.of(settings)
    rows = parse_epub(files)
    pages = normalize_pages(epub_pages(rows), rules.collapse, rules.dehyphenate).withColumn("has_ocr", F.lit(False))
    if strict and pages.where(F.trim("raw_text") == "").limit(1).count():
        raise ValueError("an e-book has a blank text block")
    nodes = with_info(cut(html_to_docbook(epub_html(rows), "doc_id", "html", settings["docbook"]["root"])))
    media = rows.where("kind = 'media'").select("doc_id", F.col("href").alias("ref"), "content")
    return Converted(pages, page_quality(pages, pages), nodes, bundles(nodes, media, settings["docbook"]["dtd_system"], names=book_names(nodes), instructions=instructions(), assets=assets(settings)), errors=rows.where("kind = 'error'").select("doc_id", F.col("text").alias("error")))
