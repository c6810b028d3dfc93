"""What a line is, told from its text, place and size. `body` is the document's body size.

Sizes and places that are null count as 0, as a missing attribute does."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import SPACE, strip, word_count

#: Patterns, margins and shares by which lines are told apart.
CHAPTER_WORD = r"(?i)\bchapter\b"
CHAPTER_START = r"(?i)^(?:chapter|chap\.|unit|lesson|module)\b"
CONTENTS = r"(?i)^table of contents$"
INDEX_START = r"(?i)^index\b"
SECTION_START = r"(?i)^(?:section|sec\.|part)\b"
CAPTION_START = r"(?i)^(?:figure|fig\.|table)\s+\d+"
HEADING_MARGIN, SECTION_MARGIN, TITLE_MARGIN, SHORT_TITLE_MARGIN = 2.0, 1.5, 6.0, 4.0
UPPER_PART, TOP_BAND, BOTTOM_BAND, TITLE_TOP = 0.45, 0.08, 0.9, 400.0
GAP_FACTOR, GAP_EXTRA, INDENT, TIGHT_GAP, OUTDENT = 1.9, 2.0, 60.0, 1.1, 80.0
BODY_CHARS, BODY_DEFAULT = 30, 12.0
LOW_RESOLUTION = 72


def zero(column: Column) -> Column:
    return F.coalesce(column, F.lit(0.0))


def is_header_footer(text: Column, top: Column, page_height: Column) -> Column:
    """Empty, a page number in the outer bands, or a short copyright line."""
    bare = strip(F.coalesce(text, F.lit("")))
    number = (F.length(bare) <= 4) & bare.rlike(r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$") & (zero(page_height) > 0) & ((zero(top) < zero(page_height) * TOP_BAND) | (zero(top) > zero(page_height) * BOTTOM_BAND))
    return (bare == "") | number | ((F.length(bare) <= 30) & F.lower(bare).startswith("copyright"))


def has_heading_font(size: Column, body: Column) -> Column:
    return (zero(size) != 0) & (zero(size) >= body + HEADING_MARGIN)


def is_book_title(text: Column, page: Column, top: Column, page_height: Column, size: Column, body: Column) -> Column:
    """Large, on the first two pages, in their upper part."""
    bare, high = strip(text), F.when(zero(page_height) != 0, zero(top) <= zero(page_height) * UPPER_PART).otherwise(zero(top) <= TITLE_TOP)
    large = (zero(size) >= body + TITLE_MARGIN) | ((zero(size) >= body + SHORT_TITLE_MARGIN) & (word_count(bare) <= 12))
    return (bare != "") & (page <= 2) & high & large


def is_chapter_heading(text: Column, top: Column, page_height: Column, size: Column, body: Column) -> Column:
    """Heading font, and a chapter's word, the upper part of the page or few words."""
    bare = strip(text)
    placed = (zero(page_height) != 0) & (zero(top) <= zero(page_height) * UPPER_PART)
    return (bare != "") & has_heading_font(size, body) & (bare.rlike(CHAPTER_WORD) | bare.rlike(CHAPTER_START) | placed | (word_count(bare) <= 10))


def is_index_heading(text: Column, size: Column, body: Column) -> Column:
    return strip(text).rlike(INDEX_START) & has_heading_font(size, body)


def is_contents_heading(text: Column, size: Column, body: Column) -> Column:
    return strip(text).rlike(CONTENTS) & has_heading_font(size, body)


def is_section_heading(text: Column, size: Column, body: Column) -> Column:
    """A section's word, a little larger with few words, or a short line in capitals."""
    bare = strip(text)
    capitals = (F.upper(bare) == bare) & (F.lower(bare) != bare)
    larger = (zero(size) >= body + SECTION_MARGIN) & (word_count(bare) <= 14)
    return (bare != "") & (bare.rlike(SECTION_START) | larger | ((word_count(bare) <= 8) & capitals & (zero(size) >= body)))


def is_caption(text: Column) -> Column:
    return strip(text).rlike(CAPTION_START)


def continues(page: Column, top: Column, left: Column, height: Column, before_page: Column, before_top: Column, before_left: Column, before_height: Column) -> Column:
    """A line goes on with the paragraph of the line before."""
    gap = top - before_top
    near = gap <= F.greatest(height, before_height) * GAP_FACTOR + GAP_EXTRA
    aligned = ~((F.abs(before_left - left) > INDENT) & (gap > F.least(height, before_height) * TIGHT_GAP))
    return (page == before_page) & near & aligned & (left - before_left >= -OUTDENT)


def line_right(left: Column, segments: Column) -> Column:
    """The rightmost end of a line's segments, its left where it has none."""
    return F.coalesce(F.array_max(F.transform(segments, lambda s: zero(s["left"]) + zero(s["width"]))), left)


def nearest_column(x: Column, columns: Column) -> Column:
    """Index of the column nearest to x, of equals the first; null without columns."""
    return F.array_min(F.transform(columns, lambda c, i: F.struct(F.abs(c - x).alias("d"), i.alias("i"))))["i"]


def column_positions(lefts: Column, tolerance: float = 6.0) -> Column:
    """Column places of a line: sorted lefts, each within `tolerance` of a column's moving centre joins it.

    A fold in order: the centre becomes the mean of itself and the newcomer; the first column in
    reach takes it. Python is not entered."""
    def place(columns: Column, x: Column) -> Column:
        hit = F.array_min(F.filter(F.transform(columns, lambda c, i: F.when(F.abs(c - x) <= tolerance, i)), lambda i: i.isNotNull()))
        return F.when(hit.isNull(), F.concat(columns, F.array(x))).otherwise(F.transform(columns, lambda c, i: F.when(i == hit, (c + x) / 2).otherwise(c)))

    return F.array_sort(F.aggregate(F.array_sort(lefts), F.array().cast("array<double>"), place))
