"""Text of pages and lines as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python has it: Unicode's, and the four separators that Java's class leaves out.
SPACE = r"[\s\x1c-\x1f]"


def collapse(text: Column) -> Column:
    """Each run of white space as one blank; nothing is trimmed."""
    return F.regexp_replace(text, rf"(?U){SPACE}+", " ")


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, rf"(?U)\A{SPACE}+|{SPACE}+\z", "")


_broken = re.compile(r"(\w+)-\n(\w+)")


def _join(match: re.Match) -> str:
    left, right = match.groups()
    return left + "-" * (left.isupper() and right.isupper()) + right


@F.pandas_udf(T.StringType())
def _dehyphenated(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _broken.sub(_join, t), na_action="ignore")


def dehyphenate(text: Column) -> Column:
    """Words broken by a hyphen at a line's end joined; the hyphen stays between two upper-case parts.

    Python is entered only by texts that have a hyphen at a line's end."""
    return F.when(F.contains(text, F.lit("-\n")), _dehyphenated(F.when(F.contains(text, F.lit("-\n")), text))).otherwise(text)


def normalized(text: Column, collapse_spaces: bool = True, join_hyphens: bool = True) -> Column:
    """struct(text, events): the normalised text and what each rule that changed it found and made."""
    steps, current, events = [], text, []
    if collapse_spaces:
        steps.append(("collapse_internal_whitespace", collapse))
    if join_hyphens:
        steps.append(("dehyphenate_line_endings", dehyphenate))
    for name, rule in steps:
        made = rule(current)
        events.append(F.when(current != made, F.struct(F.lit(name).alias("rule"), current.alias("before"), made.alias("after"))))
        current = made
    none = F.array().cast("array<struct<rule:string,before:string,after:string>>")
    return F.struct(current.alias("text"), F.filter(F.array(*events), lambda e: e.isNotNull()).alias("events") if events else none.alias("events"))


def checksum(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, in hex; null of null."""
    return F.sha2(text, 256)


def word_count(text: Column) -> Column:
    """Runs without white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"), F.lit(0)))


def special_signs(text: Column) -> Column:
    """Every code point beyond 127, in order, with repetitions."""
    return F.regexp_extract_all(text, F.lit(r"[^\x00-\x7F]"), F.lit(0))


def clean_join(segments: Column) -> Column:
    """Text of array<struct<left, ord, text>>: by place, empty ones left out, one blank between where neither side has one."""
    parts = F.filter(F.transform(F.array_sort(segments), lambda s: s["text"]), lambda t: t.isNotNull() & (t != ""))
    return F.aggregate(
        parts, F.lit(""), lambda text, part: F.when(text == "", part).when(text.endswith(" ") | part.startswith(" "), F.concat(text, part)).otherwise(F.concat(text, F.lit(" "), part))
    )


def list_item(text: Column, markers: list[str]) -> Column:
    """struct(list_type, item): itemized by the first marker that stands first, ordered by a number or letter, else null type."""
    bare = F.regexp_replace(text, rf"(?U)\A{SPACE}+", "")
    ordered = r"^(?:\(?\d+[.)]|[A-Za-z][.)])[ \t\n\r\f\x0b]+"
    kind, rest = F.when(bare.rlike(ordered), "ordered"), F.regexp_replace(bare, ordered, "")
    item = F.when(bare.rlike(ordered), rest)
    for marker in reversed(markers):
        has = bare.startswith(marker)
        kind = F.when(has, "itemized").otherwise(kind)
        item = F.when(has, F.substring(bare, len(marker) + 1, 1 << 30)).otherwise(item)
    whole = F.when(kind == "itemized", strip(text)).otherwise(bare)
    return F.struct(kind.alias("list_type"), F.when(kind.isNotNull(), F.coalesce(F.nullif(strip(item), F.lit("")), whole)).alias("item"))


def index_text(text: Column) -> Column:
    """An index line with its dot leaders and white space made one blank."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\.{2,}", " "), rf"(?U){SPACE}+", " "))


def index_parts(text: Column) -> Column:
    """struct(entry, pages, reference) of a cleaned index line.

    The reference is a trailing "see" or "see also" with its target; pages are what then stands
    from the first digit of a trailing page list on; the entry is the rest without punctuation."""
    see = r"(?is),\s*(see(?:\s+also)?)\s+(.*)$"
    has_reference = text.rlike(see)
    reference = F.when(has_reference, strip(F.concat_ws(" ", F.regexp_extract(text, see, 1), F.trim(F.regexp_extract(text, see, 2)))))
    before = F.when(has_reference, F.regexp_replace(F.regexp_replace(text, see, ""), "[, ]+$", "")).otherwise(text)
    page_list = r"([0-9][0-9A-Za-z\s,–-]*)$"
    has_pages = before.rlike(page_list)
    pages = F.when(has_pages, F.trim(F.regexp_extract(before, page_list, 1)))
    rest = F.when(has_pages, F.regexp_replace(F.regexp_replace(before, page_list, ""), "[,;: ]+$", "")).otherwise(before)
    return F.struct(F.regexp_replace(rest, "^[, ]+|[, ]+$", "").alias("entry"), pages.alias("pages"), reference.alias("reference"))


def isbn(raw: Column) -> Column:
    """Letters and digits only; null where none is left."""
    return F.nullif(F.regexp_replace(raw, "[^0-9A-Za-z]", ""), F.lit(""))


def basename(raw: Column) -> Column:
    """Fit for a file name; `book` where nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(raw, "[^0-9A-Za-z_-]", ""), F.lit("")), F.lit("book"))


def file_size(size: Column) -> Column:
    """Bytes as B, KB or MB of 1024, one decimal, exact halves to even."""
    number = lambda unit: F.format_string("%.1f", F.bround(size / unit, 1))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit("B"))).when(size < 1024 * 1024, F.concat(number(1024.0), F.lit("KB"))).otherwise(F.concat(number(1024.0 * 1024.0), F.lit("MB")))


def local_name(tag: Column) -> Column:
    """A tag without its namespace; null tags are empty."""
    return F.coalesce(F.regexp_replace(tag, r"^\{[^}]*\}", ""), F.lit(""))


def xml_space(text: Column) -> Column:
    """XML's white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))


#: Rules by name, open to more: each a function from column to column.
RULES = {"collapse_internal_whitespace": collapse, "dehyphenate_line_endings": dehyphenate}
