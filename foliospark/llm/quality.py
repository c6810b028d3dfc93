"""Figures of each page by which prose stands apart from lists, tables and junk."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is common if one page in so many of its language has it, two at least. A page has few hundred words, so
#: there are at most a few hundred times this many common words a language, however large the corpus.
COMMON_PAGES = 30
#: Lines whose lengths spread by less than this share of their mean are of one length; entries that make a rhythm.
EVEN, ENTRIES = 0.2, 6
ENDS = ".!?;:…”\"'»"

FIGURES = ["lines", "words", "mean_word_length", "symbol_share", "digit_share", "ended_lines", "common_share", "lower_share", "sentence_rate", "enumerated", "delimiter_alignment", "indent_period", "length_autocorrelation", "number_columns"]
SCHEMA = T.StructType([T.StructField("page_uid", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in FIGURES), T.StructField("kind", T.StringType())])

_word = re.compile(r"[^\W\d_]+")
_sentence = re.compile(r"[^\W\d_]{2,}['’”\")»�\x80-\x9f]*[.!?;…][\"'”’)»\]]*(?=\s|$)|[.!?]”")
_enumerator = re.compile(r"(?:^|(?<=\s))(?:\(?\d{1,3}[.)]|\d{1,2}(?:\.\d{1,2})+|[•▪‣◦*–-])\s+(?=\S)")
_cell = re.compile(r"(?:^|(?<=[\s|]))(?:[<>~]?\d[\d.,]*%?|\(\d+\)|n/a|[—–-])(?=[\s|]|$)")
_leader = re.compile(r"(?:\.\s?){4,}\s*\d+|,\s*\d{1,4}(?=[\s,]|$)|\bpp?\.\s*\d+")
_gap = re.compile(r"(?<=\S)(?: {2,}| *\t[ \t]*)(?=\S)")
_glyph = re.compile(r"\(cid:\d+\)|/G\d{2}|&#\d+;")


def _autocorrelation(values: np.ndarray) -> float:
    """The strongest at a short distance, about the mean; lines of about one length count as 1."""
    if len(values) < 4:
        return 0.0
    centred = values - values.mean()
    power = float(centred @ centred) / len(values)
    if power <= (EVEN * values.mean()) ** 2:
        return 1.0
    return max(float((centred[p:] * centred[:-p]).mean()) / power for p in range(1, max(2, min(6, len(values) // 3))))


def _period(indents: np.ndarray) -> float:
    """How well the rarer indents of lines repeat with some short period; no indent repeats nothing."""
    if len(indents) < 6 or not indents.any() or (indents == indents[0]).all():
        return 0.0
    values, counts = np.unique(indents, return_counts=True)
    rare, best = indents != values[counts.argmax()], 0.0
    for p in range(2, max(3, min(6, len(indents) // 2))):
        either = rare[p:] | rare[:-p]
        best = max(best, float((indents[p:] == indents[:-p])[either].mean()) if either.any() else 0.0)
    return best


def _alignment(lines: list[str]) -> float:
    """The share of lines with a delimiter, or an edge of a gap, at the column where most have one."""
    edges: Counter = Counter()
    for line in lines:
        if "|" in line or "\t" in line or "  " in line:
            at = lambda i, line=line: len(line[:i].expandtabs(8))
            own = {("|", at(m.start())) for m in re.finditer(r"\|", line)}
            for m in _gap.finditer(line):
                own |= {("end", at(m.start())), ("start", at(m.end()))}
            edges.update(own)
    return max(edges.values(), default=0) / len(lines) if lines else 0.0


def _evenness(lines: list[str]) -> float:
    """The share of lines whose delimiters stand in the most frequent number, wherever they stand; none at all are not even."""
    counts = [line.count("|") + line.count("\t") + len(re.findall(r"\S {2,}(?=\S)", line)) for line in lines]
    some = [c for c in counts if c]
    return some.count(max(set(some), key=some.count)) / len(lines) if some else 0.0


def _rhythm(lines: list[str], f: dict[str, float]) -> bool:
    """The lines are entries of one short sentence each, in a rhythm of indents or lengths.

    An entry begins at the outer indent, after a line that ends a sentence; in prose, paragraphs
    begin at the inner one, and a line wrapped at the margin ends no sentence."""
    if f["indent_period"] < 0.8 and f["length_autocorrelation"] < 0.6:
        return False
    outer = min(len(line) - len(line.lstrip()) for line in lines)
    starts = [i for i, line in enumerate(lines) if len(line) - len(line.lstrip()) == outer]
    ended = sum(lines[i - 1].rstrip()[-1] in ENDS for i in starts)
    return len(starts) >= ENTRIES and ended >= 0.9 * len(starts) and f["words"] <= 15 * len(starts) and f["sentence_rate"] * f["words"] <= 1.2 * max(len(starts), f["ended_lines"] * len(lines))


def figures(text: str, common: frozenset[str]) -> dict[str, float]:
    """The figures of one text, all 0 for one without a word."""
    lines = [line for line in text.split("\n") if line.strip()]
    words = _word.findall(text)
    n, size = max(len(words), 1), max(len(text), 1)
    spaces = sum(map(str.isspace, text))
    digits, letters = sum(map(str.isdigit, text)), sum(map(len, words))
    cells = [len(_cell.findall(line)) for line in lines]
    lengths = np.array([len(line.strip()) for line in lines], float)
    indents = np.array([len(line) - len(line.lstrip()) for line in lines])
    return {
        "lines": float(len(lines)),
        "words": float(len(words)),
        "mean_word_length": letters / n if words else 0.0,
        "symbol_share": (len(text) - spaces - digits - letters) / size,
        "digit_share": digits / size,
        "ended_lines": sum(line.rstrip()[-1] in ENDS for line in lines) / max(len(lines), 1),
        "common_share": sum(w.lower() in common for w in words) / n,
        "lower_share": sum(w[0].islower() for w in words) / n,
        "sentence_rate": len(_sentence.findall(text)) / n,
        "enumerated": len(_enumerator.findall(text)) / n,
        "delimiter_alignment": _alignment(lines),
        "indent_period": _period(indents),
        "length_autocorrelation": _autocorrelation(lengths),
        "number_columns": sum(cells) / max(sum(cells) + len(words), 1),
    }


def kind(text: str, f: dict[str, float]) -> str:
    """prose, list, table, junk or blank.

    Prose has sentences: their ends come every few to some dozens of words, most words between are
    lower case or common, and nothing else orders the page: lines that all end in full stops are a
    table if their cells stand in columns, a list if they are short entries in a rhythm of indents or
    lengths. Without sentences, cells in columns make a table, entries a list, and what has neither is junk."""
    if not text.strip():
        return "blank"
    leaders = len(_leader.findall(text)) / max(f["words"], 1)
    listed = f["enumerated"] > 0.08 or leaders > 0.08
    lines = [line for line in text.split("\n") if line.strip()]
    tabular = f["number_columns"] > 0.12 or f["sentence_rate"] < 0.03 and max(f["delimiter_alignment"], _evenness(lines)) > 0.6
    if len(_glyph.findall(text)) * 8 > len(text) / 4 or f["words"] < 4 or (f["symbol_share"] > 0.45 and f["common_share"] < 0.1 and f["sentence_rate"] < 0.03):
        return "junk"
    sentences = 0.02 <= f["sentence_rate"] <= 0.3 or f["sentence_rate"] > 0.006 and f["common_share"] >= 0.1
    ordered = f["number_columns"] > 0.12 or tabular and f["common_share"] < 0.3
    if sentences and not listed and not (ordered and f["sentence_rate"] < 0.04):
        if f["common_share"] >= 0.04 or f["lower_share"] >= 0.5 or f["symbol_share"] > 0.1:
            if len(lines) >= 4 and f["delimiter_alignment"] > 0.6 and f["ended_lines"] >= 0.9 and f["words"] <= 20 * len(lines):
                return "table"
            return "list" if len(lines) >= ENTRIES and _rhythm(lines, f) else "prose"
    if f["number_columns"] > 0.25 and f["sentence_rate"] < 0.02 and leaders <= 0.08:
        return "table"
    if listed:
        return "list"
    if tabular:
        return "table"
    if f["sentence_rate"] < 0.02 and f["common_share"] >= 0.35 and f["lower_share"] > 0.6 and f["words"] > 8 and not _repeats(text):
        return "prose"  # a short page cut off before its first full stop
    if _repeats(text) or not _pronounceable(text):
        return "junk"
    return "list"


def _repeats(text: str) -> bool:
    """The page says one thing over and over."""
    words = text.split()
    return len(words) >= 12 and len(set(words)) < len(words) / 3


def _pronounceable(text: str) -> bool:
    """Words are as words are: few digits inside, few capitals inside, vowels among the Latin letters."""
    words = _word.findall(text)
    letters = [c for w in words for c in w.lower()]
    latin = [c for c in letters if c < "ɐ"]
    vowels = sum(c in "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýąęóœ" for c in latin)
    inner = sum(c.isupper() for w in words for c in w[1:]) / max(len(letters), 1)
    return (len(latin) < 20 or vowels > 0.22 * len(latin)) and inner < 0.25


#: Bytes up to which a narrow side is broadcast; beyond, it is joined by shuffle, with the same rows.
BROADCAST_BYTES = 32_000_000


def sized(rows: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Narrow rows to join with: to be broadcast if their bytes, counted, are within the limit."""
    texts = [c for c, kind in rows.dtypes if kind == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(48))
    return F.broadcast(rows) if (rows.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit else rows


def language_of(pages: DataFrame, books: DataFrame | None, book: str = "book_id", lang: str = "lang") -> DataFrame:
    """`pages` with a column `__lang`: the book's language in lower case, one group for what has none.

    (book, language) is joined as narrow rows, broadcast if small enough, so that texts stay where
    they are. Pages of no book are not sent to one task for it."""
    if books is None:
        return pages.withColumn("__lang", F.lit(""))
    named = books.where(books[book].isNotNull()).groupBy(books[book].alias("__book")).agg(F.max(F.lower(F.trim(books[lang]))).alias("__lang"))
    known = pages.where(pages[book].isNotNull()).join(sized(named), F.col(book) == F.col("__book"), "left").drop("__book").withColumn("__lang", F.coalesce("__lang", F.lit("")))
    return known.unionByName(pages.where(pages[book].isNull()).withColumn("__lang", F.lit("")))


def word_shares(pages: DataFrame, text: str, pages_per_word: int, least: int, books: DataFrame | None = None, book: str = "book_id") -> dict[str, float]:
    """Each word that one page in `pages_per_word` of a language has, `least` at least: the greatest share of a language's pages with it.

    Shares are within a language, so more pages of others take no word away. What the driver
    collects is bounded by the number of languages."""
    spoken = language_of(pages, books, book).where(F.col(text).isNotNull()).select("__lang", F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\p{L}+"), F.lit(0))).alias("w"))
    counts = spoken.select("__lang", F.explode(F.concat(F.array(F.lit("")), "w")).alias("word")).groupBy("__lang", "word").agg(F.count("*").alias("n"))
    totals = counts.where("word = ''").select("__lang", F.col("n").alias("total"))
    kept = counts.where("word <> ''").join(totals, "__lang").where(F.col("n") >= F.greatest(F.lit(least), F.col("total") / pages_per_word))
    return {r.word: r.share for r in kept.groupBy("word").agg(F.max(F.col("n") / F.col("total")).alias("share")).toLocalIterator()}


def common_words(pages: DataFrame, text: str = "norm_text", pages_per_word: int = COMMON_PAGES, books: DataFrame | None = None) -> frozenset[str]:
    """The words that one page in `pages_per_word` of a language has, over all pages."""
    return frozenset(word_shares(pages, text, pages_per_word, 2, books))


def page_figures(pages: DataFrame, books: DataFrame | None = None, key: str = "page_uid", text: str = "norm_text", common: frozenset[str] | None = None) -> DataFrame:
    """(page_uid, the figures, kind) of every page, one row per distinct page state.

    With `books` (book_id, lang) common words are learned language by language. Null and empty texts have figures of 0 and kind blank. Texts of any length are taken whole. No
    shuffle but that which drops redelivered rows, on key and figures."""
    shared = pages.sparkSession.sparkContext.broadcast(common_words(pages, text, books=books) if common is None else common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                f = figures(t or "", shared.value)
                rows.append([*f.values(), kind(t or "", f)])
            columns = list(zip(*rows)) if rows else [[]] * (len(FIGURES) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in columns[:-1]), pa.array(columns[-1], pa.string())], SCHEMA.names)

    return pages.select(pages[key].cast("long"), pages[text]).mapInArrow(run, SCHEMA).dropDuplicates(["page_uid", "kind", *FIGURES])


def not_prose(figures_of: DataFrame) -> DataFrame:
    """(page_uid) of the lists, tables and junk pages."""
    return figures_of.where(F.col("kind").isin("list", "table", "junk")).select("page_uid").distinct()
