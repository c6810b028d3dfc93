"""Strings that look alike and differ in their characters.

Every word that is not plain ASCII is mapped to what it looks like: compatibility forms plain, marks
composed, spaces plain, invisible characters gone, and, only where letters of two of the Latin,
Cyrillic and Greek scripts stand in it, all letters in the one script that can write the whole word.
Mapped values are grouped in SQL, script by script, under the accent-sensitive Unicode collation,
which holds canonically equal and invisibly different strings for one. One member of each class,
chosen by a fixed order among its mapped values, is canonical and joined back; a word that is not
its class's canonical member is a case. Words of one script keep it. A word that no script can write
whole has no canonical member: it is a case and stands as it is.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that look alike, Latin beside Cyrillic and Latin beside Greek.
CYRILLIC_TWINS = ("aceopxyijsABCEHIJKMOPSTXY", "асеорхуіјѕАВСЕНІЈКМОРЅТХУ")
GREEK_TWINS = ("ovinpyauABEHIKMNOPTXYZ", "ονιηργαυΑΒΕΗΙΚΜΝΟΡΤΧΥΖ")
SCRIPTS = {"LATIN": r"\p{IsLatin}", "CYRILLIC": r"\p{IsCyrillic}", "GREEK": r"\p{IsGreek}"}
#: Spaces other than the plain one; tab and line ends are plain.
SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}"
#: Format characters, and the letters and selectors that are drawn as nothing.
INVISIBLE = r"\p{Cf}\x{34F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180D}\x{3164}\x{FE00}-\x{FE0F}\x{FFA0}"
#: What Unicode calls the forms meant here; superscripts, fractions and circled signs are none.
COMPATIBLE = ("<wide>", "<narrow>", "<compat>", "<font>")
NOT_ALONE = frozenset("µ")


def _ranges(codes: list[int]) -> str:
    """The body of a character class."""
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\x{{{codes[i]:X}}}" + (f"-\\x{{{codes[j]:X}}}" if j > i else ""))
        i = j + 1
    return "".join(out)


@cache
def compatibility_forms() -> str:
    """Wide, narrow, ligature and styled forms of letters and digits, as Unicode lists them."""
    codes = []
    for code in range(0x80, sys.maxunicode + 1):
        sign = chr(code)
        kind = unicodedata.decomposition(sign).split(" ")[0]
        if kind in COMPATIBLE and sign.isalnum() and sign not in NOT_ALONE and unicodedata.normalize("NFKC", sign).isalnum():
            codes.append(code)
    return _ranges(codes)


@cache
def composing_pairs() -> str:
    """A letter and, perhaps after other marks, a mark for which one character stands."""
    by_mark: dict[int, list[int]] = {}
    for code in range(0x80, sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(code)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(code)) == chr(code):
            base, mark = (int(p, 16) for p in parts)
            if unicodedata.category(chr(mark))[0] == "M" and chr(base).isalpha():
                by_mark.setdefault(mark, []).append(base)
    return "|".join(rf"[{_ranges(sorted(bases))}]\p{{M}}*?\x{{{mark:X}}}" for mark, bases in sorted(by_mark.items()))


@cache
def mixed_scripts() -> str:
    """Letters of two scripts in one word: two of them with none of the three scripts between, in linear time."""
    inner = rf"(?:(?![{''.join(SCRIPTS.values())}])[\p{{L}}\p{{M}}\p{{N}}{INVISIBLE}])*+"
    return "|".join(f"{a}{inner}{b}" for a in SCRIPTS.values() for b in SCRIPTS.values() if a != b)


@cache
def _patterns():
    """(suspect sign, composing pair, two scripts, parts of a text) for the `regex` module."""
    import regex

    plain = lambda body: regex.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m.group(1), 16):08X}", body)
    signs = regex.compile(plain(rf"[{compatibility_forms()}{INVISIBLE}{SPACES}]"))
    return signs, regex.compile(plain(composing_pairs())), regex.compile(plain(mixed_scripts())), regex.compile(plain(rf"[\p{{L}}\p{{M}}\p{{N}}{INVISIBLE}]++|[{SPACES}]"))


_changed: dict[str, tuple[str, ...]] = {}


def changed_in(text: str) -> tuple[str, ...]:
    """The distinct words and spaces of a text or a piece of one that mapping changes or cannot write, in their order; remembered for short pieces."""
    found = _changed.get(text)
    if found is None:
        parts = dict.fromkeys(p for p in _patterns()[3].findall(text) if not p.isascii())
        found = tuple(p for p in parts if resolved(p)[2] != p)
        if len(text) < 100:
            if len(_changed) > 200_000:
                _changed.clear()
            _changed[text] = found
    return found


def is_suspect(word: str) -> bool:
    """The definition, read directly: a compatibility form, a composing pair, an invisible character, an unusual space or two scripts."""
    signs, pairs, scripts, _ = _patterns()
    return bool(signs.search(word) or pairs.search(word) or scripts.search(word))


def suspects_in(text: str) -> tuple[str, ...]:
    """The distinct words and spaces of a text that the definition names."""
    return tuple(w for w in changed_in(text) if is_suspect(w))


@cache
def _plain_sign(sign: str) -> str:
    """What one character is drawn as: nothing, a plain space, the plain form of a letter or digit, or itself."""
    if _is_invisible(sign):
        return ""
    if unicodedata.category(sign) == "Zs":
        return " "
    kind = unicodedata.decomposition(sign).split(" ")[0]
    if kind in COMPATIBLE and sign.isalnum() and sign not in NOT_ALONE and (plain := unicodedata.normalize("NFKC", sign)).isalnum():
        return plain
    return sign


def _visible(word: str) -> str:
    """Compatibility forms plain, marks composed, spaces plain, invisible characters gone."""
    return unicodedata.normalize("NFC", "".join(map(_plain_sign, word)))


@cache
def _is_invisible(sign: str) -> bool:
    return unicodedata.category(sign) == "Cf" or sign in "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" or "︀" <= sign <= "️"


@cache
def _script(sign: str) -> str:
    """Which of the three scripts a letter is of, else an empty string."""
    name = unicodedata.name(sign, "").split(" ")[0] if sign.isalpha() else ""
    return name if name in SCRIPTS else ""


_twins = {("CYRILLIC", "LATIN"): dict(zip(*CYRILLIC_TWINS[::-1])), ("LATIN", "CYRILLIC"): dict(zip(*CYRILLIC_TWINS)), ("GREEK", "LATIN"): dict(zip(*GREEK_TWINS[::-1])), ("LATIN", "GREEK"): dict(zip(*GREEK_TWINS))}


def _twin(sign: str, script: str) -> str | None:
    """The letter of a script that looks like this one, by way of Latin where need be."""
    own = _script(sign)
    if not own or own == script:
        return sign
    latin = sign if own == "LATIN" else _twins[own, "LATIN"].get(sign)
    return latin if script == "LATIN" or latin is None else _twins["LATIN", script].get(latin)


def in_script(word: str, script: str) -> str | None:
    """The word with every letter in one script, accents kept; None if a letter has no twin there."""
    signs = [_twin(c, script) for c in unicodedata.normalize("NFD", word)]
    return None if None in signs else unicodedata.normalize("NFC", "".join(signs))


def resolved(word: str, around: str | None = None) -> tuple[str, str, str | None]:
    """(script, what the word looks like, its mapped value).

    A word of one script, or of none of the three, is mapped within it. Of the scripts that can
    write a mixed word whole, that of the text `around` is taken, else the one that most of its
    letters have, of equals Latin, then Cyrillic; where none can, the script is `mixed` and the
    mapped value null."""
    word = _visible(word)
    counts = Counter(s for c in word if (s := _script(c)))
    if len(counts) < 2:
        return next(iter(counts), ""), word, word
    options = [(s != around, -counts[s], k, s, form) for k, s in enumerate(SCRIPTS) if (form := in_script(word, s)) is not None]
    if not options:
        return "mixed", word, None
    *_, script, form = min(options)
    return script, form, form


def plain_form(word: str) -> str:
    """A word as it should be written: its mapped value, else its visible form. Applied again it changes nothing."""
    _, looks, form = resolved(word)
    return looks if form is None else form


def script_around(words: list[str]) -> str:
    """The script of most letters in a text's words outside ASCII that are of one script; Latin where there are none."""
    counts: Counter = Counter()
    for word in words:
        own = Counter(s for c in word if (s := _script(c)))
        if len(own) == 1:
            counts.update(own)
    return max(SCRIPTS, key=lambda s: counts[s])


FORMED = T.StructType([T.StructField(n, T.StringType()) for n in ("word", "around", "script", "looks", "form")])


def _form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, around = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        columns = [words, around, *zip(*map(resolved, words, around))] if words else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], FORMED.names)


def canonical_words(words: DataFrame) -> DataFrame:
    """(word, around, canonical) of every distinct row of `words`, a word and the script around it; canonical is null where no script can write the word.

    Words of one script whose mapped values are equal under the accent-sensitive Unicode collation
    are a class; canonical is the mapped value to which most of its words lead, of equals the least
    in code points. Classes are combined before the shuffle."""
    formed = words.select("word", "around").distinct().mapInArrow(_form, FORMED)
    key = ["script", "looks"]
    ranked = formed.groupBy("script", F.collate("looks", "UNICODE").alias("looks"), "form").agg(F.count("*").alias("n"))
    chosen = ranked.groupBy(*key).agg(F.min_by("form", F.when(F.col("form").isNotNull(), F.struct(-F.col("n"), F.col("form")))).alias("canonical"))
    return formed.withColumn("looks", F.collate("looks", "UNICODE")).join(chosen, key).select("word", "around", "canonical")


SUSPECT = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("rec_id", T.LongType()), T.StructField("source", T.StringType()), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("suspects", T.ArrayType(T.StringType())), T.StructField("around", T.StringType())])


def suspect_records(rows: DataFrame, words: Column) -> DataFrame:
    """(table_name, rec_id, source, words, suspects, around) of the records with a word or space that mapping changes.

    `words` are the text's runs between plain white space that leave ASCII. Each batch maps its
    different ones once. No shuffle; null and plain texts have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, encoded = lists.offsets.to_numpy(), lists.values.dictionary_encode()
            distinct = encoded.dictionary.to_pylist()
            telling = np.array([bool(changed_in(w)) for w in distinct], bool)
            marked = telling[encoded.indices.to_numpy()] if distinct else np.zeros(0, bool)
            before = np.concatenate(([0], np.cumsum(marked)))
            some = np.flatnonzero(before[offsets[1:]] > before[offsets[:-1]])
            if len(some):
                part = batch.take(pa.array(some))
                own = part.column(3).to_pylist()
                suspects = [list(dict.fromkeys(s for w in ws for s in changed_in(w))) for ws in own]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(suspects, pa.list_(pa.string())), pa.array(map(script_around, own), pa.string())], SUSPECT.names)

    return rows.select("table_name", "rec_id", "source", words.alias("words")).mapInArrow(run, SUSPECT)


@F.pandas_udf(T.BooleanType())
def _suspect(words: pd.Series) -> pd.Series:
    return words.map(is_suspect)


def occurrences(suspects: DataFrame) -> DataFrame:
    """(table_name, rec_id, word, canonical): each word of each record that is not its class's canonical member.

    Only words that mapping changes are shuffled. The exact check of the definition follows, once a
    different word. A word that cannot be brought into one script has a null canonical and is
    still a row. Repeated records count once."""
    found = suspects.select("table_name", "rec_id", "around", F.explode("suspects").alias("word")).distinct()
    other = canonical_words(found).where(~F.col("word").eqNullSafe(F.col("canonical"))).where(_suspect("word"))
    return found.join(other, ["word", "around"]).select("table_name", "rec_id", "word", "canonical")


UNIFIED = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("rec_id", T.LongType()), T.StructField("unified", T.StringType())])


def unified(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(table_name, rec_id, unified): the texts of the records in `found` with every such word canonical; those without a canonical member stay."""
    import re

    per_record = found.groupBy("table_name", "rec_id").agg(F.collect_list(F.struct("word", "canonical")).alias("words"))
    joined = rows.select("table_name", "rec_id", "text").distinct().join(per_record, ["table_name", "rec_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, words in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                forms = {w["word"]: w["canonical"] for w in words if w["canonical"] is not None}
                longest_first = sorted(forms, key=lambda w: (-len(w), w))
                out.append(re.sub("|".join(map(re.escape, longest_first)), lambda m: forms[m.group()], text) if forms else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], UNIFIED.names)

    return joined.mapInArrow(run, UNIFIED)
