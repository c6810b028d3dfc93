"""Text read with another character encoding than it was written in.

An unknown swap of code pages is a substitution cipher over the bytes of a text, one sign for one;
UTF-8 read as a code page is one whose symbols are runs of signs. Which ciphers a source has met,
and what their signs stand for, is learned by expectation-maximisation against letter bigrams.
Expectation weighs, for every word with a letter outside ASCII, its readings under all ciphers known
by their code pages, and the word as it stands, by how likely the bigrams make them. Maximisation
counts the bigrams, the common words and each source's share of each cipher by these weights. Then
the letter that each sign stands for is estimated source by source: of words that no known cipher
reads, from nothing but their sign pairs and the bigrams of each script; of the words of a known
cipher, from its code page on. What was learned is applied with translate().

Thresholds are nats, shares within a source or within a script: neither rows of other sources nor a
larger corpus of the same kind change what is believed. All words of all records count. The driver
holds bigrams, common words, shares and accepted tables; rows of pairs never leave the executors.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache
from math import exp, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.kernels import code_points
from foliospark.llm.lookalikes import SCRIPTS, plain_form
from foliospark.session import cut

READERS = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "cp437", "cp850", "mac_roman")
WRITERS = ("cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "mac_roman", "cp437", "cp850", "latin-1")
#: Code pages whose letters a run of UTF-8 may stand for, and from which unknown ciphers are first guessed.
OTHERS = ("cp1254", "cp1255", "cp1256", "cp1257", "cp1258", "cp852", "cp855", "iso8859-3", "iso8859-4", "iso8859-5", "iso8859-6", "iso8859-8", "iso8859-9", "iso8859-10", "iso8859-13", "iso8859-14", "iso8859-15", "iso8859-16", "koi8-u", "mac_cyrillic", "mac_greek", "mac_latin2")
#: Latin-1 has nothing but control signs where it differs from cp1252, so nobody has written them.
SAME = {("cp1252", "latin-1")}
ROUNDS = 2
#: What the different words of a record must gain together, in nats, before a cipher is believed, and what
#: a cipher is spared whose share of its source's words is over MET: its logarithm over MET, RELIEF at most.
DOUBT, MET, RELIEF = 9.5, 1e-4, 3.5
#: How much less a single word is doubted while learning.
LENIENT = 3.5
#: What one word at least must gain, and what a run of UTF-8 may lose, to be believed.
ALONE, RUN_LOSS = 3.5, -4.0
#: Nats a sign above which a word is as it should be.
LIKELY = -3.0
#: A word is common that makes up this share of its script's words outside ASCII, and stands so often; at most 1 / COMMON a script.
COMMON, OFTEN = 2e-4, 10
#: Bigrams rarer than this share of their first sign's are left to the smoothing, which is PRIOR signs and SMOOTH of a sign's own.
RARE, PRIOR, SMOOTH = 1e-5, 20.0, 1e-3
#: Nats that a letter of a table costs, and that a table of a source must gain over the cost of its letters;
#: with fewer sign pairs than these, no table could gain so much.
LETTER, EVIDENCE, ENOUGH = 8.0, 100.0, 300.0
LOST = "�"
#: Signs that the look-alike operator deals with; a cipher that changes nothing else explains nothing.
NEUTRAL = frozenset("\u00a0\u00ad")
#: A word: a run between plain white space that has a code point outside ASCII, found in one pass.
WORD = r"(?<![^ \t\n\r\f])[\x00-\x08\x0B\x0E-\x1F\x21-\x7F]*+[^\x00-\x7F][^ \t\n\r\f]*+"
KNOWN = 300_000
#: Signs of the matrix that screens words; words with others are followed sign by sign.
TABLE = 1200


@cache
def code_page(codec: str) -> tuple[str, ...]:
    """The 256 signs of a code page; bytes it leaves undefined stand for themselves."""
    signs = []
    for byte in range(256):
        try:
            signs.append(bytes([byte]).decode(codec))
        except UnicodeDecodeError:
            signs.append(chr(byte))
    return tuple(signs)


def _signs(word: str) -> frozenset[str]:
    return frozenset(c for c in word if c > "\x7f")


class SingleByte:
    """A text of code page `writer` read as `reader`: one sign for one."""

    def __init__(self, reader: str, writer: str):
        self.name, self.multi = f"{writer}>{reader}", False
        read, written = code_page(reader), code_page(writer)
        self.table = {ord(a): b for a, b in zip(read[128:], written[128:])}
        self.reader = frozenset(read[128:])
        self.changing = frozenset(chr(k) for k, v in self.table.items() if chr(k) != v) - NEUTRAL

    def may_have_made(self, signs: frozenset[str]) -> bool:
        """Whether a word with these signs outside ASCII can come of this cipher and be changed by it."""
        return signs <= self.reader and not self.changing.isdisjoint(signs)

    def undo(self, word: str) -> str | None:
        """What was written, None where this cipher can't have made the word."""
        return word.translate(self.table) if self.may_have_made(_signs(word)) else None

    def symbols(self, word: str) -> Iterator[tuple[str, str]]:
        for sign in word:
            if sign in self.changing:
                yield sign, self.table[ord(sign)]


class Learned(SingleByte):
    """A cipher of one source whose letters were learned: sign to letter."""

    def __init__(self, name: str, letters: dict[str, str]):
        self.name, self.multi, self.letters = name, False, letters
        self.table = {ord(k): v for k, v in letters.items()}
        self.changing = frozenset(k for k, v in letters.items() if k != v)

    def may_have_made(self, signs: frozenset[str]) -> bool:
        return not self.changing.isdisjoint(signs)


class MultiByte:
    """UTF-8 read as a code page, `times` times over: a run of two to four signs for one."""

    def __init__(self, reader: str, times: int = 1):
        self.name, self.multi, self.times = f"utf-8>{reader}" + "*" * (times - 1), True, times
        read = code_page(reader)
        self.bytes = {sign: byte for byte, sign in reversed(list(enumerate(read)))}
        self.leads, self.tails = frozenset(read[0xC2:0xF5]), frozenset(read[0x80:0xC0])
        some = lambda a, b: "[" + re.escape("".join(read[a:b])) + "]"
        tail = some(0x80, 0xC0)
        self.unit = re.compile(f"{some(0xC2, 0xE0)}{tail}|{some(0xE0, 0xF0)}{tail}{{2}}|{some(0xF0, 0xF5)}{tail}{{3}}")
        self.table: dict[str, str] = {}

    def may_have_made(self, signs: frozenset[str]) -> bool:
        """Whether a word with these signs outside ASCII can hold a run of this cipher."""
        return not self.leads.isdisjoint(signs) and not self.tails.isdisjoint(signs)

    def _letter(self, match: re.Match) -> str:
        unit = match.group()
        if unit not in self.table:
            try:
                self.table[unit] = bytes(self.bytes[c] for c in unit).decode("utf-8")
            except UnicodeDecodeError:
                self.table[unit] = unit
        return self.table[unit]

    def undo(self, word: str) -> str | None:
        for _ in range(self.times):
            read = self.unit.sub(self._letter, word)
            if read == word:
                return None
            word = read
        return word

    def symbols(self, word: str) -> Iterator[tuple[str, str]]:
        for _ in range(self.times - 1):
            word = self.unit.sub(self._letter, word)
        for match in self.unit.finditer(word):
            yield match.group(), self._letter(match)


_ciphers: list = []
_latin, _other = re.compile("[A-Za-zÀ-ɏ]"), re.compile("[Ͱ-ӿ]")
_edges = re.compile(r"^\W+|\W+$")
_no_letter = re.compile(r"[^\x00-\x7F\w]")


def _two_scripts(word: str) -> bool:
    return bool(_latin.search(word) and _other.search(word))


@cache
def script_of(sign: str) -> str:
    """The script of a letter, by its name; of anything else none."""
    return unicodedata.name(sign, "").split(" ")[0] if sign.isalpha() else ""


@cache
def written_signs() -> frozenset[str]:
    """The signs of all code pages, control signs aside: what a run of two signs may stand for."""
    return frozenset(c for page in (*READERS, *OTHERS) for c in code_page(page)[128:] if unicodedata.category(c)[0] != "C")


def folded(word: str) -> str:
    """Lower case for a word in capitals: these are likely as their small letters are."""
    return word.lower() if len(word) > 1 and word.isupper() else word


def core_of(word: str) -> str:
    return (word if word.isalnum() else _edges.sub("", word)).lower()


def malformed(word: str) -> bool:
    """No language writes so: a capital after a small letter, or a sign that is no letter, digit or punctuation between letters."""
    if (word[1:].islower() or word.isupper()) and not _no_letter.search(word):
        return False
    for a, b, c in zip(word, word[1:], word[2:] + " "):
        if (a.islower() and b.isupper()) or (a.isalpha() and c.isalpha() and b > "\x7f" and not b.isalnum() and unicodedata.category(b)[0] != "P"):
            return True
    return False


def ciphers() -> list:
    """All ciphers considered: UTF-8 as each reader, twice over too, and every pair of code pages."""
    if not _ciphers:
        _ciphers.extend([MultiByte(r) for r in READERS] + [MultiByte(r, 2) for r in READERS] + [SingleByte(r, w) for r in READERS for w in WRITERS if r != w and (r, w) not in SAME])
    return _ciphers


class Model:
    """Letter bigrams, common words, each source's share of each cipher, and the tables that were learned.

    `tables` has, by (source, cipher), the letters in which a known cipher differs from its code page;
    `learned` the unknown ciphers of a source."""

    def __init__(self, bigrams: dict[tuple[str, str], float], shares: dict[tuple[str | None, str], float] | None = None, words: dict[str, float] | None = None, tables: dict[tuple[str | None, str], dict[str, str]] | None = None, learned: dict[str | None, Learned] | None = None):
        self.bigrams, self.shares, self.words, self.tables, self.learned = bigrams, shares or {}, words or {}, tables or {}, learned or {}
        self.first_round = shares is None
        firsts, seconds, opening = Counter(), Counter(), Counter()
        for (x, y), n in bigrams.items():
            firsts[x] += n
            seconds[y] += n
            if x == "\n" and script_of(y) in SCRIPTS:
                opening[script_of(y)] += n
        total = sum(firsts.values()) + 5000.0
        self.base = {y: (n + 0.05) / total for y, n in seconds.items()}
        self.rare, self.firsts = 0.05 / total, dict(firsts)
        self.weight = {x: PRIOR + SMOOTH * n for x, n in firsts.items()}
        # a word's first letter is weighed within its script, so that no script is likelier for being had more often
        even = sum(opening.values()) / max(len(opening), 1)
        self.logs = {}
        for (x, y), n in bigrams.items():
            if x == "\n" and script_of(y) in opening:
                n *= even / opening[script_of(y)]
            self.logs[x, y] = log((n + self.weight[x] * self.base[y]) / (firsts[x] + self.weight[x]))
        self.runs = [c for c in ciphers() if c.multi]
        self.by_name = {c.name: c for c in ciphers()}
        self.known: dict[str, tuple] = {}
        self._dense: _Dense | None = None
        self.hints: dict[str, list] = {}
        self.languages: dict[str, _Language] = {}

    def language(self, script: str, plain: frozenset[str]) -> _Language:
        """The letter pairs of a script and of the `plain` signs that are given."""
        if script not in self.languages:
            self.languages[script] = _Language(self, script)
        return self.languages[script].only(plain)

    def pair(self, x: str, y: str) -> float:
        value = self.logs.get((x, y))
        if value is None:
            weight = self.weight.get(x, PRIOR)
            value = log(weight * self.base.get(y, self.rare) / (self.firsts.get(x, 0) + weight))
        return value

    def likelihood(self, word: str, least: float = -1e300) -> float:
        """Nats of a word by its bigrams; once under `least`, it is not followed to its end."""
        total, before, pair = 0.0, "\n", self.pair
        for sign in folded(word) + "\n":
            if total < least:
                return total
            total, before = total + pair(before, sign), sign
        return total

    def standing(self, word: str) -> float:
        """Nats of a word as it stands: by its bigrams, as a common word, or as look-alikes have disguised it."""
        value = self.likelihood(word)
        core = core_of(word)
        if (share := self.words.get(core)) is not None:
            value = max(value, log(share) - 1.0 - 1.5 * (len(word) - len(core)))
        return max(value, self.likelihood(plain)) if (plain := plain_form(word)) != word else value

    def prepare(self, words: list[str]) -> None:
        """Finds, for many words at once, the ciphers worth a closer look; `readings` then follows
        only those. Words with a sign outside the table are left to `readings` as they are."""
        if len(self.hints) > KNOWN:
            self.hints.clear()
        words = [w for w in words if w not in self.hints]
        if not words:
            return
        if self._dense is None:
            self._dense = _Dense(self)
        self.hints.update(self._dense.candidates(words))

    def readings(self, word: str) -> tuple[tuple[str, float, str, bool], ...]:
        """(cipher, gain, as written, multi-byte) of each cipher that may have made the word. Letters stay letters."""
        found = self.known.get(word)
        if found is None:
            hint = self.hints.get(word)
            if hint is not None and not hint:
                return ()
            plain, found, seen, signs = self.standing(word), [], {word}, _signs(word)
            unlikely = plain < LIKELY * (len(word) + 1) or self.first_round
            letters = sum(map(str.isalpha, word))
            for cipher in ciphers() if hint is None else hint:
                if (cipher.multi or unlikely) and cipher.may_have_made(signs) and (read := cipher.undo(word)) is not None and read not in seen:
                    seen.add(read)
                    if not self.believable(cipher, word) if cipher.multi else _two_scripts(read) or sum(map(str.isalpha, read)) < letters:
                        continue
                    gain = self.likelihood(read, plain + RUN_LOSS) - plain
                    if gain > RUN_LOSS and (cipher.multi or not malformed(read)):
                        found.append((cipher.name, gain, read, cipher.multi))
            if len(self.known) >= KNOWN:
                self.known.clear()
            found = self.known[word] = tuple(found)
        return found

    def own_readings(self, source: str | None, word: str) -> tuple[tuple[str, float, str, bool], ...]:
        """The readings of a word of a source: also by the cipher that was learned of it."""
        found, cipher = self.readings(word), self.learned.get(source)
        if cipher is not None and (read := cipher.undo(word)) is not None:
            if (gain := self.likelihood(read) - self.standing(word)) > RUN_LOSS:
                found = (*found, (cipher.name, gain, read, False))
        return found

    def believable(self, cipher: MultiByte, word: str) -> bool:
        """Some run of the word stands for a sign that a code page has, or begins with a sign that no letter is, or three signs or more leave none over.

        A word of one script that would become one of two is none."""
        if not _two_scripts(word) and _two_scripts(cipher.undo(word) or ""):
            return False
        symbols = list(cipher.symbols(word))
        if any(letter in written_signs() for _, letter in symbols):
            return True
        over = sum(c > "\x7f" for c in word) - sum(len(symbol) for symbol, _ in symbols)
        return not over and any(not symbol[0].isalpha() or len(symbol) > 2 for symbol, _ in symbols) or cipher.times > 1

    def doubt(self, source: str | None, name: str) -> float:
        """What a record's words must gain by a one-sign cipher: less where the source has met it often."""
        if name not in self.by_name:
            return DOUBT - RELIEF  # what was learned of the source itself
        share = self.shares.get((source, name), 0.0)
        return DOUBT - min(RELIEF, log(share / MET)) if share > MET else DOUBT

    def weights(self, source: str | None, word: str) -> list[tuple[tuple, float]]:
        """(reading, probability) of a word's readings; what is left to one is that of the word as it stands.

        A word alone is doubted less than a record is, or what it is read from would stay among the bigrams."""
        found = [(r, r[1] - RUN_LOSS if r[3] else r[1] - self.doubt(source, r[0]) + LENIENT) for r in self.readings(word)]
        if not found:
            return []
        top = max(0.0, *(v for _, v in found))
        total = exp(-top) + sum(exp(v - top) for _, v in found)
        return [(r, w) for r, v in found if (w := exp(v - top) / total) >= 0.01]


def _bits(flags: list[np.ndarray]) -> np.ndarray:
    """One row of flags for each cipher as bits: (64 ciphers, sign)."""
    bits = np.zeros(((len(flags) + 63) // 64, len(flags[0])), np.uint64)
    for i, row in enumerate(flags):
        bits[i // 64] |= row.astype(np.uint64) << np.uint64(i % 64)
    return bits


class _Dense:
    """The bigrams of the most frequent signs as a matrix, each one-sign cipher as an index array, and, as bits, the ciphers that a sign can come of."""

    def __init__(self, model: Model):
        counts = Counter(model.firsts)
        for (_, y), n in model.bigrams.items():
            counts[y] += n
        signs = ["\n", *(s for s, _ in counts.most_common(TABLE) if s != "\n")]
        self.ciphers, self.runs, self.first_round = [c for c in ciphers() if not c.multi], model.runs, model.first_round
        signs += sorted({s for c in self.ciphers for s in (*c.reader, *c.table.values())} - set(signs))
        signs += sorted({low for s in signs if len(low := s.lower()) == 1} - set(signs))
        index = {s: i for i, s in enumerate(signs)}
        self.low = np.array([index[low] if len(low := s.lower()) == 1 else -1 for s in signs])
        self.upper, self.lower = np.array([s.isupper() for s in signs]), np.array([s.islower() or s.istitle() and not s.isupper() for s in signs])
        #: The place of a code point in the table, -1 for none and for one whose small letter is two signs.
        self.places = np.full(0x110000, -1, np.int32)
        self.places[[ord(s) for s in signs]] = np.where(self.low >= 0, np.arange(len(signs)), -1)
        self.sigma = index.get("Σ", -1)
        base = np.array([model.base.get(s, model.rare) for s in signs])
        weight = np.array([model.weight.get(s, PRIOR) for s in signs])
        firsts = np.array([model.firsts.get(s, 0) for s in signs]) + weight
        self.logs = np.log(base)[None, :] + (np.log(weight) - np.log(firsts))[:, None]
        for (x, y), value in model.logs.items():
            if x in index and y in index:
                self.logs[index[x], index[y]] = value
        flags = lambda some: np.array([s in some for s in signs])
        plain, self.maps = np.array([s <= "\x7f" for s in signs]), []
        for c in self.ciphers:
            to = np.arange(len(signs))
            for code, letter in c.table.items():
                to[index[chr(code)]] = index[letter]
            self.maps.append(to)
        readers = {c.reader: plain | flags(c.reader) for c in self.ciphers}
        self.able, self.changes = _bits([readers[c.reader] for c in self.ciphers]), _bits([flags(c.changing) for c in self.ciphers])
        self.leads, self.tails = _bits([flags(c.leads) for c in self.runs])[0], _bits([flags(c.tails) for c in self.runs])[0]

    def total(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Nats of words by their bigrams; each begins with a line end, as what follows the last does."""
        capitals = np.logical_or.reduceat(self.upper[ids[:-1]], starts) & (lengths > 2)
        if capitals.any():
            capitals &= ~np.logical_or.reduceat(self.lower[ids[:-1]], starts)
            ids = np.where(np.append(np.repeat(capitals, lengths), False) & (self.low[ids] >= 0), self.low[ids], ids)
        return np.add.reduceat(self.logs[ids[:-1], ids[1:]], starts)

    def candidates(self, words: list[str]) -> dict[str, list]:
        """For each word of the table's signs: the UTF-8 readers of which it has the beginning of a run,
        and the one-sign ciphers, if it is unlikely as it stands, under which it loses less than RUN_LOSS."""
        at = self.places[code_points("\n" + "\n".join(words) + "\n")]
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(lengths) - lengths

        def part(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The words of these numbers alone, as `total` takes them."""
            long = lengths[some]
            begin = np.cumsum(long) - long
            return np.append(at[np.repeat(starts[some] - begin, long) + np.arange(long.sum())], 0), begin, long

        whole = np.flatnonzero(np.minimum.reduceat(at[:-1], starts) >= 0)
        found: dict[str, list] = {words[i]: [] for i in whole.tolist()}
        if not len(whole):
            return found
        words = [words[i] for i in whole.tolist()]
        at, starts, lengths = part(whole)
        runs = np.bitwise_or.reduceat(self.leads[at[:-1]] & self.tails[at[1:]], starts)
        for i in np.flatnonzero(runs).tolist():
            bits = int(runs[i])
            found[words[i]] += [c for k, c in enumerate(self.runs) if bits >> k & 1]
        plain = self.total(at, starts, lengths)
        # the last small sigma of a word in capitals is another sign than here: those are left to `readings`
        doubtful = np.flatnonzero((plain < LIKELY * lengths + 1e-6) | np.logical_or.reduceat(at[:-1] == self.sigma, starts)) if not self.first_round else np.arange(len(words))
        if not len(doubtful):
            return found
        words, plain = [words[i] for i in doubtful.tolist()], plain[doubtful]
        at, starts, lengths = part(doubtful)
        possible = np.bitwise_and.reduceat(self.able[:, at[:-1]], starts, axis=1) & np.bitwise_or.reduceat(self.changes[:, at[:-1]], starts, axis=1)
        for k, (c, to) in enumerate(zip(self.ciphers, self.maps)):
            some = np.flatnonzero(possible[k // 64] >> np.uint64(k % 64) & np.uint64(1))
            if len(some):
                ids, begin, long = part(some)
                for i in some[self.total(to[ids], begin, long) - plain[some] > RUN_LOSS].tolist():
                    found[words[i]].append(c)
        return found


def words_of(text: Column) -> Column:
    """The words of a text that have a code point outside ASCII."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def records(parts: list[tuple[str, DataFrame, str, str, str | None]]) -> DataFrame:
    """(table_name, rec_id, source, text) of several tables, each (name, table, key, text, source); only texts that can be cases."""
    rows = None
    for name, df, key, text, source in parts:
        part = df.select(F.lit(name).alias("table_name"), df[key].cast("long").alias("rec_id"), (df[source].cast("string") if source else F.lit(None).cast("string")).alias("source"), df[text].alias("text"))
        part = part.where(F.col("rec_id").isNotNull() & F.col("text").rlike(r"[^\x00-\x7F]"))
        rows = part if rows is None else rows.unionAll(part)
    return rows


EXPECTED = T.StructType([T.StructField("kind", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("c", T.StringType()), T.StructField("n", T.DoubleType())])
#: Under this name stand the words that no known cipher reads.
UNKNOWN = "?"


@lru_cache(maxsize=KNOWN)
def _facts(word: str) -> tuple[bool, str, str]:
    """(malformed, core, script of the letters outside ASCII if the core has nothing but letters and they are of one of the three)."""
    core = core_of(word)
    scripts = {script_of(c) for c in core if c > "\x7f"}
    return malformed(word), core, next(iter(scripts)) if core.isalpha() and len(scripts) == 1 and scripts <= SCRIPTS.keys() else ""


def _expect(model: Model | None, last: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One expectation step over (source, word, n): expected bigrams, words, shares and, in the last, sign pairs of this partition.

    Words that no language writes tell of no language's bigrams as they stand."""
    counts: Counter = Counter()
    pairs: Counter = Counter()
    for batch in batches:
        sources, words = (batch.column(i).dictionary_encode(null_encoding="encode") for i in range(2))
        names, distinct, numbers = sources.dictionary.to_pylist(), words.dictionary.to_pylist(), batch.column(2).to_numpy()
        by_row, of_row = sources.indices.to_numpy(), words.indices.to_numpy()
        if model:
            model.prepare(distinct)
            for source, n in zip(names, np.bincount(by_row, numbers, len(names)).tolist()):
                counts["share", source, "\n", None] += n
        facts = [_facts(w) for w in distinct]
        # a word without readings is itself in every source: it is counted once for all of them
        apart = np.array([bool(model) and (bool(model.readings(w)) or last and odd and LOST not in w) for w, (odd, _, _) in zip(distinct, facts)], bool)
        whole = np.bincount(of_row, numbers, len(distinct))
        plain = [i for i in np.flatnonzero(~apart).tolist() if not facts[i][0]]
        if plain:
            codes = code_points("\n" + "\n".join([distinct[i] for i in plain]) + "\n").astype(np.int64)
            keys, places = np.unique(codes[:-1] << 21 | codes[1:], return_inverse=True)
            sums = np.bincount(places, np.repeat(whole[plain], [len(distinct[i]) + 1 for i in plain]), len(keys))
            for key, n in zip(keys.tolist(), sums.tolist()):
                pairs[key] += n
            if model:
                for i, n in zip(plain, whole[plain].tolist()):
                    _, core, script = facts[i]
                    if script:
                        counts["word", script, core, None] += n
        some = np.flatnonzero(apart[of_row])
        for i, at, n in zip(by_row[some].tolist(), of_row[some].tolist(), numbers[some].tolist()):
            source, word, (odd, core, script) = names[i], distinct[at], facts[at]
            weights = model.weights(source, word)
            stays = 1.0 - sum(w for _, w in weights)
            for read, w in [(word, 0.0 if odd else stays), *((r[2], w) for r, w in weights)]:
                if w >= 0.01:
                    framed = f"\n{read}\n"
                    for x, y in zip(framed, framed[1:]):
                        counts["bigram", x, y, None] += n * w
            if script and not odd:
                counts["word", script, core, None] += n * stays
            for r, w in weights:
                if not r[3]:
                    counts["share", source, r[0], None] += n * w
            if last:
                groups = [(r[0], w) for r, w in weights if not r[3] and w > 0.5]
                if not groups and odd and stays > 0.5 and LOST not in word:
                    groups = [(UNKNOWN, stays)]
                for name, w in groups:
                    framed = f"\n{word}\n"
                    for x, y in zip(framed, framed[1:]):
                        counts["pair", source, name, x + y] += n * w
    for key, n in pairs.items():
        counts["bigram", chr(key >> 21), chr(key & 0x1FFFFF), None] += n
    if counts:
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in counts], pa.string()) for i in range(4)), pa.array([float(n) for n in counts.values()], pa.float64())], EXPECTED.names)


class _Language:
    """The letter pairs of one script, ASCII with it, as a matrix of probabilities."""

    def __init__(self, model: Model, script: str):
        letters = sorted(s for s, share in model.base.items() if s > "\x7f" and script_of(s) == script and share >= RARE)
        self.signs = ["\n", *map(chr, range(33, 127)), *letters]
        index = {s: i for i, s in enumerate(self.signs)}
        self.counts = np.zeros((len(self.signs),) * 2)
        for (x, y), n in model.bigrams.items():
            if x in index and y in index:
                self.counts[index[x], index[y]] += n

    def only(self, plain: frozenset[str]) -> _Language:
        """The same with no signs of ASCII but these."""
        made, kept = object.__new__(_Language), [i for i, s in enumerate(self.signs) if s > "\x7f" or s in plain]
        made.signs, made.counts = [self.signs[i] for i in kept], self.counts[np.ix_(kept, kept)]
        made.index = {s: i for i, s in enumerate(made.signs)}
        made.free = np.array([s > "\x7f" for s in made.signs])
        use = made.counts.sum(0) + made.counts.sum(1)
        made.share = use / max(use.sum(), 1e-300)
        made.pairs = made.counts / max(made.counts.sum(), 1e-300) * (1 - SMOOTH) + SMOOTH * np.outer(made.share, made.share)
        return made


def _maximise(counts: np.ndarray, language: _Language, table: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    """(table, nats): EM over P(sign | letter), the letter pairs of the language given, the sign pairs observed."""
    for _ in range(rounds):
        ratio = counts / np.maximum(table.T @ language.pairs @ table, 1e-300)
        table = table * (language.pairs @ table @ ratio.T + language.pairs.T @ table @ ratio)
        table /= np.maximum(table.sum(1, keepdims=True), 1e-300)
    return table, float((counts * np.log(np.maximum(table.T @ language.pairs @ table, 1e-300))).sum())


def decipher(pairs: dict[tuple[str, str], float], model: Model, name: str = UNKNOWN) -> dict[str, str]:
    """The letters that the signs of one source's cipher stand for, where that pays; else none.

    A sign of ASCII stands for itself. For every script of the three, EM starts from the code page
    that comes nearest and, eight times, from the order of frequencies with some chance; a known
    cipher starts from its own page. The result must gain LETTER for each letter that it changes and,
    for an unknown cipher, EVIDENCE over that and words as likely as words are."""
    known, mass = model.by_name.get(name), sum(pairs.values())
    if mass < ENOUGH:
        return {}
    signs = sorted({s for p in pairs for s in p})
    index = {s: i for i, s in enumerate(signs)}
    counts = np.zeros((len(signs),) * 2)
    for (x, y), n in pairs.items():
        counts[index[x], index[y]] += n
    free = [i for i, s in enumerate(signs) if s > "\x7f"]
    if not free or known is None and not any(mass * 0.95 <= sum(n for p, n in pairs.items() if all(s <= "\x7f" or s in code_page(r)[128:] for s in p)) for r in READERS):
        return {}
    use = counts.sum(0) + counts.sum(1)
    best: tuple[float, dict[str, str]] = (0.0, {})
    start = {signs[i]: known.table.get(ord(signs[i]), signs[i]) for i in free} if known else {s: s for s in signs}
    nats = lambda to: sum(n * model.pair(to.get(x, x), to.get(y, y)) for (x, y), n in pairs.items())
    plain = nats(start)
    scripts = {script_of(v) for v in start.values()} & SCRIPTS.keys() if known else SCRIPTS
    for script in sorted(scripts):
        language = model.language(script, frozenset(s for s in signs if s <= "\x7f"))
        letters = np.flatnonzero(language.free & (language.share > 0))
        if not len(letters):
            continue
        fixed = np.zeros((len(language.signs), len(signs)))
        for s, i in index.items():
            if s in language.index and not (s > "\x7f"):
                fixed[language.index[s], i] = 1.0

        def seeded(to: dict[str, str], trust: float) -> np.ndarray:
            table = fixed.copy()
            table[np.ix_(letters, free)] = (1 - trust) / len(free)
            for i in free:
                if (k := language.index.get(to.get(signs[i], ""))) is not None:
                    table[k, i] += trust
            return table / np.maximum(table.sum(1, keepdims=True), 1e-300)

        if known:
            starts = [seeded(start, 0.9)]
        else:
            guesses = [dict(zip(code_page(r)[128:], code_page(w)[128:])) for r in READERS for w in (*WRITERS, *OTHERS) if r != w]
            letters_of = lambda g: sum(use[i] * log(model.base.get(g.get(signs[i], ""), model.rare)) for i in free)
            starts = [seeded(g, 0.9) for g in sorted(guesses, key=letters_of)[-2:]]
            order, by_use = letters[np.argsort(-language.share[letters], kind="stable")], sorted(free, key=lambda i: -use[i])
            chance = np.random.default_rng(0)
            for spread in (4.0, 4.0, 8.0, 8.0, 16.0, 16.0, 16.0, 16.0):
                table, distance = fixed.copy(), np.abs(np.arange(len(order))[:, None] - np.arange(len(by_use))[None, :])
                table[np.ix_(order, by_use)] = (np.exp(-distance / spread) + 1e-3) * chance.uniform(0.2, 1.8, distance.shape)
                starts.append(table / np.maximum(table.sum(1, keepdims=True), 1e-300))
        table = max((_maximise(counts, language, t, 12 if known else 60) for t in starts), key=lambda x: x[1])[0]
        after = (table * language.share[:, None])[letters]
        found = {signs[i]: language.signs[letters[int(after[:, i].argmax())]] for i in free if after[:, i].max() > 0 and (signs[i].isalpha() or not known)}
        if known:
            chosen = dict(start)
            for sign, letter in found.items():
                if letter != start[sign] and script_of(start[sign]) == script and letter not in chosen.values():
                    own, other = {p: n for p, n in pairs.items() if sign in p}, chosen | {sign: letter}
                    if sum(n * (model.pair(other.get(x, x), other.get(y, y)) - model.pair(chosen.get(x, x), chosen.get(y, y))) for (x, y), n in own.items()) > LETTER + EVIDENCE / 10:
                        chosen[sign] = letter
            start = chosen
            continue
        mapped = nats(found)
        gain = mapped - plain - LETTER * sum(k != v for k, v in found.items())
        if gain > max(EVIDENCE, best[0]) and mapped > LIKELY * mass:
            best = (gain, found)
    page = {signs[i]: known.table.get(ord(signs[i]), signs[i]) for i in free} if known else {}
    return {k: v for k, v in start.items() if page[k] != v} if known else best[1]


TABLE_ROW = "source string, cipher string, sign string, letter string"


def learn_tables(pairs: DataFrame, model: Model) -> tuple[dict, dict]:
    """(tables, learned) of the Model from rows (a: source, b: cipher, c: two signs, n): each source's ciphers in one task each.

    A group holds at most the pairs of the signs of a code page or two."""
    shared = pairs.sparkSession.sparkContext.broadcast(model)

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        source, name = pdf["a"].iloc[0], pdf["b"].iloc[0]
        found = decipher({(c[0], c[1]): n for c, n in zip(pdf["c"], pdf["n"])}, shared.value, name)
        return pd.DataFrame([(source, name, k, v) for k, v in found.items()], columns=["source", "cipher", "sign", "letter"], dtype=object)

    tables: dict = defaultdict(dict)
    # few rows and much work: spread by hand, as the size of the rows would put all groups into one task
    spread = pairs.repartition(4 * pairs.sparkSession.sparkContext.defaultParallelism, "a", "b")
    for r in spread.groupBy("a", "b").applyInPandas(each, TABLE_ROW).collect():
        tables[r.source, r.cipher][r.sign] = r.letter
    shared.unpersist()
    learned = {source: Learned("learned", letters) for (source, name), letters in tables.items() if name == UNKNOWN}
    return {k: v for k, v in tables.items() if k[1] != UNKNOWN}, learned


def learn(rows: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of `records`, from all their words."""
    spark = rows.sparkSession
    exploded = rows.select("source", F.explode(words_of(F.col("text"))).alias("word"))
    vocabulary = cut(exploded.groupBy("source", "word").agg(F.count("*").alias("n")).repartition("word").sortWithinPartitions("word"))
    model: Model | None = None
    for left in range(rounds, -1, -1):
        shared = spark.sparkContext.broadcast(model)
        counted = vocabulary.mapInArrow(lambda batches, shared=shared, last=not left: _expect(shared.value, last, batches), EXPECTED).groupBy("kind", "a", "b", "c").agg(F.sum("n").alias("n"))
        counted = cut(counted)
        # what is rare beside its first sign, script or source is left to smoothing or doubt, at every size alike
        kept = counted.where("kind <> 'pair'").withColumn("k", F.coalesce("a", F.lit("\0")))
        totals = kept.groupBy("kind", "k").agg(F.sum(F.when(~((F.col("kind") == "share") & (F.col("b") != "\n")), F.col("n"))).alias("whole"))
        kept = kept.join(totals, ["kind", "k"]).withColumn("part", F.col("n") / F.col("whole"))
        few = kept.where(F.when(F.col("kind") == "bigram", F.col("part") >= RARE).when(F.col("kind") == "word", (F.col("part") >= COMMON) & (F.col("n") >= OFTEN)).otherwise((F.col("part") > MET) & (F.col("b") != "\n")))
        bigrams, shares, words = {}, {}, {}
        totals = {r.a: r.n for r in counted.where("kind = 'share' AND b = '\n'").select("a", "n").toLocalIterator()} if model else {}
        for r in few.select("kind", "a", "b", "n", "part").toLocalIterator():
            if r.kind == "bigram":
                bigrams[r.a, r.b] = r.n
            elif r.kind == "word":
                words[r.b] = r.part
            else:
                shares[r.a, r.b] = r.part
        fitted = Model(bigrams, shares if model else None, words)
        if model and not left:
            fitted.tables, fitted.learned = learn_tables(counted.where("kind = 'pair'"), fitted)
        model = fitted
        shared.unpersist()
    return model


FOUND = T.StructType([T.StructField("table_name", T.StringType()), T.StructField("rec_id", T.LongType())])


def judge(model: Model, source: str | None, words: list[str]) -> dict[str, float]:
    """The ciphers a record's words show, with what they gain beyond doubt; LOST for signs that are gone.

    A valid UTF-8 run speaks for itself. A one-sign cipher needs a word that gains much alone, and
    the sum over the record's different words, case and punctuation aside, must outweigh the doubt."""
    found: dict[str, float] = {}
    gains: dict[str, dict[str, float]] = defaultdict(dict)
    for word in set(words):
        if LOST in word:
            found[LOST] = found.get(LOST, 0.0) + 1
        readings = model.own_readings(source, word)
        if not readings:
            continue
        best = max(readings, key=lambda r: r[1], default=None)
        if best and best[3] and best[1] > RUN_LOSS:
            found[best[0]] = found.get(best[0], 0.0) + best[1]
        elif len(word) > 1 and sum(map(str.isalpha, word)) != 1:
            core = core_of(word)
            for name, gain, _, multi in readings:
                if not multi:
                    gains[name][core] = max(gains[name].get(core, -3.0), gain)
    while gains:
        # the cipher that explains most comes first; another must explain words that it does not
        beyond = {name: sum(of.values()) - model.doubt(source, name) for name, of in gains.items() if of and max(of.values()) > ALONE}
        name = max(sorted(beyond), key=beyond.get, default=None)
        if name is None or beyond[name] <= 0:
            break
        found[name] = beyond[name]
        explained = {core for core, gain in gains.pop(name).items() if gain > 0}
        gains = {other: {core: gain for core, gain in of.items() if core not in explained} for other, of in gains.items()}
    return found


def garbled(rows: DataFrame, model: Model) -> DataFrame:
    """(table_name, rec_id) of the records with a stretch in a wrong encoding; no shuffle but that of distinct.

    `rows` are `records`, or have their words in a column of that name already."""
    words = F.col("words") if "words" in rows.columns else words_of(F.col("text"))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            encoded = lists.values.dictionary_encode()
            distinct = encoded.dictionary.to_pylist()
            model.prepare(distinct)
            telling = np.array([LOST in w or bool(model.readings(w)) for w in distinct], bool)
            marked = telling[encoded.indices.to_numpy()] if distinct else np.zeros(0, bool)
            before = np.concatenate(([0], np.cumsum(marked)))
            own = np.array([s in model.learned for s in batch.column(2).to_pylist()], bool) if model.learned else False
            some = np.flatnonzero((before[offsets[1:]] > before[offsets[:-1]]) | own)
            if not len(some):
                continue
            part = batch.take(pa.array(some))
            names, ids, sources, words = (part.column(i).to_pylist() for i in range(4))
            kept = [i for i in range(len(ids)) if judge(model, sources[i], words[i])]
            yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in kept], pa.string()), pa.array([ids[i] for i in kept], pa.int64())], FOUND.names)

    return rows.select("table_name", "rec_id", "source", words.alias("words")).mapInArrow(run, FOUND).distinct()


RESTORED = T.StructType([*FOUND.fields, T.StructField("restored", T.StringType()), T.StructField("ciphers", T.ArrayType(T.StringType())), T.StructField("lost_signs", T.IntegerType())])
_split = re.compile(r"([ \t\n\r\f]+)")


def restore_text(model: Model, source: str | None, text: str) -> tuple[str, list[str], int]:
    """(text as written, ciphers undone, signs that are lost)."""
    parts = _split.split(text)
    found = judge(model, source, [p for p in parts if p and not p.isascii()])
    if not found:
        return text, [], 0
    by_name = model.by_name | ({c.name: c} if (c := model.learned.get(source)) else {})
    # a one-sign cipher is a translate() table: the learned letters over the code page's
    tables = {n: by_name[n].table | {ord(k): v for k, v in model.tables.get((source, n), {}).items()} for n in found.keys() - {LOST} if not by_name[n].multi}
    for i, part in enumerate(parts):
        if part.isascii():
            continue
        options = [(r[1], r[2]) for r in model.readings(part) if r[3] and r[0] in found]
        plain = model.standing(part)
        for name, letters in tables.items():
            # where a cipher is known to have been at work, a word need not be unlikely to be undone
            if by_name[name].undo(part) is not None and not _two_scripts(read := part.translate(letters)) and (gain := model.likelihood(read) - plain) > -1.0:
                options.append((gain, read))
        if options:
            parts[i] = max(options)[1]
    return "".join(parts), sorted(found.keys() - {LOST}), text.count(LOST)


def restored(rows: DataFrame, model: Model) -> DataFrame:
    """(table_name, rec_id, restored, ciphers, lost_signs) of the garbled records, one row per distinct record text."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for name, key, source, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                fixed, found, lost = restore_text(shared.value, source, text)
                if found or lost:
                    out.append((name, key, fixed, found, lost))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 5, [pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32()])], RESTORED.names)

    return rows.select("table_name", "rec_id", "source", "text").mapInArrow(run, RESTORED).distinct()
