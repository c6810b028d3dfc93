"""Prose from scanned pages made into running paragraphs.

A page's lines are first freed of running headers and page numbers and cut into paragraphs by
dynamic programming over the gaps between lines. Each paragraph is then a stream of tokens without
lines, decoded in one pass: the cheapest way to read it as words, where a word may be one token,
several single letters run together, two halves of a hyphenated word, two words that a token has
swallowed, and where signs may stand for the letters they are misread from. Costs come from how
many pages of the whole corpus hold a word, and from the letter pairs of those words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.quality import COMMON_PAGES, figures, kind, sized, word_shares

#: A word is in the lexicon if one page in so many of its language has it, five pages at least; as a page has few
#: hundred words, the lexicon has a bound that does not depend on the corpus.
LEXICON_PAGES, LEXICON_LEAST = 250, 5
#: Pages that shares of pages are told in, whatever the corpus has.
SCALE = 10_000
#: What a sign is misread from.
CONFUSIONS = {"0": "oοо", "1": "liι", "|": "iιlі", "!": "iι", "2": "z", "3": "зeε", "4": "чa", "5": "sς", "6": "bбσ", "7": "tτт", "8": "b", "9": "g"}
#: Letters read for letters.
PAIRS = {"c": "e", "rn": "m"}
HYPHENS = "-‐¬"
CHANGE, JOIN, HALVES, CUT, UNKNOWN, PER_LETTER = 3.0, 0.4, 1.0, 15.0, 12.0, 1.2
#: A letter read for another is only believed if the word it makes has so many times the pages.
RATIO = 25
SPACED = 4
REMEMBERED = 200_000
PLAIN = frozenset(".,;:!?…\"'()[]“”„‘’«»—–-‐¬")

_number = re.compile(r"[\s\-–—·•.\[\]()|�]*(?:\d{1,4}|[ivxlc]{1,7}|[IVXLC]{1,7})[\s\-–—·•.\[\]()|�]*")
_edge_number = re.compile(r"^\s*(?:\d{1,4}|[ivxlc]+)\s+(?=\S)|(?:\s*\|\s*|\s{3,})(?:\d{1,4}|[ivxlc]+)\s*$|\s+\d{1,4}\s*$")
_token = re.compile(r"\S+")
_core = re.compile(r"^[^\w|!]*(.*?)[^\w|]*$", re.S)


class Lexicon:
    """Pages per word, and the letter pairs of the words."""

    def __init__(self, pages: dict[str, float], total: int):
        self.pages, self.total = pages, max(total, 1)
        self.read: dict[str, tuple[str, float, str, bool]] = {}
        self.pairs, self.firsts = Counter(), Counter()
        for word, n in pages.items():
            framed = f"^{word}$"
            for a, b in zip(framed, framed[1:]):
                self.pairs[a, b] += n
                self.firsts[a] += n

    def cost(self, word: str) -> float:
        """Nats of a word: its share of pages, else its letters."""
        low = word.lower()
        if (n := self.pages.get(low)) is not None:
            return log((self.total + 1) / n) + 1.0
        return UNKNOWN + PER_LETTER * len(low)

    def shape(self, word: str) -> float:
        """Nats of a word's letters by the pairs they make."""
        framed, total = f"^{word.lower()}$", 0.0
        for a, b in zip(framed, framed[1:]):
            total -= log((self.pairs[a, b] + 0.05) / (self.firsts[a] + 5.0))
        return total


def is_code(core: str) -> bool:
    """A code such as that of a plate: capitals and digits, few letters."""
    letters = [c for c in core if c.isalpha()]
    return not letters or (len(letters) <= 3 and all(c.isupper() for c in letters)) or "(cid:" in core


def corrected(core: str, lexicon: Lexicon, whole: bool = True) -> tuple[str, int]:
    """(word, changes) of the cheapest reading of a token's signs; (core, 0) if it has none.

    Letters read for letters are only looked for in a `whole` word, with plain punctuation around."""
    signs = [i for i, c in enumerate(core) if c in "0123456789" or c == "|" or (c == "!" and i + 1 < len(core) and core[i + 1].isalpha())]
    if signs and any(c.isalpha() for c in core) and not is_code(core):
        script = next((unicodedata.name(c, "").split()[0] for c in core if c.isalpha()), "LATIN")
        paths = [("", 0.0)]
        for i, c in enumerate(core):
            options = [c]
            if i in signs:
                options = [x for x in CONFUSIONS[c] if unicodedata.name(x).startswith(script)] or [c]
            paths = sorted(((p + o, lexicon.shape(p + o)) for p, _ in paths for o in options), key=lambda x: x[1])[:8]
        word = min((p for p, _ in paths), key=lambda w: (lexicon.cost(w), lexicon.shape(w), w))
        if core.isupper() or (sum(map(str.isupper, core)) > 1 and core[0].isupper()):
            word = word.upper()
        lone = re.fullmatch(r"\d+\D{1,2}|\D\d+", core) is not None
        changes = sum(a != b for a, b in zip(word, core))
        return (word, changes) if changes and (not lone or word.lower() in lexicon.pages) else (core, 0)
    low = core.lower()
    own = lexicon.pages.get(low, 0)
    if whole and core.isalpha() and len(core) > 3 and own * RATIO < lexicon.total and any(seen in low for seen in PAIRS):
        options = [core[:i] + meant + core[i + len(seen) :] for seen, meant in PAIRS.items() for i in range(len(core)) if core.startswith(seen, i)]
        best = max(options, key=lambda w: (lexicon.pages.get(w.lower(), 0), w), default=None)
        if best is not None and lexicon.pages.get(best.lower(), 0) > RATIO * own:
            return best, 1
    return core, 0


def reading(token: str, lexicon: Lexicon) -> tuple[str, float, str, bool]:
    """(as read, cost, repair, single letter) of a token by itself; remembered, as tokens come again."""
    found = lexicon.read.get(token)
    if found is None:
        core = _core.match(token).group(1)
        at = token.find(core) if core else 0
        before, after = token[:at], token[at + len(core) :]
        word, changes = corrected(core, lexicon, PLAIN.issuperset(before + after))
        cost, repair = lexicon.cost(word) + CHANGE * min(changes, 2) * (word.lower() not in lexicon.pages), "misread" if changes else ""
        text = before + word + after
        if core.isalpha() and len(core) > 7 and not changes and core.lower() not in lexicon.pages:
            for k in range(3, len(core) - 2):
                if core[:k].lower() in lexicon.pages and core[k:] in lexicon.pages and (apart := lexicon.cost(core[:k]) + lexicon.cost(core[k:]) + CUT) < cost:
                    text, cost, repair = before + core[:k] + " " + core[k:] + after, apart, "swallowed"
        if len(lexicon.read) >= REMEMBERED:
            lexicon.read.clear()
        found = lexicon.read[token] = (text, cost, repair, len(token.strip(".,;:!?”“\"'()’")) == 1)
    return found


def decode(tokens: list[tuple[str, bool]], lexicon: Lexicon) -> tuple[list[str], Counter]:
    """(words, repairs) of a paragraph's stream of (token, stands at a line's end): the cheapest reading."""
    n = len(tokens)
    alone = [reading(t, lexicon) for t, _ in tokens]
    single = [r[3] for r in alone]
    if not any(ends and len(t) > 1 and t[-1] in HYPHENS for t, ends in tokens) and not any(all(single[i : i + SPACED]) for i in range(n - SPACED + 1)):
        return [r[0] for r in alone], Counter(r[2] for r in alone if r[2])
    best: list[tuple[float, int, str, str]] = [(0.0, 0, "", "")] + [(float("inf"), 0, "", "")] * n

    def offer(i: int, j: int, cost: float, text: str, repair: str) -> None:
        if best[i][0] + cost < best[j][0]:
            best[j] = (best[i][0] + cost, i, text, repair)

    for i in range(n):
        token, ends = tokens[i]
        text, cost, mend, _ = alone[i]
        offer(i, i + 1, cost, text, mend)
        if single[i] and token[-1:].isalpha():
            j, run = i, ""
            while j < n and single[j] and j - i < 40:
                bare = tokens[j][0]
                run += bare
                j += 1
                if j - i >= SPACED and run.rstrip(".,;:!?”\"')’").isalpha():
                    joined = run.rstrip(".,;:!?”\"')’")
                    offer(i, j, min(lexicon.cost(joined), 2.0 * lexicon.shape(joined)) + JOIN * (j - i), run, "spaced")
                if not bare[-1:].isalpha():
                    break
        if ends and i + 1 < n and len(token) > 1 and token[-1] in HYPHENS and token[-2].isalpha():
            after = tokens[i + 1][0]
            if after[:1].islower() or (token[-2].isupper() and after[:1].isupper()) or after[:1] in "0123456789|!":
                joined = token[:-1] + after
                core = _core.match(joined).group(1)
                at = joined.find(core) if core else 0
                word, changes = corrected(core, lexicon)
                offer(i, i + 2, HALVES + min(lexicon.cost(word), lexicon.cost(_core.match(token[:-1]).group(1)) + lexicon.cost(_core.match(after).group(1)) - 4), joined[:at] + word + joined[at + len(core) :], "hyphen+misread" if changes else "hyphen")
    words, repairs, j = [], Counter(), n
    while j > 0:
        _, i, text, repair = best[j]
        words.append(text)
        repairs.update(r for r in repair.split("+") if r)
        j = i
    return words[::-1], repairs


_not_letter = re.compile(r"[\W\d_]+")


@lru_cache(maxsize=4096)
def letters_of(text: str) -> str:
    """What a title and a header compare by: letters only, compatibility forms and case aside."""
    return _not_letter.sub("", unicodedata.normalize("NFKC", text).casefold())


def is_header(line: str, title: str | None, first: bool) -> bool:
    """A line is the book's title, alone or with a page number; small damage aside.

    Where the title is unknown, a first line of capitalised words with a page number at one end is
    one."""
    size = len(line.strip())
    if title and not first and size > 3 * len(title) + 12:
        return False
    bare = _edge_number.sub("", line).strip(" |·-–—")
    if title and (wanted := letters_of(title)):
        initial = next((c for c in bare if c.isalpha()), "")
        if not first and unicodedata.normalize("NFKC", initial).casefold()[:1] not in (wanted[0], "i", "v", "x"):
            return False
        has = letters_of(bare)
        if has == wanted or letters_of(re.sub(r"\b[ivxlc]+\b", "", bare)) == wanted:
            return True
        return first and 0 < size < 3 * len(title) + 12 and len(has) > 4 and not re.search(r"[.!?;:,]", line) and SequenceMatcher(None, has, wanted, False).ratio() > 0.7
    words = re.findall(r"[^\W\d_]+", bare)
    return first and bare != line.strip() and 1 < len(words) < 7 and not re.search(r"[.!?;:,]", line) and all(w[0].isupper() for w in words)


def paragraphs(lines: list[str]) -> list[list[str]]:
    """Lines in paragraphs: for each gap the cheaper of joining and breaking, with what went before.

    A break costs as such, and more the shorter a paragraph it ends; blank lines, indents, short
    lines and sentence ends speak for it, hyphens and lower case after it against."""
    texts = [(i, line) for i, line in enumerate(lines) if line.strip()]
    if not texts:
        return []
    width = sorted(len(line.rstrip()) for _, line in texts)[len(texts) * 3 // 4]
    indent = min(len(line) - len(line.lstrip()) for _, line in texts)
    joined, broken, back = 0.0, float("inf"), []
    for (i, a), (j, b) in zip(texts, texts[1:]):
        end, begin = a.rstrip(), b.lstrip()
        gain = 6.0 * (j - i > 1) + 3.0 * (len(b) - len(begin) > indent) + 2.0 * (len(end) < 0.75 * width) + 1.5 * (end[-1] in ".!?”\"") - 4.0 * (end[-1] in HYPHENS) - 3.0 * begin[0].islower()
        stay, leave = min(joined, broken), min(joined + 4.0, broken + 5.0) - gain
        back.append((joined <= broken, joined + 4.0 <= broken + 5.0))
        joined, broken = stay, leave
    cuts, state = [], joined > broken
    for k in range(len(back) - 1, -1, -1):
        cuts.append(state)
        state = not back[k][1] if state else not back[k][0]
    out = [[texts[0][1]]]
    for (_, line), cut in zip(texts[1:], cuts[::-1]):
        if cut:
            out.append([line])
        else:
            out[-1].append(line)
    return out


def repair(text: str, title: str | None, lexicon: Lexicon) -> tuple[str, dict[str, int]]:
    """(running paragraphs, repairs by kind) of one page of prose."""
    done: Counter = Counter()
    lines = unicodedata.normalize("NFC", text).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    kept, seen = [], 0
    for line in lines:
        if line.strip():
            seen += 1
            if _number.fullmatch(line):
                done["page_number"] += 1
                continue
            if is_header(line, title, seen <= 2):
                done["header"] += 1
                continue
        kept.append(line)
    out = []
    for paragraph in paragraphs(kept):
        tokens = [(t, k == len(found) - 1) for found in (_token.findall(line) for line in paragraph) for k, t in enumerate(found)]
        words, repairs = decode(tokens, lexicon)
        done.update(repairs)
        out.append(" ".join(words))
    return "\n\n".join(out), dict(done)


def lexicon_of(pages: DataFrame, text: str, books: DataFrame | None = None, book: str = "book_id", pages_per_word: int = LEXICON_PAGES, least: int = LEXICON_LEAST) -> Lexicon:
    """The lexicon of all pages: each word that one page in `pages_per_word` of a language has, with its pages in SCALE."""
    return Lexicon({w: share * SCALE for w, share in word_shares(pages, text, pages_per_word, least, books, book).items()}, SCALE)


DAMAGE = ("page_number", "header", "hyphen", "misread", "spaced")
REPAIRED = T.StructType([T.StructField("page_uid", T.LongType()), T.StructField("repaired", T.StringType()), T.StructField("repairs", T.MapType(T.StringType(), T.IntegerType()))])


def repaired_pages(pages: DataFrame, books: DataFrame, key: str = "page_uid", book: str = "book_id", text: str = "raw_text", norm: str = "norm_text", title: str = "title", only_damaged: bool = False) -> DataFrame:
    """(page_uid, repaired, repairs) of every page of prose, one row per distinct page text.

    The page's kind is that of its `norm` text, of `text` where that is null. Pages that are null,
    blank or not prose have no row; a null title is an unknown one. With `only_damaged`, pages
    without damage have no row and no text is returned. Titles are broadcast if small enough, else
    joined to keys and texts by book; has_ocr is not trusted and not read. Repeated rows give one row."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(lexicon_of(pages, text, books if "lang" in books.columns else None, book))
    threshold = SCALE / COMMON_PAGES
    common = frozenset(w for w, n in shared.value.pages.items() if n >= threshold)
    own = pages.select(pages[key].cast("long").alias("page_uid"), pages[book].alias("b"), pages[text].alias("t"), pages[norm].alias("n")).where(F.col("t").isNotNull())
    named = books.where(books[book].isNotNull()).groupBy(books[book].alias("b")).agg(F.min(books[title]).alias("title"))
    titled = own.where("b IS NOT NULL").join(sized(named), "b", "left").select("page_uid", "t", "n", "title")
    titled = titled.unionByName(own.where("b IS NULL").select("page_uid", "t", "n", F.lit(None).cast("string").alias("title")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        for batch in batches:
            keys, texts, counts = [], [], []
            for uid, t, n, name in zip(*(batch.column(i).to_pylist() for i in range(4))):
                plain = t if n is None else n
                fixed, repairs = repair(t, name, lexicon)
                if (not only_damaged or any(d in repairs for d in DAMAGE)) and kind(plain, figures(plain, common)) == "prose":
                    keys.append(uid)
                    texts.append(None if only_damaged else fixed)
                    counts.append(list(repairs.items()))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(texts, pa.string()), pa.array(counts, pa.map_(pa.string(), pa.int32()))], REPAIRED.names)

    found = titled.mapInArrow(run, REPAIRED)
    return found if only_damaged else found.dropDuplicates(["page_uid", "repaired"])
