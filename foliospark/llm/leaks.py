"""Evaluation passages that stand in a training corpus.

Every window of WINDOW words of the items and of the corpus gets a SimHash of its words. The
items' fingerprints are cut into RADIUS + 1 blocks; two fingerprints that differ in at most RADIUS
bits agree in one block at least, so looking up each block of a corpus window finds every item
window within the radius. Candidates are verified by the weighted similarity of their five-word
shingles, and for a verbatim passage by the words themselves. Equal windows have equal
fingerprints: no verbatim passage of WINDOW words is missed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.kernels import runs, words

WINDOW, RADIUS, SHINGLE, SIMILARITY = 8, 3, 5, 0.8
#: Bytes of item text that one pass over the corpus takes as its query set; more items make more passes.
PASS_BYTES = 16_000_000


def fingerprints(hashes: np.ndarray, window: int) -> np.ndarray:
    """The SimHash of each `window` consecutive words; of equal votes a bit is set."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1)
    have, votes = 1, bits
    while have * 2 <= window:
        votes = votes[:-have] + votes[have:]
        have *= 2
    while have < window:
        votes = votes[:-1] + bits[have:]
        have += 1
    return np.packbits(votes * 2 >= window, axis=1).view("<u8").ravel()


class Items:
    """The query set: windows of all items, their fingerprints by block, the weights of their shingles."""

    def __init__(self, rows: list[tuple[int, str | None]], window: int = WINDOW, radius: int = RADIUS):
        self.window, self.blocks = window, radius + 1
        self.radius = radius
        index, owners, self.texts = [], [], []
        for item, text in rows:
            _, starts, ends, hashes = words([text or ""])
            if len(hashes) < window:
                continue
            tokens = [text[a:b].lower().replace("ς", "σ") for a, b in zip(starts, ends)]
            for i in range(len(tokens) - window + 1):
                self.texts.append((item, i, tuple(tokens[i : i + window])))
            index.append(fingerprints(hashes, window))
        self.codes = np.concatenate(index) if index else np.zeros(0, np.uint64)
        seen = Counter(s for _, _, t in self.texts for s in set(shingles(t)))
        self.weights = {s: log(1 + len(self.texts) / n) for s, n in seen.items()}
        self.width = 64 // self.blocks
        self.tables = []
        for block in range(self.blocks):
            keys = self._key(self.codes, block)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    def _key(self, codes: np.ndarray, block: int) -> np.ndarray:
        width = self.width if block + 1 < self.blocks else 64 - self.width * block
        return (codes >> np.uint64(self.width * block)) & np.uint64((1 << width) - 1)

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in codes, index of item window) of all pairs within the radius, each once."""
        found = []
        for block, (keys, order) in enumerate(self.tables):
            wanted = self._key(codes, block)
            low = np.searchsorted(keys, wanted, "left")
            some = np.flatnonzero(np.take(keys, low, mode="clip") == wanted) if len(keys) else np.zeros(0, np.int64)
            low = low[some]
            counts = np.searchsorted(keys, wanted[some], "right") - low
            here = np.repeat(some, counts)
            there = order[np.repeat(low - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())]
            close = np.bitwise_count(codes[here] ^ self.codes[there]) <= self.radius
            found.append(np.stack([here[close], there[close]]))
        pairs = np.unique(np.concatenate(found, axis=1), axis=1)
        return pairs[0], pairs[1]

    def similarity(self, a: tuple[str, ...], b: tuple[str, ...]) -> float:
        """Weighted Jaccard similarity of shingles; a shingle of no item weighs as the rarest."""
        a, b, rare = set(shingles(a)), set(shingles(b)), log(1 + len(self.texts))
        weigh = lambda s: sum(self.weights.get(x, rare) for x in s)
        return weigh(a & b) / weigh(a | b)


def shingles(tokens: tuple[str, ...], n: int = SHINGLE) -> list[tuple[str, ...]]:
    return [tokens[i : i + n] for i in range(len(tokens) - n + 1)]


def _passes(items: DataFrame, key: str, text: str, budget: int) -> Iterator[list[tuple[int, str]]]:
    """The items in query sets of bounded size."""
    chosen = items.where(items[text].isNotNull() & items[key].isNotNull()).select(items[key].cast("long").alias("k"), items[text].alias("t")).distinct()
    total = chosen.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = ceil(total / budget)
    for i in range(n):
        part = chosen if n == 1 else chosen.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == i)
        yield [(r.k, r.t) for r in part.sort("k", "t").toLocalIterator()]


HIT = T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "doc_id", "item_word", "doc_word")] + [T.StructField("exact", T.BooleanType()), T.StructField("similarity", T.DoubleType())])


def window_hits(corpus: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, radius: int = RADIUS, similarity: float = SIMILARITY, budget: int = PASS_BYTES) -> DataFrame:
    """(item_id, doc_id, item_word, doc_word, exact, similarity) of every pair of like windows.

    item_word and doc_word count the words before the windows. Each corpus text is read once a
    pass where it lies: no shuffle. A pass takes at most about `budget` bytes of items, and there
    are as many passes as the items need. Null, empty and short texts have no window, thus no row;
    rows with a null id are left out; repeated rows give repeated hits."""
    spark, hits = corpus.sparkSession, None
    source = corpus.select(corpus[doc].cast("long").alias("k"), corpus[text].alias("t")).where(F.col("k").isNotNull() & (F.length("t") >= 2 * window - 1))
    for rows in _passes(items, item, item_text, budget):
        shared = spark.sparkContext.broadcast(Items(rows, window, radius))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out = [x for first, part in runs(texts) for x in _hits(shared.value, ids[first : first + len(part)], part, similarity)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [*[pa.int64()] * 4, pa.bool_(), pa.float64()])], HIT.names)

        found = source.mapInArrow(run, HIT)
        hits = found if hits is None else hits.unionAll(found)
    return spark.createDataFrame([], HIT) if hits is None else hits


def _hits(items: Items, ids: list[int], texts: list[str], similarity: float) -> Iterator[tuple]:
    index, starts, ends, hashes = words(texts)
    codes = fingerprints(hashes, items.window)
    if not len(codes) or not len(items.codes):
        return
    within = np.flatnonzero(index[: len(codes)] == index[items.window - 1 :])
    here, there = items.near(codes[within])
    if not len(here):
        return
    here, joined = within[here], "\n".join(texts)
    firsts = np.searchsorted(index, np.arange(len(texts)))
    for w, i in zip(here.tolist(), there.tolist()):
        tokens = tuple(joined[a:b].lower().replace("ς", "σ") for a, b in zip(starts[w : w + items.window].tolist(), ends[w : w + items.window].tolist()))
        item, place, own = items.texts[i]
        exact = tokens == own
        like = 1.0 if exact else items.similarity(tokens, own)
        if like >= similarity:
            text = int(index[w])
            yield item, ids[text], place, w - int(firsts[text]), exact, like


def leaked_pairs(hits: DataFrame) -> DataFrame:
    """(item_id, doc_id): the distinct pairs with a verbatim window."""
    return hits.where("exact").select("item_id", "doc_id").distinct()


def leak_report(hits: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per pair: how many of the item's words are covered by like windows, and where in the document."""
    covered = F.explode(F.sequence("item_word", F.col("item_word") + (window - 1))).alias("word")
    spans = hits.groupBy("item_id", "doc_id").agg(F.count("*").alias("windows"), F.min("doc_word").alias("first_word"), (F.max("doc_word") + window - 1).alias("last_word"), F.max("exact").alias("verbatim"))
    counts = hits.select("item_id", "doc_id", covered).groupBy("item_id", "doc_id").agg(F.countDistinct("word").alias("item_words"))
    return spans.join(counts, ["item_id", "doc_id"])
