"""Encoding of a corpus with a public byte-level BPE vocabulary, and back.

The encoder never runs merges. For each piece of text one Aho-Corasick pass finds every vocabulary
entry at every place; then the longest entry at the current place is taken if it may stand after
the entry before it, else the next shorter one, and where none may, the last entry is taken back.
Whether two entries may stand side by side is a fact of the pair alone: the merges of their
concatenation must not cross the border. These facts are kept in a table that fills as pairs are
met. A place from which the rest cannot be reached is marked once and never tried again, which
bounds the work by the number of matches.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = os.environ.get("FOLIOSPARK_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: how the public vocabularies split text before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces whose ids a worker remembers; beyond it the store starts anew, results stay the same.
REMEMBERED = 400_000
#: Pairs whose compatibility a worker remembers, about 100 bytes each; beyond it the table starts anew.
PAIRS = 1_000_000
#: Pieces longer than this are encoded afresh each time.
LONG_PIECE = 64
NEVER = 1 << 60


def read_ranks(path: str) -> list[bytes]:
    """The entries of a rank file, in order of rank."""
    with open(path, "rb") as lines:
        found = [line.split() for line in lines if line.strip()]
    ranks = {int(rank): base64.b64decode(entry) for entry, rank in found}
    return [ranks[i] for i in range(len(ranks))]


class Encoder:
    """Exact byte-pair encoding by backtracking. Entries must be ranked in the order of the merges."""

    def __init__(self, entries: list[bytes]):
        import ahocorasick
        import regex

        self.entries = entries
        self.ids = {entry: i for i, entry in enumerate(entries)}
        self.pieces = regex.compile(PIECES)
        self.automaton = ahocorasick.Automaton()
        for i, entry in enumerate(entries):
            self.automaton.add_word(entry.decode("latin-1"), (i, len(entry)))
        self.automaton.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self.compatible: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two entries whose merge makes `token`; None for a single byte."""
        if token not in self.halves:
            entry, found = self.entries[token], None
            if len(entry) > 1:
                for cut in range(1, len(entry)):
                    pair = self.ids.get(entry[:cut]), self.ids.get(entry[cut:])
                    if None not in pair and max(pair) < token and self._beside(*pair, before=token):
                        found = pair
                        break
            self.halves[token] = found
        return self.halves[token]

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """The parts of `token` that lie at one of its ends at some time, each with the rank of the merge that ends it."""
        if (token, right) not in self.edges:
            parts, ends, part = [], NEVER, token
            while True:
                parts.append((part, ends))
                if (halves := self._halves(part)) is None:
                    break
                part, ends = halves[right], part
            self.edges[token, right] = parts
        return self.edges[token, right]

    def _beside(self, left: int, right: int, before: int = NEVER) -> bool:
        """No merge of rank under `before` crosses the border of two entries.

        A crossing merge happens if it comes before both parts at the border are merged away; of
        equal merges the left one comes first."""
        for a, a_ends in self._edge(left, True):
            for b, b_ends in self._edge(right, False):
                merged = self.ids.get(self.entries[a] + self.entries[b])
                if merged is not None and merged < before and merged < a_ends and merged <= b_ends and self._is_merge(merged, a, b):
                    return False
        return True

    def _is_merge(self, merged: int, a: int, b: int) -> bool:
        return self._halves(merged) == (a, b)

    def may_follow(self, left: int, right: int) -> bool:
        """The pair table."""
        key = left << 32 | right
        if (known := self.compatible.get(key)) is None:
            if len(self.compatible) >= PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._beside(left, right)
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        if (whole := self.ids.get(data)) is not None:
            return [whole]
        at: list[list[tuple[int, int]]] = [[] for _ in data]
        for end, (token, length) in self.automaton.iter(data.decode("latin-1")):
            at[end + 1 - length].append((length, token))
        # matches come by rising end, so the longest of a place is the last
        size, place, taken = len(data), 0, []
        choice = [len(x) - 1 for x in at]
        dead = bytearray(size + 1)
        while place < size:
            options, k = at[place], choice[place]
            while k >= 0:
                length, token = options[k]
                if not dead[place + length] and (not taken or self.may_follow(taken[-1], token)):
                    break
                k -= 1
            if k >= 0:
                choice[place] = k
                taken.append(token)
                place += length
                if place < size:
                    choice[place] = len(at[place]) - 1
            else:
                dead[place] = 1
                last = len(self.entries[taken.pop()])
                place -= last
                choice[place] -= 1
        return taken

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit numbers."""
        known, found = self.known, []
        for piece in self.pieces.findall(text):
            ids = known.get(piece)
            if ids is None:
                ids = np.asarray(self.encode_bytes(piece.encode("utf-8", "surrogatepass")), "<i4").tobytes()
                if len(piece) <= LONG_PIECE:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = ids
            found.append(ids)
        return b"".join(found)


class Decoder:
    """Ids to text by one table: the bytes of all entries in a row and where each begins."""

    def __init__(self, entries: list[bytes]):
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)
        self.offsets = np.cumsum([0, *map(len, entries)])

    def decode(self, ids) -> str:
        """The text of a list of ids; bytes that are no text become U+FFFD."""
        ids = np.asarray(ids, np.int64)
        if not ids.size:
            return ""
        starts, lengths = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        firsts = np.cumsum(lengths) - lengths
        return self.bytes[np.repeat(starts - firsts, lengths) + np.arange(lengths.sum())].tobytes().decode("utf-8", "replace")


_made: dict[int, object] = {}


def _worker(kind, entries: list[bytes]):
    """One encoder or decoder a worker process, kept between tasks."""
    key = hash((kind.__name__, len(entries), entries[-1]))
    if key not in _made:
        _made[key] = kind(entries)
    return _made[key]


def encode_column(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row of `df`: its text in a public vocabulary, no special tokens.

    A null and an empty text give an empty list; a text of any length is encoded whole. No shuffle:
    each batch is encoded where it is read. The vocabulary (under 1 MB, read by the driver at
    `vocabulary`) is broadcast, so executors need no file of it."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(Encoder, shared.value)
        for batch in batches:
            encoded = [encoder.encode(t) if t else b"" for t in batch.column(1).to_pylist()]
            offsets = np.zeros(len(encoded) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in encoded], out=offsets[1:])
            ids = pa.array(np.frombuffer(b"".join(encoded), "<i4"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), ids)], [key, "ids"])

    return df.select(df[key], df[text]).mapInArrow(run, schema)


def decode_column(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of every row of `df`; null and empty lists give an empty text."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _worker(Decoder, shared.value)
        for batch in batches:
            texts = [decoder.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(df[key], df[ids]).mapInArrow(run, schema)
