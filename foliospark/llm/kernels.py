"""Array kernels over the texts of a batch: code points, words, rolling hashes, sliding minima.

Texts are laid end to end with a separator between them and cut into runs of about CHUNK code
points, so that a worker's memory does not follow the batch; a longer text makes a longer run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1_000_000
MULTIPLIER = 0x9E3779B97F4A7C15
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def runs(texts: list[str | None], size: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, texts) of runs of about `size` code points; null is as empty."""
    first, run, total = 0, [], 0
    for i, text in enumerate(texts):
        text = text or ""
        if run and total + len(text) > size:
            yield first, run
            first, run, total = i, [], 0
        run.append(text)
        total += len(text) + 1
    if run:
        yield first, run


def word_table() -> np.ndarray:
    """Whether a code point is a letter or a digit."""
    if "word" not in _tables:
        _tables["word"] = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)
    return _tables["word"]


def lower_table() -> np.ndarray:
    """The lower case of each code point, where that is one code point; the two small sigmas are one."""
    if "lower" not in _tables:
        table = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            if len(low := chr(c).lower()) == 1:
                table[c] = ord(low)
        table[0x3C2] = 0x3C3
        _tables["lower"] = table
    return _tables["lower"]


def mix(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    key = f"powers{base}"
    if key not in _tables or len(_tables[key]) < n:
        powers = np.full(max(n, CHUNK + 2), base, np.uint64)
        powers[0] = 1
        _tables[key] = np.cumprod(powers, dtype=np.uint64)
    return _tables[key][:n]


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    """Sums from which `span_hash` takes the hash of any span of the codes."""
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * _powers(MULTIPLIER, len(codes)), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans, alike for like spans wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _powers(INVERSE, len(sums))[starts])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values, by doubling."""
    have, least = 1, values
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        shift = width - have
        least = np.minimum(least[:-shift], least[shift:])
    return least


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text index, start, end, hash) of every word; starts and ends lie in "\\n".join(texts).

    A word is an unbroken run of letters and digits; its hash is that of its lower case."""
    codes = code_points("\n".join(texts))
    if not len(codes):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    inside = word_table()[codes]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    hashes = span_hash(prefix_sums(lower_table()[codes]), starts, ends)
    firsts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    return np.searchsorted(firsts, starts, "right") - 1, starts, ends, hashes
