import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import tokenize as Z

if not os.path.exists(Z.VOCABULARY):
    pytest.skip("no vocabulary", allow_module_level=True)

ENTRIES = Z.read_ranks(Z.VOCABULARY)
ENCODER, DECODER = Z.Encoder(ENTRIES), Z.Decoder(ENTRIES)


@pytest.fixture(scope="module")
def merges():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=Z.PIECES, mergeable_ranks={e: i for i, e in enumerate(ENTRIES)}, special_tokens={})


def ids(text):
    return np.frombuffer(ENCODER.encode(text), "<i4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_as_merges_give_it_and_back(merges, text):
    assert ids(text) == merges.encode_ordinary(text)
    assert DECODER.decode(ids(text)) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdehinorstuw'l .\n1é世-", max_size=200))
def test_text_like_words(merges, text):
    assert ids(text) == merges.encode_ordinary(text)


def test_long_pieces(merges):
    rng = random.Random(5)
    for text in ("a" * 30_000, "ab" * 9_000, "-" * 5_000, " " * 4_000, "".join(rng.choices("abcdef", k=20_000))):
        assert ids(text) == merges.encode_ordinary(text)


def test_special_strings_are_text(merges):
    assert ids("<|endoftext|>") == merges.encode_ordinary("<|endoftext|>") and 50256 not in ids("<|endoftext|>")


def test_remembered_pieces_start_anew(monkeypatch):
    monkeypatch.setattr(Z, "REMEMBERED", 3)
    own = Z.Encoder(ENTRIES)
    assert own.encode("one two three four five one") == ENCODER.encode("one two three four five one") and len(own.known) <= 3


def test_columns(spark):
    df = spark.createDataFrame([(1, "ab ab", "x"), (2, "", "y"), (3, None, "z"), (4, "ab ab", "x"), (None, "q", "")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in Z.encode_column(df, "doc_id", "text").collect()}
    assert got == {1: ids("ab ab"), 2: [], 3: [], 4: ids("ab ab"), None: ids("q")}
    assert {r.doc_id: r.text for r in Z.decode_column(Z.encode_column(df, "doc_id", "text"), "doc_id", "ids").collect()} == {1: "ab ab", 2: "", 3: "", 4: "ab ab", None: "q"}
    assert Z.encode_column(df.limit(0), "doc_id", "text").collect() == []
