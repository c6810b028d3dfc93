import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark import config
from foliospark.functions import images
from foliospark.functions import text as X
from foliospark.operators import pages


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


def test_settings_merge_and_load(tmp_path):
    base, over = {"a": {"b": 1, "c": [1]}, "d": 2}, {"a": {"c": [2]}, "e": 3}
    assert config.merge(base, over) == {"a": {"b": 1, "c": [2]}, "d": 2, "e": 3} and base["a"]["c"] == [1]
    (tmp_path / "publishers").mkdir()
    (tmp_path / "mapping.default.json").write_text('{"docbook": {"root": "book"}}')
    (tmp_path / "publishers" / "pub.json").write_text('{"docbook": {"root": "article"}}')
    assert config.load(tmp_path, "pub")["docbook"]["root"] == "article"
    assert config.load(tmp_path, "none")["docbook"]["root"] == "book" and config.load()["docbook"]["root"] == "book"


@pytest.mark.parametrize("given_text, want", [("A\tB\nC  D", "A B C D"), (" x　y\x1cz", " x y z"), ("", ""), (None, None)])
def test_collapse(spark, given_text, want):
    assert one(spark, given_text, X.collapse) == want


@pytest.mark.parametrize("given_text, want", [("NA-\nTO", "NA-TO"), ("Na-\nTO", "NaTO"), ("über-\nall x", "überall x"), ("a-\nb-\nc", "ab-\nc"), ("a -\nb", "a -\nb"), (None, None)])
def test_dehyphenate(spark, given_text, want):
    assert one(spark, given_text, X.dehyphenate) == want


def test_normalised_events(spark):
    r = one(spark, "a  b", X.normalized)
    assert r.text == "a b" and [e.rule for e in r.events] == ["collapse_internal_whitespace"]
    r = one(spark, "co-\nop", lambda c: X.normalized(c, False, True))
    assert r.text == "coop" and r.events[0].before == "co-\nop"
    assert one(spark, "a b", X.normalized).events == []


@pytest.mark.parametrize("n, want", [(0, "0B"), (1023, "1023B"), (1280, "1.2KB"), (1536, "1.5KB"), (1048576, "1.0MB")])
def test_file_size(spark, n, want):
    assert one(spark, n, X.file_size, "long") == want


@pytest.mark.parametrize(
    "line, want",
    [("• one", ("itemized", "one")), ("•", ("itemized", "•")), ("(1) x", ("ordered", "x")), ("a) y", ("ordered", "y")), ("A. Smith", ("ordered", "Smith")), ("1.x", (None, None)), ("word", (None, None))],
)
def test_list_item(spark, line, want):
    r = one(spark, line, lambda c: X.list_item(c, ["•", "-", "—", "–"]))
    assert (r.list_type, r.item) == want


@pytest.mark.parametrize(
    "line, want",
    [("apple, 3, 7–9", ("apple", "3, 7–9", None)), ("pear, see also fruit", ("pear", None, "see also fruit")), ("quince, 4, See apple", ("quince", "4", "See apple")), ("3D printing", ("", "3D printing", None)), ("fig ..... 12", ("fig", "12", None)), ("", ("", None, None))],
)
def test_index_parts(spark, line, want):
    assert tuple(one(spark, line, lambda c: X.index_parts(X.index_text(c)))) == want


def test_names(spark):
    assert one(spark, "978-1 (x)", X.isbn) == "9781x" and one(spark, "--", X.isbn) is None
    assert one(spark, "My Book!", X.basename) == "MyBook" and one(spark, "!!", X.basename) == "book" and one(spark, None, X.basename) == "book"
    assert one(spark, "{urn:x}p", X.local_name) == "p" and one(spark, None, X.local_name) == ""
    assert one(spark, " a\n\tb ", X.xml_space) == "a b"


def test_image_headers():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (120).to_bytes(4, "big") + (60).to_bytes(4, "big")
    gif = b"GIF89a" + (7).to_bytes(2, "little") + (9).to_bytes(2, "little")
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + (33).to_bytes(2, "big") + (44).to_bytes(2, "big") + b"\0" * 8
    assert images.inspect(png) == (120, 60, "PNG") and images.inspect(gif) == (7, 9, "GIF") and images.inspect(jpeg) == (44, 33, "JPEG")
    assert images.inspect(b"", ".tif") == (0, 0, "TIF") and images.inspect(None) == (0, 0, "") and images.inspect(jpeg[:14], ".jpg") == (0, 0, "JPG")


def test_extractions_compared(spark):
    schema = "doc_id long, page_num int, norm_text string, checksum string, has_ocr boolean"
    a = spark.createDataFrame([(1, 1, "x", "s", None), (1, 2, "y", "s", None), (1, 3, " ", "s", None), (1, 4, None, None, None)], schema)
    b = spark.createDataFrame([(1, 1, "x", "s", True), (1, 2, "yy", "t", False), (1, 4, "found", "u", True)], schema)
    assert {r.page_num for r in pages.mismatched_pages(a, b).collect()} == {2, 3}
    assert {r.page_num for r in pages.image_only_pages(a, b).collect()} == {3}
    flags = {r.page_num: (r.flags, r.has_ocr, r.checksum_out) for r in pages.page_quality(a, b).collect()}
    assert flags[1] == ([], True, "s") and flags[2] == (["text_mismatch", "char_count_diff"], False, "t")
    assert flags[3] == (["missing_output_page"], False, "") and flags[4][0] == ["text_mismatch", "char_count_diff"]
    summary = pages.quality_summary(a, b).first()
    assert (summary.total_pages, summary.flagged_pages) == (4, 3) and summary.special_chars == {}
    assert pages.with_ocr_flag(a, pages.image_only_pages(a, b)).where("has_ocr").count() == 1
    none = a.limit(0)
    assert pages.page_quality(none, b).count() == 0 and pages.mismatched_pages(a, none).count() == 4


def test_special_signs_count_twice_where_equal(spark):
    a = spark.createDataFrame([(1, 1, "é—é", "s", False)], "doc_id long, page_num int, norm_text string, checksum string, has_ocr boolean")
    assert pages.quality_summary(a, a).first().special_chars == {"é": 4, "—": 2}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30))
def test_page_ranges(spark, numbers):
    got = pages.page_ranges(spark.createDataFrame([(1, n) for n in numbers], "doc_id long, page_num int")).collect()
    said = set()
    for part in got[0].ranges.split(",") if got else []:
        a, _, b = part.partition("-")
        said |= set(range(int(a), int(b or a) + 1))
    assert said == set(numbers) and (not got or len(got[0].ranges.split(",")) == len([n for n in set(numbers) if n - 1 not in numbers]))


def test_split_pages(spark):
    df = spark.createDataFrame([(1, "a\fb\f"), (2, ""), (3, None)], "d long, t string")
    assert sorted((r.doc_id, r.page_num, r.raw_text) for r in pages.split_pages(df, "d", "t").collect()) == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (2, 1, "")]
    assert pages.split_pages(df, "d", "t", keep_last_empty=False).where("doc_id = 1").count() == 2


def test_strip_is_pythons(spark):
    for text in ("  x ", "\x1c a\x85", "\n", "a"):
        assert one(spark, text, X.strip) == text.strip()
    assert re.match(X.SPACE, " ")
