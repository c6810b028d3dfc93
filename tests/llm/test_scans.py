import random

import pytest

from foliospark.llm import scans as S

VOCABULARY = "the harbour was north town and which drew them many came with lamp cart few left engine grammar binding figure section letter morning paper printer region signal tissue village weather yellow moment corner gilding gauge".split()
LEXICON = S.Lexicon({w: 50 + 7 * i for i, w in enumerate(VOCABULARY)} | {"a": 900, "i": 300, "o": 200}, 1000)


def sentence(rng, n=12):
    return " ".join(rng.choices(VOCABULARY, k=n)).capitalize() + "."


@pytest.mark.parametrize(
    "text, want, repairs",
    [
        ("the mor-\nning paper", "the morning paper", {"hyphen": 1}),
        ("the mor‐\nning MOR¬\nNING", "the morning MORNING", {"hyphen": 2}),
        ("the h a r b o u r was", "the harbour was", {"spaced": 1}),
        ("the v i l l a g e, and", "the village, and", {"spaced": 1}),
        ("the gau9e and b|nd1ng, f!gure", "the gauge and binding, figure", {"misread": 3}),
        ("the gaugc and grarnmar", "the gauge and grammar", {"misread": 2}),
        ("see plate B12. and H2O, 3D on A4", "see plate B12. and H2O, 3D on A4", {}),
        ("a o i a was", "a o i a was", {}),
        ("the town\n- 12 -\nwas north", "the town was north", {"page_number": 1}),
        ("xvii\nthe town", "the town", {"page_number": 1}),
        ("MY OWN TITLE        12\nthe town", "the town", {"header": 1}),
        ("My own Title | iv\nthe town", "the town", {"header": 1}),
        ("a-b the -\ntown", "a-b the - town", {}),
        ("", "", {}),
    ],
)
def test_repairs(text, want, repairs):
    assert S.repair(text, "My Own Title", LEXICON) == (want, repairs)


def test_unknown_titles():
    assert S.repair("12 GRAND TOWER\nthe town was", None, LEXICON)[1] == {"header": 1}
    assert S.repair("Grand Tower\nthe town was", None, LEXICON)[1] == {}


def test_paragraphs():
    lines = ["The first line of the text that is long", "and goes on to end here.", "", "    A second one begins here and is as long", "as the first."]
    assert [len(p) for p in S.paragraphs(lines)] == [2, 2] and S.paragraphs([]) == [] and S.paragraphs([" ", ""]) == []


def test_damage_is_undone_on_the_whole():
    rng, right, total = random.Random(3), 0, 0
    for _ in range(200):
        text = sentence(rng)
        words, damaged = text.split(), []
        for w in words:
            k = rng.random()
            if k < 0.08 and len(w) > 6:
                w = w[:3] + "-\n" + w[3:]
            elif k < 0.16 and "o" in w:
                w = w.replace("o", "0")
            elif k < 0.2 and len(w) > 4 and w.isalpha():
                w = " ".join(w)
            damaged.append(w)
        fixed, _ = S.repair(" ".join(damaged), None, LEXICON)
        right += sum(a == b for a, b in zip(fixed.split(), words))
        total += len(words)
    assert right > 0.97 * total


def test_pages(spark):
    rng = random.Random(5)
    prose = [" ".join(sentence(rng) for _ in range(6)) for _ in range(40)]
    rows = [(i, 1, t, t) for i, t in enumerate(prose)]
    rows += [(100, 1, prose[0] + "\n- 3 -", None), (100, 1, prose[0] + "\n- 3 -", None), (101, 2, "MY BOOK\n" + prose[1], prose[1]), (102, 9, prose[2].replace("o", "0"), prose[2]), (103, 1, None, None), (104, 1, "", ""), (105, 1, "1. a\n2. b\n3. c\n4. d\n- 7 -", "1. a\n2. b\n3. c\n4. d\n- 7 -"), (106, None, (prose[3] + "\n") * 500 + "mor-\nning", prose[3])]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_uid long, book_id long, raw_text string, norm_text string, title string, repaired string")
    books = spark.createDataFrame([(1, None, "e"), (2, "My Book", "e"), (2, "My Book", "e"), (None, "None", "e")], "book_id long, title string, t string")
    assert {r.page_uid for r in S.repaired_pages(pages, books, only_damaged=True).collect()} == {100, 101, 102, 106}
    full = S.repaired_pages(pages, books)
    assert full.where("page_uid = 100").count() == 1 and full.where("page_uid IN (103, 104, 105)").count() == 0 and full.count() == 44
    assert S.repaired_pages(pages.limit(0), books, only_damaged=True).count() == 0


def test_centred_headers_below_the_second_line():
    assert S.is_header(" " * 40 + "Dune", "Dune", False) and S.is_header("Dune", "Dune", False) and not S.is_header("x" * 60 + " Dune", "Dune", False)


def test_pages_of_other_languages_take_no_word_away(spark):
    rng = random.Random(2)
    small = [(i, 1, sentence(rng, 20) + (" the h a r b o u r was gaugc" if i == 0 else "")) for i in range(30)]
    large = [(1000 + i, 2, "zupa byla dobra " * 5) for i in range(900)]
    books = spark.createDataFrame([(1, "One", "EN"), (2, "Two", "pl")], "book_id long, title string, lang string")
    found = lambda rows: {r.page_uid for r in S.repaired_pages(spark.createDataFrame([(k, b, t, t) for k, b, t in rows], "page_uid long, book_id long, raw_text string, norm_text string"), books, only_damaged=True).collect() if r.page_uid < 1000}
    assert found(small) == found(small + large) == {0}
