import pytest
from pyspark.sql import functions as F

from foliospark.llm import quality as Q

COMMON = frozenset("the of and to in a that is was it with which on as".split())
PROSE = "The harbour was in the north of the town, and it was that which drew them to it. Many came with a lamp on the cart; few left."
PAGES = {
    "prose": [PROSE, PROSE.replace("e", "Ã©"), PROSE.upper() + " " + PROSE, "    " + PROSE.replace(". ", ".\n\n    ")],
    "list": ["\n".join(f"{i}. Entry number{i} here" for i in range(1, 9)), "\n".join(f"• item {w} thing" for w in "abcdefgh"), "\n".join(f"1.{i} Heading words {'.' * 12} {i * 7}" for i in range(1, 9)), "\n".join(f"word{chr(97 + i)}, {i + 3}, {i + 40}" for i in range(12)), "Anna Berg\nCarl Dorn\nEva Falk\nGero Hahn\nIda Jung\nKurt Lenz", "Berg, A. Title of work: 1955, pp. 52–93\nDorn, C. Another one: 1932, pp. 13–175\nFalk, E. Third work: 1999, pp. 1–9"],
    "table": ["Name Count Share\n" + "\n".join(f"row{i} {i * 37} {i / 7:.1f} n/a" for i in range(8)), "a | b | c\n" + "\n".join(f"x{i} | {i} | {i * i}" for i in range(8)), "Kind Size " + " ".join(f"thing {i * 11} {i * 3.5}" for i in range(10))],
    "junk": ["(cid:99)(cid:157)(cid:5)\n(cid:99)(cid:157)", "&*#\\|~^[+>&|^=^=];*<@\n|/}_#|~%|+&/]]\\+_]:[;", "kmkq mkzzw kjcj dcvvxk xllvgw jnh\nqzj qxlln wklhdpqw rtwg", "26932 64069 44418\n41914 69104 252", "cental galor encon " * 20, "VhIRdpsMmr1cHe1Vh7PJBJKd8ssVo18v44HABBMeUY3p5Pk7eG4"],
    "blank": ["", "  \n\t", " "],
}


@pytest.mark.parametrize("kind, text", [(k, t) for k, texts in PAGES.items() for t in texts])
def test_kinds(kind, text):
    assert Q.kind(text, Q.figures(text, COMMON)) == kind


def test_figures():
    f = Q.figures("One two.\n  three four, five\n  six!", frozenset(["two"]))
    assert (f["lines"], f["words"], f["ended_lines"], f["common_share"]) == (3.0, 6.0, pytest.approx(2 / 3), pytest.approx(1 / 6)) and f["mean_word_length"] == pytest.approx(22 / 6)
    assert set(Q.figures("", COMMON).values()) == {0.0}
    indented = "\n".join(["a", "  b"] * 6)
    assert Q.figures(indented, COMMON)["indent_period"] == 1.0 and Q.figures("a | b\nc | d", COMMON)["delimiter_alignment"] == 1.0


def test_pages(spark):
    rows = [(1, PROSE), (1, PROSE), (2, PAGES["junk"][2]), (3, None), (4, ""), (5, PAGES["list"][0]), (6, (PROSE + " ") * 2000)]
    df = spark.createDataFrame([(k, t, "x", "y") for k, t in rows], "page_uid long, norm_text string, kind string, words string")
    got = Q.page_figures(df)
    assert got.count() == 6 and {r.page_uid: r.kind for r in got.collect()} == {1: "prose", 2: "junk", 3: "blank", 4: "blank", 5: "list", 6: "prose"}
    assert {r.page_uid for r in Q.not_prose(got).collect()} == {2, 5}
    assert Q.page_figures(df.limit(0)).count() == 0


def test_common_words_by_share_of_pages(spark):
    df = spark.createDataFrame([(i, f"The own{'abcdefghij'[i]} word") for i in range(10)], "page_uid long, norm_text string")
    assert Q.common_words(df, pages_per_word=2) == {"the", "word"}


NAMES = ["Anna", "Carl", "Eva", "Gero", "Ida", "Kurt", "Lena", "Otto"]
ENTRIES = [f"{n} was in the {w} town." for n, w in zip(NAMES, ["old", "far", "new", "big", "low", "wet", "dry", "hot"])]


def test_rhythm_and_columns_decide_where_entries_end_in_full_stops():
    kind = lambda lines: Q.kind("\n".join(lines), Q.figures("\n".join(lines), COMMON))
    assert kind(ENTRIES) == "list"
    hanging = [x for n in NAMES for x in (f"{n} was the one that came with the lamp and it", "    was in the cart.")]
    assert kind(hanging) == "list"
    cells = [f"{n}{' ' * (14 - len(n))}{'was with it in the harbour then.' if i % 2 else 'left.'}" for i, n in enumerate(NAMES)]
    assert kind(cells) == "table"
    # the same words as prose: wrapped at a margin, with first lines indented, or in lines of any length
    flowing = " ".join([*ENTRIES, PROSE, PROSE]).split()
    assert kind([" ".join(flowing[i : i + 7]) for i in range(0, len(flowing), 7)]) == "prose"
    assert kind([x for n in NAMES for x in (f"    {n} was the one that came with the lamp and it", "was in the cart.")]) == "prose"
    assert kind([PROSE, "It was so.", PROSE + " " + PROSE, "No.", "That was it, and the cart was in the town.", PROSE, "It is.", PROSE * 2]) == "prose"


def test_alignment_is_of_columns_not_of_numbers():
    ragged, straight = "a  b\nccccc  d\nee  f\nggggggg  h", "a        b\nccccc    d\nee       f\nggggggg  h"
    assert Q.figures(ragged, COMMON)["delimiter_alignment"] == 0.25 and Q.figures(straight, COMMON)["delimiter_alignment"] == 1.0
    assert Q.figures("x\tb\nyyyy\td\nzz\tf", COMMON)["delimiter_alignment"] == 1.0


def test_indents_of_paragraphs_are_no_rhythm():
    lines = [" " * 4 * (i in (0, 7, 11, 20)) + "word" for i in range(24)]
    assert Q.figures("\n".join(lines), COMMON)["indent_period"] < 0.5


def test_pages_of_other_languages_take_no_common_word_away(spark):
    """A small language keeps its words, and its pages their kind, when ten times as many pages of others come."""
    small = [(i, 1, f"Kota byla w domu i nie miala nic {w} oraz tam byla. I nie bylo nic w domu.") for i, w in enumerate("abcdefgh")]
    large = [(100 + i, 2, f"The cart was in the town {i % 7} and it was there. It was not a lamp.") for i in range(400)]
    books = spark.createDataFrame([(1, "PL"), (2, "en"), (None, "xx")], "book_id long, lang string")
    frame = lambda rows: spark.createDataFrame(rows, "page_uid long, book_id long, norm_text string")
    alone, beside = (Q.common_words(frame(r), books=books) for r in (small, small + large))
    assert {"nie", "w", "domu"} <= alone <= beside
    kinds = lambda rows: {r.page_uid: r.kind for r in Q.page_figures(frame(rows), books).where("page_uid < 100").collect()}
    assert kinds(small) == kinds(small + large)
    assert Q.page_figures(frame([(1, None, PROSE), (2, 77, PROSE)]), books).count() == 2


def test_large_sides_are_joined_and_not_broadcast(spark):
    rows = spark.createDataFrame([(i, "x" * 100) for i in range(20)], "k long, t string")
    plan = lambda limit: spark.range(9).join(Q.sized(rows, limit), F.col("id") == F.col("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(10_000) and "strategy=broadcast" not in plan(2_000)
