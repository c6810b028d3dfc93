import re
import unicodedata as U

from hypothesis import example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliospark.llm import encodings as E
from foliospark.llm import lookalikes as L

SIGNS = "abо аеxс é é ΑAаν vｗ１ﬁ​­ 　\t\n12.,-ñ ñ ж я Ж µ…²"


def script(c):
    n = U.name(c, "").split(" ")[0]
    return n if c.isalpha() and n in L.SCRIPTS else ""


def brute(text):
    for c in text:
        if U.decomposition(c).split(" ")[0] in ("<wide>", "<narrow>", "<compat>", "<font>") and c.isalnum() and c not in L.NOT_ALONE and U.normalize("NFKC", c).isalnum():
            return True
        if U.category(c) == "Cf" or (U.category(c) == "Zs" and c != " "):
            return True
    bare = re.sub("[​­]", "", text)
    return U.normalize("NFC", text) != text or any(len({script(c) for c in w} - {""}) > 1 for w in re.findall(r"[^\W_]+", "".join(c for c in bare if U.category(c)[0] != "M")))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=SIGNS, max_size=25))
def test_suspects_are_those_of_the_definition(text):
    assert bool(L.suspects_in(text)) == brute(text)


@settings(max_examples=600, deadline=None, derandomize=True)
@given(st.text(alphabet=SIGNS, max_size=12))
@example("bνая")
@example("aνе́")
def test_plain_forms_are_stable(word):
    form = L.plain_form(word)
    assert L.plain_form(form) == form and U.normalize("NFC", form) == form


def test_plain_forms():
    pairs = {"wеаvеr": "weaver", "бaкo": "бако", "ｍａｒｇｉｎ": "margin", "ﬁnal": "final", "für": "für", "unv​en": "unven", "ύλλo": "ύλλο", " ": " ", "аbж": "аbж"}
    got = {w: L.plain_form(w) for w in pairs}
    assert {k: v for k, v in got.items() if k != "аbж"} == {k: v for k, v in pairs.items() if k != "аbж"}


def records(spark, rows):
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "k long, t string, word string")
    return E.records([("a", df, "k", "t", None)])


def found(spark, rows):
    r = records(spark, rows)
    return r, L.occurrences(L.suspect_records(r, E.words_of(F.col("text"))))


def test_records_and_unified_texts(spark):
    rows = [(1, "das für für"), (2, "clean é ж"), (3, "a b wеb"), (3, "a b wеb"), (4, None), (5, ""), (6, "x" * 100_000 + "​"), (None, "​"), (7, "аbж")]
    r, occurrences = found(spark, rows)
    assert {x.rec_id for x in occurrences.collect()} == {1, 3, 6, 7}
    texts = {x.rec_id: x.unified for x in L.unified(r, occurrences).collect()}
    assert texts[1] == "das für für" and texts[3] == "a b web" and texts[6] == "x" * 100_000
    assert L.unified(r, occurrences).count() == 4


def test_one_member_stands_for_a_class(spark):
    words = spark.createDataFrame([("wеb",), ("web​",), ("ｗｅｂ",), ("wéb​",), ("wéb",)], "word string")
    got = {r.word: r.canonical for r in L.canonical_words(words.withColumn("around", F.lit("LATIN"))).collect()}
    assert {got[w] for w in ("wеb", "web​", "ｗｅｂ")} == {"web"} and {got["wéb​"], got["wéb"]} == {"wéb"}


def test_empty(spark):
    assert found(spark, [])[1].count() == 0


@settings(max_examples=300, deadline=None, derandomize=True)
@given(st.text(alphabet=SIGNS, max_size=12))
def test_words_of_one_script_keep_it(word):
    own = {s for c in U.normalize("NFKC", word) if (s := script(c))}
    if len(own) < 2:
        assert {s for c in L.plain_form(word) if (s := script(c))} <= own


def test_classes_do_not_cross_scripts(spark):
    words = ["со\u00adр", "co\u00adp", "ρ\u00adον", "сoр", "µ\u00adm", "x²\u00ad", "аbж", "ё\u00ad", "êо"]
    got = {r.word: r.canonical for r in L.canonical_words(spark.createDataFrame([(w, None) for w in words], "word string, around string")).collect()}
    assert got["со\u00adр"] == "сор" and got["co\u00adp"] == "cop" and got["ρ\u00adον"] == "ρον" and got["сoр"] == "сор"
    assert got["µ\u00adm"] == "µm" and got["x²\u00ad"] == "x²" and got["аbж"] is None and got["ё\u00ad"] == "ё" and got["êо"] == "êo"


def test_a_canonical_member_is_no_case(spark):
    r, occurrences = found(spark, [(1, "é ж сор"), (2, "ж сoр"), (3, "со\u00adр")])
    assert {(x.rec_id, x.canonical) for x in occurrences.collect()} == {(2, "сор"), (3, "сор")}


def test_the_text_around_decides_short_words(spark):
    texts = {1: "Schäd für νοn", 2: "λάβά για νoη", 3: "not νοn", 4: "ёж сoр"}
    r, occurrences = found(spark, list(texts.items()))
    assert {x.rec_id: x.canonical for x in occurrences.collect()} == {1: "von", 2: "νοη", 3: "von", 4: "сор"}
