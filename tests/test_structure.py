"""Lines, labels, trees, packaging: small documents made in place."""

import io
import zipfile
from xml.etree import ElementTree as ET

import pytest

from foliospark.operators.lines import assemble_lines, body_sizes, containers, islands, paragraphs, with_font_size
from foliospark.plans import label as L
from foliospark.plans import package, tree
from foliospark.sources.markup import html_to_docbook, layout_tables, parse_epub, parse_layout
from pyspark.sql import functions as F

MARKERS = ["•", "-", "—", "–"]
NO_MEDIA = "doc_id long, ref string, content binary"


def layout(pages, fonts={"b": 10, "h": 20, "s": 12}):
    specs = "".join(f'<fontspec id="{k}" size="{v}" family="x"/>' for k, v in fonts.items())
    body = ""
    for number, entries in pages:
        inner = "".join(f'<text top="{t}" left="{x}" width="50" height="{h}" font="{f}">{s}</text>' if f != "img" else f'<image top="{t}" left="{x}" width="9" height="9" src="{s}"/>' for t, x, h, f, s in entries)
        body += f'<page number="{number}" width="600" height="800">{specs if not body else ""}{inner}</page>'
    return f"<pdf2xml>{body}</pdf2xml>".encode()


def blocks_of(spark, *files):
    entries = parse_layout(spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "doc_id long, content binary"))
    fonts, texts, images = layout_tables(entries)
    return L.label_blocks(assemble_lines(with_font_size(texts, fonts)), images, MARKERS)


def labels(spark, file):
    return [(r.label, r.text) for r in blocks_of(spark, file).sort("block_ord").collect()]


LONG = "Some running text that is long enough to be a sample of the body"


def test_lines_join_by_their_first_nodes_top(spark):
    # 1, 2.5, 4: the second joins the first, the third is too far from the first
    rows = [(1, 0, i, 1, 600.0, 800.0, t, 10.0 * i, 5.0, 8.0, "f", "", s) for i, (t, s) in enumerate([(1.0, "A"), (2.5, "B"), (4.0, "C"), (50.0, " ")])]
    nodes = spark.createDataFrame(rows, "doc_id long, page_ord int, node_ord int, page_num int, page_width double, page_height double, top double, left double, width double, height double, font_id string, size string, content string")
    fonts = spark.createDataFrame([(1, "f", "11", 0), (1, "f", "12", 1)], "doc_id long, font_id string, size string, ord int")
    lines = assemble_lines(with_font_size(nodes, fonts)).sort("line_ord").collect()
    assert [(r.text, r.font_size) for r in lines] == [("A B", 12.0), ("C", 12.0)]


def test_a_spec_without_size_is_zero_and_a_missing_one_leaves_the_nodes(spark):
    rows = [(1, "f", "9"), (1, "g", "9"), (1, None, None)]
    nodes = spark.createDataFrame(rows, "doc_id long, font_id string, size string")
    fonts = spark.createDataFrame([(1, "f", None, 0)], "doc_id long, font_id string, size string, ord int")
    assert sorted(str(r.font_size) for r in with_font_size(nodes, fonts).collect()) == ["0.0", "0.0", "9.0"]


def test_body_size_falls_back(spark):
    rows = [(1, "short", 8.0), (1, LONG, 10.0), (1, LONG, 12.0), (2, "short", 7.0), (3, "x", 0.0)]
    got = {r.doc_id: r.body for r in body_sizes(spark.createDataFrame(rows, "doc_id long, text string, font_size double")).collect()}
    assert got == {1: 11.0, 2: 7.0, 3: 12.0}


def test_title_run_stops_before_contents(spark):
    file = layout([(1, [(100, 50, 20, "h", "Great Adventures"), (125, 50, 20, "h", "A Journey"), (300, 50, 10, "b", LONG)]), (2, [(100, 50, 20, "h", "Table of Contents"), (200, 50, 10, "b", LONG)])])
    assert labels(spark, file)[0] == ("book_title", "Great Adventures\nA Journey") and ("toc", "Table of Contents") in labels(spark, file)


def test_keyword_chapters_demote_other_headings(spark):
    file = layout([(3, [(100, 50, 20, "h", "Chapter 1"), (200, 50, 10, "b", LONG), (300, 50, 20, "h", "Glossary"), (400, 50, 10, "b", LONG)]), (4, [(600, 50, 20, "h", "A new chapter begins"), (700, 50, 10, "b", LONG)])])
    assert [x for x in labels(spark, file) if x[0] in ("chapter", "section")] == [("chapter", "Chapter 1"), ("section", "Glossary"), ("chapter", "A new chapter begins")]


def test_without_keyword_headings_are_chapters(spark):
    file = layout([(3, [(100, 50, 20, "h", "One"), (200, 50, 10, "b", LONG), (300, 50, 20, "h", "Two"), (400, 50, 10, "b", LONG)])])
    assert [x[0] for x in labels(spark, file)] == ["chapter", "para", "chapter", "para"]


def test_index_mode_keeps_letters_and_ends_at_a_heading(spark):
    file = layout([(3, [(100, 50, 20, "h", "Index"), (200, 50, 20, "h", "A"), (250, 50, 10, "b", LONG + ", 3"), (400, 50, 20, "h", "Afterword"), (500, 50, 10, "b", LONG)])])
    # the letter has the heading's size, thus belongs to its run; one on its own is a paragraph
    assert [x[0] for x in labels(spark, file)] == ["chapter", "para", "chapter", "para"]
    file = layout([(3, [(100, 50, 20, "h", "Index"), (200, 50, 10, "b", LONG), (300, 50, 20, "h", "B"), (350, 50, 10, "b", LONG)])])
    assert labels(spark, file)[2] == ("para", "B")


def test_tables_lists_captions_figures_and_footers(spark):
    rows = [(200 + 12 * i, x, 10, "b", f"c{i}{x}") for i in range(3) for x in (50, 200)]
    file = layout([(3, [(50, 50, 10, "b", "12"), (100, 50, 10, "b", LONG), *rows, (206, 60, 0, "img", "gone.png"), (400, 50, 10, "b", "• item"), (430, 50, 10, "b", "1. first"), (460, 50, 10, "b", "Figure 3 shows"), (500, 60, 0, "img", "kept.png"), (600, 50, 10, "b", "Copyright 2020")])])
    got = labels(spark, file)
    assert got == [("para", LONG), ("table", "c050 | c0200\nc150 | c1200\nc250 | c2200"), ("list_item", "item"), ("list_item", "first"), ("caption", "Figure 3 shows"), ("figure", "")]


def test_documents_do_not_mix_and_bad_files_are_reported(spark):
    files = [layout([(1, [(400, 50, 10, "b", LONG + str(i))])]) for i in range(5)]
    assert blocks_of(spark, *files).groupBy("doc_id").count().where("count = 1").count() == 5
    assert parse_layout(spark.createDataFrame([(1, bytearray(b"<a>")), (2, None)], "doc_id long, content binary")).where("kind = 'error'").count() == 2


def test_paragraphs_by_gap(spark):
    rows = [(1, 1, i, t, x, 10.0, f"l{i}") for i, (t, x) in enumerate([(10.0, 50.0), (22.0, 50.0), (80.0, 50.0), (92.0, 150.0), (104.0, 50.0)])]
    got = paragraphs(spark.createDataFrame(rows, "doc_id long, page_num int, o int, top double, left double, height double, text string"), ["page_num", "o"]).sort("para").collect()
    assert [r.text for r in got] == ["l0\nl1", "l2", "l3", "l4"]


def test_islands_and_containers(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b", "a"])], "d long, o int, v string")
    assert [r.island for r in islands(df, ["d"], ["o"], F.col("v")).sort("o").collect()] == [1, 1, 2, 2, 3, 4]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(["para", "section", "chapter", "section", "para", "index", "para", "section", "chapter", "para"])], "d long, o int, v string")
    assert [r.container for r in containers(df, ["d"], ["o"], F.col("v")).sort("o").collect()] == ["root", "section2", "chapter3", "section4", "section4", "index6", "index6", "index6", "chapter9", "chapter9"]


def block(i, label, text="", left=100.0, **more):
    return {"doc_id": 1, "block_ord": i, "label": label, "text": text, "page_num": 1, "top": 0.0, "left": left, "width": 1.0, "height": 1.0, "font_size": 10.0, "rows": None, "src": None, "list_type": None, "chapter_role": None} | more


def element(spark, blocks, root="book"):
    df = spark.createDataFrame([tuple(b[c] for c in L.COLUMNS) for b in blocks], L.BLOCK)
    nodes = tree.build_tree(df, root).collect()
    return tree.element_of([(r.node_id, r.parent_id, r.ord, r.tag, r.text, r.attrs) for r in nodes])[0]


def test_structured_index(spark):
    lines = [("A", 100.0), ("apple, 3, 7", 105.0), ("green, 4", 130.0), ("pear, see fruit", 105.0), ("12", 105.0)]
    root = element(spark, [block(0, "chapter", "Index", chapter_role="index"), *(block(i + 1, "para", t, x) for i, (t, x) in enumerate(lines)), block(9, "chapter", "After"), block(10, "para", "text")])
    index = root.find("index")
    assert index.findtext("title") == "Index" and [d.findtext("title") for d in index.findall("indexdiv")] == ["A"]
    apple, pear = index.findall("indexdiv/indexentry")
    assert (apple.findtext("primaryie"), apple.findtext("seeie")) == ("apple", "3, 7") and apple.findtext("secondaryie/secondaryie") == "green" and apple.findtext("secondaryie/seeie") == "4"
    assert pear.findtext("seealsoie") == "see fruit" and pear.findtext("seeie") == "12" and root.find("chapter").findtext("para") == "text"


def test_captions_before_and_after(spark):
    root = element(spark, [block(0, "chapter", "C"), block(1, "caption", "Figure 1"), block(2, "caption", "more"), block(3, "figure", src="a.png"), block(4, "figure", src="b.png"), block(5, "caption", "Figure 2"), block(6, "caption", "lone"), block(7, "caption", "Figure 9"), block(8, "para", "p"), block(9, "caption", "end")])
    chapter = root.find("chapter")
    assert [f.findtext("caption") for f in chapter.findall("figure")] == ["Figure 1 more", "Figure 9"]
    assert [p.text for p in chapter.findall("para")] == ["p", "end"]


def test_lists_sections_tables_notes(spark):
    root = element(spark, [block(0, "book_title", "T"), block(1, "section", "S0"), block(2, "chapter", "C"), block(3, "list_item", "a", list_type="itemized"), block(4, "list_item", "b", list_type="itemized"), block(5, "list_item", "c", list_type="ordered"), block(6, "section", "S"), block(7, "table", "x", rows=[["1", "2"], ["3", "4"]]), block(8, "footnote", "n"), block(9, "odd", "o"), block(10, "para", "  ")])
    assert root.findtext("title") == "T" and root.find("sect1").findtext("title") == "S0"
    chapter = root.find("chapter")
    assert [c.tag for c in chapter] == ["title", "itemizedlist", "orderedlist", "sect1"] and len(chapter.find("itemizedlist")) == 2
    inner = chapter.find("sect1")
    assert [c.tag for c in inner] == ["title", "informaltable", "footnote", "para"] and inner.find("informaltable/tgroup").get("cols") == "2"


def nodes_of(spark, xml, doc=1):
    return spark.createDataFrame(tree.rows_of(doc, ET.fromstring(xml)), tree.NODE)


def test_info_is_injected_once(spark):
    got = lambda xml: tree.with_info(nodes_of(spark, xml))
    made = got("<book><title> My\n Title </title><chapter/></book>")
    assert [r.text for r in made.where("node_id = -1").collect()] == ["My Title"]
    assert got("<book><para/></book>").where("node_id = -1").first().text == "Untitled Book"
    assert got("<article><title>x</title></article>").where("tag = 'bookinfo'").count() == 0
    assert got("<book><bookinfo/></book>").where("tag = 'bookinfo'").count() == 1
    assert got("<book><info/></book>").where("tag = 'bookinfo'").count() == 2


def test_parts(spark):
    df = nodes_of(spark, "<book><bookinfo/><chapter role='toc'/><chapter><title>One</title></chapter><appendix><title>Appendix c</title></appendix><chapter><title> INDEX </title></chapter><preface/></book>")
    got = [(r.entity, r.filename, r.kind, r.title, r.section_type) for r in tree.fragments(df).sort("frag_ord").collect()]
    assert got == [("toc", "TableOfContents.xml", "toc", "Table of Contents", "toc"), ("Ch001", "Ch001.xml", "chapter", "One", "chapter"), ("Ch002", "Ch002.xml", "chapter", "Appendix c", "appendix"), ("Index", "Index.xml", "chapter", "INDEX", "index"), ("Ch003", "Ch003.xml", "chapter", "", "preface")]
    assert tree.contents(tree.fragments(df)).first().entries == ["One (Ch001.xml)", "Appendix c (Ch002.xml)", "INDEX (Index.xml)", "Ch003.xml (Ch003.xml)"]
    assert tree.fragments(nodes_of(spark, "<book><para>x</para></book>")).first().entity == "Ch001"


PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (120).to_bytes(4, "big") * 2 + b"rest"


def bundle(spark, xml, media, **more):
    df = spark.createDataFrame([(1, r, None if c is None else bytearray(c)) for r, c in media.items()], NO_MEDIA)
    made = package.bundles(nodes_of(spark, xml), df, "b.dtd", **more).first()
    return made, zipfile.ZipFile(io.BytesIO(bytes(made.content)))


def test_bundle(spark):
    xml = """<book><bookinfo><title>T</title><imagedata fileref="i/logo.png"/></bookinfo><chapter role="toc"><title>Table of Contents</title><para>old</para></chapter>
    <chapter><title>One</title><figure id="f1"><caption>Figure 1 A</caption><mediaobject><imagedata fileref="i/a.png" alt="An A"/></mediaobject></figure>
    <figure><mediaobject><imagedata fileref="i/none.png"/></mediaobject></figure><figure><caption>two</caption><imagedata fileref="i/b.png"/><imagedata fileref="i/c"/><imagedata fileref="i/gone.png"/></figure>
    <mediaobject><imagedata fileref="i/loose.png" id="q"/></mediaobject><imagedata fileref="x/logo.png"/><imagedata fileref="x/texture.png"/></chapter><index><title>Index</title></index></book>"""
    media = {"i/logo.png": PNG, "i/a.png": PNG, "i/none.png": PNG, "i/b.png": PNG, "i/c": PNG, "i/gone.png": b"", "i/loose.png": PNG, "x/texture.png": PNG}
    made, z = bundle(spark, xml, media, instructions=[("xml-stylesheet", 'href="s.css"')], assets={"s.css": b"x"})
    P = "media/Book_Images/"
    assert made.files == ["Book.xml", "TableOfContents.xml", "Ch001.xml", "Index.xml", "media/", P, P + "Chapters/", P + "Shared/", P + "Metadata/", P + "Chapters/Ch0001f01.png", P + "Chapters/Ch0001f02a.png", P + "Chapters/Ch0001f02b.jpg", P + "Chapters/Ch0001f03.png", P + "Metadata/image_catalog.xml", P + "Metadata/image_manifest.csv", P + "Shared/logo.png", "s.css"]
    book = z.read("Book.xml").decode()
    assert '<!ENTITY Ch001 SYSTEM "Ch001.xml">' in book and "&toc;" in book and "<?xml-stylesheet" in book and book.index("&toc;") < book.index("&Ch001;") < book.index("&Index;")
    chapter = z.read("Ch001.xml").decode()
    assert "Ch0001f02a.png" in chapter and "none.png" not in chapter and "texture" not in chapter and "Shared/logo.png" in chapter
    assert "One (Ch001.xml)" in z.read("TableOfContents.xml").decode() and "old" not in z.read("TableOfContents.xml").decode()
    images = ET.fromstring(z.read(P + "Metadata/image_catalog.xml"))
    assert [i.findtext("figure_number") for i in images] == ["1", "2a", "2b", "3"] and [i.findtext("referenced_in_text") for i in images] == ["true", "false", "false", "false"]
    assert images[0].findtext("width") == "120" and images[0].findtext("alt_text") == "An A" and images[3].findtext("caption") == "Figure 1.03 (Unlabeled)"
    assert z.read(P + "Metadata/image_manifest.csv").decode().splitlines()[1] == "Ch0001f01.png,1,1,Figure 1 A,An A,a.png,28B,PNG"


def test_bundle_without_parts_and_repeated_names(spark):
    made, z = bundle(spark, "<book><bookinfo/><para>x</para></book>", {})
    assert made.files[:2] == ["Book.xml", "Ch001.xml"] and "<para>x</para>" in z.read("Ch001.xml").decode()
    made, _ = bundle(spark, "<book><index/><index/></book>", {})
    assert made.files[1:3] == ["Index.xml", "Index_2.xml"]
    made, z = bundle(spark, "<book><chapter><figure><imagedata fileref='a.png'/></figure></chapter></book>", {"a.png": PNG})
    assert len(ET.fromstring(z.read("media/Book_Images/Metadata/image_catalog.xml"))) == 0


def test_html(spark):
    html = "<html><head><style>x</style></head><body><h1> A  b</h1><div>bare<p>one<p>two <b>bold</b> end<ul><li>i<li>j</ul><script>bad()</script><img src='p.png'></div><h2>S</h2><h3>dropped</h3></body>"
    df = spark.createDataFrame([(1, html), (2, None), (3, "<html xmlns='http://www.w3.org/1999/xhtml'><body><p>x</p></body></html>")], "k long, h string")
    rows = html_to_docbook(df, "k", "h").collect()
    made = {d: tree.element_of([(r.node_id, r.parent_id, r.ord, r.tag, r.text, r.attrs) for r in rows if r.doc_id == d])[0] for d in (1, 2, 3)}
    assert [c.tag for c in made[1]] == ["title", "para", "para", "itemizedlist", "mediaobject", "para"]
    assert [p.text for p in made[1].findall("para")] == ["one", "two bold end", "S"] and made[1].findall("para")[2].get("role") == "section"
    assert [p.text for p in made[1].iter("para")][2:4] == ["i", "j"] and len(made[2]) == 0 and made[3].findtext("para") == "x"


def epub(tmp_path=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="old.xhtml"/><item id="a" href="t/a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="nope"/><itemref idref="a"/></spine></package>')
        z.writestr("O/t/a.xhtml", '<html xmlns="http://www.w3.org/1999/xhtml"><body><h1>Second</h1><p>x<i>y</i>z</p><img src="../i/a.png"/></body></html>')
        z.writestr("O/b.xhtml", "<html><body><p>First</p></body></html>")
        z.writestr("O/i/a.png", PNG)
    return out.getvalue()


def test_epub(spark):
    from foliospark.pipeline import convert_epubs

    files = spark.createDataFrame([(1, bytearray(epub())), (2, bytearray(b"no zip"))], "doc_id long, content binary")
    rows = parse_epub(files)
    assert {r.kind: r["count"] for r in rows.groupBy("kind").count().collect()} == {"item": 2, "spine": 2, "missing": 1, "block": 4, "media": 1, "error": 1}
    made = convert_epubs(files)
    assert [r.raw_text for r in made.pages.sort("page_num").collect()] == ["First", "Second", "x y z", ""]
    assert made.bundles.first().files[:2] == ["Book.xml", "Ch001.xml"] and made.errors.count() == 1
    assert all(not r.flags for r in made.quality.collect())
    with pytest.raises(ValueError):
        convert_epubs(files, strict=True)


def test_layout_conversion(spark):
    from foliospark.pipeline import convert_layouts, ocr_requests

    file = layout([(1, [(100, 50, 20, "h", "Chapter 1"), (300, 50, 10, "b", LONG)])])
    layouts = spark.createDataFrame([(1, bytearray(file))], "doc_id long, content binary")
    first = spark.createDataFrame([(1, 1, "a  b"), (1, 2, " "), (1, 3, "c")], "doc_id long, page_num int, raw_text string")
    second = spark.createDataFrame([(1, 1, "a b"), (1, 2, ""), (1, 3, "d")], "doc_id long, page_num int, raw_text string")
    media = spark.createDataFrame([], NO_MEDIA)
    made = convert_layouts(first, second, layouts, media, ocr=True)
    assert {r.page_num for r in made.mismatches.collect()} == {2, 3} and ocr_requests(made).first().ranges == "2"
    assert made.pages.where("has_ocr").count() == 1 and "Ch001.xml" in made.bundles.first().files
    with pytest.raises(ValueError):
        convert_layouts(first, second, layouts, media, strict=True)


def test_classifier_hook(spark):
    df = spark.createDataFrame([tuple(block(0, "para", "x")[c] for c in L.COLUMNS)], L.BLOCK)
    assert L.classify(df).first().classifier_confidence == 1.0
    sure = lambda label, text: F.struct(F.lit("note").alias("label"), F.lit(0.9).alias("confidence"))
    assert L.classify(df, sure).first().classifier_label == "note" and L.classify(df, sure, 0.95).first().classifier_label == "abstain"
