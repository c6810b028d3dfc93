"""Files, commands, validation, streams."""

import csv
import json

import pytest
from test_structure import epub, nodes_of

from foliospark import cli, validation
from foliospark.sinks import reports
from foliospark.sources import tools
from foliospark.sources.markup import read_manifest, resolve_media
from foliospark.streaming import filedrop
from pyspark.sql import functions as F

DTD = """
<!ENTITY % on "INCLUDE"> <!ENTITY % off "IGNORE"> <!ENTITY % on "IGNORE"> <!ENTITY % kids "para | list">
<![%on;[ <!ELEMENT book (title, (%kids;)*, end?)> ]]> <![ %off; [ <!ELEMENT book EMPTY> ]]>
<!-- <!ELEMENT para EMPTY> --> <!ELEMENT title (#PCDATA)> <!ELEMENT para (#PCDATA | em)*> <!ELEMENT em (#PCDATA)>
<!ELEMENT list (item)+> <!ELEMENT item (para)> <!ELEMENT end EMPTY>
<!ATTLIST item id ID #REQUIRED> <!ATTLIST em ref IDREF #IMPLIED>
"""


def found(spark, xml):
    return sorted((r.tag, r.rule, r.detail) for r in validation.violations(nodes_of(spark, xml), validation.compile_type(DTD)).collect())


def test_content_models(spark):
    assert found(spark, "<book><title>t</title><para>a<em ref='i'>b</em>c</para><list><item id='i'><para/></item></list><end/></book>") == []
    bad = found(spark, "<book><para/><title>t</title>text<list/><list><item><para/></item><item id='x'><para/></item><item id='x'><para><em ref='y'/></para></item></list><odd/></book>")
    assert ("book", "content_model", "para title list list odd") in bad and ("list", "content_model", "") in bad and ("item", "missing_attribute", "id") in bad
    assert ("item", "duplicate_id", "x") in bad and ("em", "unknown_idref", "y") in bad and ("odd", "unknown_element", "") in bad


def test_type_from_files(tmp_path):
    (tmp_path / "inner.mod").write_text("<!ELEMENT p (#PCDATA)>")
    kind = validation.compile_type('<!ENTITY % inner SYSTEM "inner.mod"> %inner; <!ELEMENT d (p+)>', tmp_path)
    assert kind.models == {"p": "", "d": "((?:p )+)"} or kind.models["d"].count("p ") == 1
    assert validation.resolve("inner.mod", tmp_path) == str(tmp_path / "inner.mod") and validation.resolve("/a/b", tmp_path) == "/a/b" and validation.resolve("none", tmp_path) == "none"


def test_manifests(spark, tmp_path):
    jobs = [{"type": "epub", "input": "a", "out": "b", "publisher": "p", "ocr_on_image_only": True}]
    for name, content in (("a.json", json.dumps(jobs)), ("b.json", json.dumps({"jobs": jobs})), ("c.csv", "type,input,out,publisher,ocr_on_image_only\nepub,a,b,p,true\n")):
        (tmp_path / name).write_text(content)
        assert [tuple(r) for r in read_manifest(spark, str(tmp_path / name)).collect()] == [("epub", "a", "b", "p", "true")]


def test_media_resolution(spark):
    wanted = spark.createDataFrame([(1, "/i/a.png"), (1, "none")], "doc_id long, ref string")
    files = spark.createDataFrame([("i/a.png", 2, bytearray(b"2")), ("i/a.png", 1, bytearray(b"1"))], "path string, priority int, content binary")
    assert {r.ref: r.content for r in resolve_media(wanted, files).collect()} == {"/i/a.png": b"1", "none": None}


def test_reports(spark, tmp_path):
    rows = [("f<1>", 2, 1, 1, 1, 1, "a", "a", "", "no", "ok"), ("f<1>", 1, 1, 0, 1, 0, "a", "", "missing_output_page", "no", "discrepancy")]
    df = spark.createDataFrame(rows, "file string, page int, chars_in int, chars_out int, words_in int, words_out int, checksum_in string, checksum_out string, flags string, has_ocr string, status string")
    reports.write_csv(df.coalesce(1), str(tmp_path / "r"))
    text = next((tmp_path / "r").glob("*.csv")).read_text()
    assert [r["page"] for r in csv.DictReader(text.splitlines())] == ["1", "2"]
    html = reports.html_reports(df).first().html
    assert "f&lt;1&gt;" in html and html.count('class="has-discrepancy"') == 1 and html.index("missing_output_page") < html.index(">ok<")
    assert "No pages processed" in reports.html_page("f", "", "")


def test_book_xml(spark):
    xml = reports.book_xml(nodes_of(spark, "<book><para>a &amp; b</para></book>"), "b.dtd").first().xml
    assert xml.startswith("<?xml") and '<!DOCTYPE book SYSTEM "b.dtd">' in xml and "a &amp; b" in xml
    assert reports.output_pages(nodes_of(spark, "<book><para>x</para><para>y</para></book>")).first().text == "x\ny"


def test_tools_say_what_is_missing(spark):
    with pytest.raises(RuntimeError):
        tools.run(["surely-not-installed"])
    assert tools.missing(["surely-not-installed"], ["no_such.module", "json.decoder"]) == ["no_such", "surely-not-installed"]
    assert tools.run(["echo", "x"]).strip() == b"x"
    if tools.missing(["pdftotext"]):
        failed = tools.extract(spark.createDataFrame([(1, bytearray(b"x"))], "doc_id long, content binary"), "text").first()
        assert failed.output is None and "pdftotext" in failed.error
    same = tools.extract(spark.createDataFrame([(1, bytearray(b"x"), "")], "doc_id long, content binary, pages string"), "ocr").first()
    assert same.output == b"x"


def test_commands(spark, tmp_path, capsys):
    book = tmp_path / "b.epub"
    book.write_bytes(epub())
    assert cli.main(["--report-dir", str(tmp_path / "r"), "epub", "--input", str(book), "--out", str(tmp_path / "o.zip"), "--publisher", "p"]) == 0
    assert (tmp_path / "o.zip").read_bytes()[:2] == b"PK"
    (tmp_path / "m.json").write_text(json.dumps([{"type": "epub", "input": str(book), "out": str(tmp_path / "q.zip"), "publisher": "p"}, {"type": "odd", "input": "z", "out": "", "publisher": ""}, {"type": "epub", "input": "missing", "out": "x", "publisher": "p"}]))
    assert cli.main(["--report-dir", str(tmp_path / "r"), "batch", "--manifest", str(tmp_path / "m.json")]) == 1 and (tmp_path / "q.zip").exists()
    (tmp_path / "d.dtd").write_text("<!ELEMENT a (b)> <!ELEMENT b EMPTY>")
    (tmp_path / "x.xml").write_text("<a><b/></a>")
    (tmp_path / "y.xml").write_text("<a/>")
    assert cli.main(["validate", "--input", str(tmp_path / "x.xml"), "--dtd", str(tmp_path / "d.dtd")]) == 0
    assert cli.main(["validate", "--input", str(tmp_path / "y.xml"), "--dtd", str(tmp_path / "d.dtd")]) == 1
    with pytest.raises(SystemExit):
        cli.main(["epub", "--input", "missing", "--out", "x", "--publisher", "p"])


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.epub").write_bytes(epub())
    for _ in range(2):
        query = filedrop.page_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
        query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_late_pages(spark):
    df = spark.createDataFrame([("x", True), ("x", False)], "extractor string, has_ocr boolean").withColumn("ingested_at", F.lit("2025-01-01 10:00:00").cast("timestamp"))
    row = filedrop.late_pages(df).first()
    assert (row.pages, row.scanned) == (2, 1)


def test_pdf_command_keeps_images_and_reads_image_only_pages_again(spark, tmp_path, monkeypatch):
    import os
    import struct
    import zipfile

    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", 300, 200, 8, 2, 0, 0, 0) + b"\0" * 4

    def text(path):
        with open(path, "rb") as one:
            return b"Page one has words.\f" + (b"Read again.\f" if b"ocr:2" in one.read() else b"\f")

    def layout(path):
        folder = os.path.dirname(path)
        with open(path, "rb") as one:
            more = b'<text top="50" left="50" width="200" height="12" font="0">Read again.</text>' if b"ocr:2" in one.read() else b""
        with open(os.path.join(folder, "layout-1_1.png"), "wb") as out:
            out.write(png)
        return b'<pdf2xml><page number="1" height="800" width="600"><fontspec id="0" size="10" family="x" color="#000"/><text top="50" left="50" width="200" height="12" font="0">Page one has words.</text><image top="100" left="50" width="300" height="200" src="' + os.path.join(folder, "layout-1_1.png").encode() + b'"/><text top="310" left="50" width="200" height="12" font="0">Figure 1. A thing.</text></page><page number="2" height="800" width="600">' + more + b"</page></pdf2xml>"

    def ocr(path, pages=""):
        return b"ocr:" + pages.encode()

    for name, work in (("text", text), ("layout", layout), ("ocr", ocr)):
        monkeypatch.setitem(tools.TOOLS, name, work)
    monkeypatch.setattr(cli, "missing", lambda programs: [])
    (tmp_path / "a.pdf").write_bytes(b"pdf")

    def bundle(*flags):
        assert cli.main(["--report-dir", str(tmp_path / "r"), "pdf", "--input", str(tmp_path / "a.pdf"), "--out", str(tmp_path / "a.zip"), "--publisher", "p", *flags]) == 0
        with zipfile.ZipFile(tmp_path / "a.zip") as z:
            return {n: z.read(n) for n in z.namelist()}

    plain, again = bundle(), bundle("--ocr-on-image-only")
    assert png in plain.values() and png in again.values()
    assert not any(b"Read again" in c for c in plain.values()) and any(b"Read again" in c for c in again.values())


def test_one_bad_job_takes_no_other_with_it(monkeypatch):
    done = []

    def convert(spark, jobs, kind, args):
        if any(j["input"] == "bad" for j in jobs):
            raise ValueError("strict")
        done.extend(j["input"] for j in jobs)
        return []

    monkeypatch.setattr(cli, "_convert", convert)
    jobs = [{"input": n} for n in ("a", "b", "bad", "c", "d")]
    assert cli._isolated(None, jobs, "pdf", None) == ["bad"] and sorted(done) == ["a", "b", "c", "d"]


def test_bundles_are_named_by_isbn_and_hold_their_stylesheet(spark, tmp_path):
    from foliospark import config, pipeline

    nodes = nodes_of(spark, "<book><bookinfo><isbn> 978-3 16 </isbn><isbn>99</isbn></bookinfo><chapter><title>t</title></chapter></book>")
    assert [r.name for r in pipeline.book_names(nodes).collect()] == ["978316"]
    (tmp_path / "own.css").write_bytes(b"para { }")
    assert pipeline.assets(config.DEFAULTS) == {"book.css": pipeline.PLAIN_STYLE}
    assert pipeline.assets(config.merge(config.DEFAULTS, {"docbook": {"stylesheet": str(tmp_path / "own.css")}})) == {"book.css": b"para { }"}


def test_the_settings_decide_about_the_classifier(spark):
    from foliospark import config, pipeline

    blocks = spark.createDataFrame([("para", "text")], "label string, text string")
    sure = lambda label, text: F.struct(F.lit("note").alias("label"), F.lit(0.7).alias("confidence"))
    said = lambda own: pipeline._classified(blocks, config.merge(config.DEFAULTS, {"classifier": own}), sure).first().classifier_label
    assert [said({}), said({"enabled": True}), said({"enabled": True, "threshold": 0.5}), said({"enabled": True, "abstain_label": "?"})] == ["para", "abstain", "note", "?"]
