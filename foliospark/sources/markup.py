"""Layout XML, e-book containers, XHTML and manifests as tables.

Inputs are rows (doc_id, content) as `binaryFile` gives them; parsing happens where a row lies. A
row that cannot be parsed gives one row of kind `error` instead of ending the job."""

from __future__ import annotations

import io
import json
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import Path
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "doc_id long, kind string, page_ord int, page_num int, page_width double, page_height double, ord int, font_id string, family string, size string, top double, left double, width double, height double, content string, src string"
ENTRY_COLUMNS = [c.split()[0] for c in ENTRY.split(", ")]


# frames are of objects throughout: a column that is empty in one batch keeps its type


def _number(node: ET.Element, name: str) -> float:
    return float(node.get(name) or 0)


def layout_rows(doc: int, content: bytes) -> Iterator[dict]:
    """fontspec, text and image rows of one layout file, pages in document order."""
    root = ET.fromstring(content)
    for i, spec in enumerate(root.iter("fontspec")):
        yield {"doc_id": doc, "kind": "font", "ord": i, "font_id": spec.get("id"), "size": spec.get("size"), "family": spec.get("family")}
    for p, page in enumerate(root.iter("page")):
        own = {"doc_id": doc, "page_ord": p, "page_num": int(page.get("number") or 0), "page_width": _number(page, "width"), "page_height": _number(page, "height")}
        for kind in ("text", "image"):
            for i, node in enumerate(page.findall(kind)):
                place = {k: _number(node, k) for k in ("top", "left", "width", "height")}
                yield own | place | {"kind": kind, "ord": i, "font_id": node.get("font"), "size": node.get("size"), "content": "".join(node.itertext()) if kind == "text" else None, "src": node.get("src")}


def parse_layout(files: DataFrame) -> DataFrame:
    """All entries of layout files: kind font, text, image or, for a file that is not well formed, error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, content in zip(pdf["doc_id"], pdf["content"]):
                try:
                    rows += list(layout_rows(doc, content.encode() if isinstance(content, str) else bytes(content)))
                except (ET.ParseError, ValueError, TypeError, AttributeError) as wrong:
                    rows.append({"doc_id": doc, "kind": "error", "content": str(wrong)})
            yield pd.DataFrame(rows, columns=ENTRY_COLUMNS, dtype=object)

    return files.select("doc_id", "content").mapInPandas(run, ENTRY)


def layout_tables(entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fontspecs, text nodes, images) of parsed entries."""
    fonts = entries.where("kind = 'font'").select("doc_id", "font_id", "size", "family", "ord")
    texts = entries.where("kind = 'text'").withColumnRenamed("ord", "node_ord").drop("kind", "family", "src")
    images = entries.where("kind = 'image'").select("doc_id", "page_ord", "page_num", "ord", "src", "top", "left", "width", "height")
    return fonts, texts, images


VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: A start tag of a key ends an open element of its values.
ENDS = {"p": ("p",), "li": ("li", "p"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)} | {t: ("p",) for t in ("ul", "ol", "div", "table", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "pre")}


class _Tolerant(HTMLParser):
    """HTML of any state to a tree: implied ends, void elements, stray ends, scripts left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("html")
        self.open, self.hidden = [self.root], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("html",):
            return
        if tag in ("script", "style"):
            self.hidden += 1
            return
        while len(self.open) > 1 and self.open[-1].tag in ENDS.get(tag, ()):
            self.open.pop()
        node = ET.SubElement(self.open[-1], tag, {k: v or "" for k, v in attrs})
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        if not self.hidden:
            node = self.open[-1]
            if len(node):
                node[-1].tail = (node[-1].tail or "") + data
            else:
                node.text = (node.text or "") + data


def html_tree(content: str) -> ET.Element:
    """The tree of XHTML or, where it is not well formed, of HTML; names without namespace."""
    try:
        root = ET.fromstring(content)
    except ET.ParseError:
        parser = _Tolerant()
        parser.feed(content)
        parser.close()
        root = parser.root
    for node in root.iter():
        if isinstance(node.tag, str):
            node.tag = node.tag.rpartition("}")[2].lower()
    return root


def _space(text: str) -> str:
    return " ".join(t for t in text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if t)


#: What an XHTML element with text becomes, and lists.
LEAVES = {"h1": ("title", {}), "h2": ("para", {"role": "section"}), "p": ("para", {}), "figcaption": ("caption", {})}
LISTS = {"ul": "itemizedlist", "ol": "orderedlist"}


def docbook_of(body: list[ET.Element], root: str) -> ET.Element:
    """XHTML elements as document elements: leaves whole, lists with their items, images, anything else by what it holds."""
    made = ET.Element(root)
    stack = [(made, list(reversed(body)))]
    while stack:
        parent, rest = stack[-1]
        if not rest:
            stack.pop()
            continue
        node = rest.pop()
        if not isinstance(node.tag, str):
            continue
        if node.tag in LEAVES:
            tag, attrs = LEAVES[node.tag]
            ET.SubElement(parent, tag, attrs).text = _space("".join(node.itertext()))
        elif node.tag == "li":
            ET.SubElement(ET.SubElement(parent, "listitem"), "para").text = _space("".join(node.itertext()))
        elif node.tag == "img":
            ET.SubElement(ET.SubElement(ET.SubElement(parent, "mediaobject"), "imageobject"), "imagedata", fileref=node.get("src", ""))
        else:
            stack.append((ET.SubElement(parent, LISTS[node.tag]) if node.tag in LISTS else parent, list(reversed(node))))
    return made


def html_to_docbook(pages: DataFrame, doc: str, html: str, root: str = "book") -> DataFrame:
    """The document nodes of each HTML text; a null text gives a bare root."""
    from foliospark.plans.tree import NODE, _frame, rows_of

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, content in zip(pdf["doc_id"], pdf["html"]):
                tree = html_tree(content or "")
                body = tree.find("body") if tree.tag != "body" else tree
                out += rows_of(key, docbook_of(list(tree if body is None else body), root))
            yield _frame(out)

    return pages.select(pages[doc].cast("long").alias("doc_id"), pages[html].alias("html")).mapInPandas(run, NODE)


EPUB = "doc_id long, kind string, pos int, child int, id string, href string, text string, content binary"
EPUB_COLUMNS = [c.split()[0] for c in EPUB.split(", ")]


def epub_rows(doc: int, content: bytes) -> Iterator[dict]:
    """item, spine, missing, block and media rows of one e-book: blocks are the spine's body children in order.

    Of manifest items with one id the last counts; a spine entry without a file is a `missing` row.
    Image sources are made relative to the container. A block's text is its text nodes, one blank
    between them; its content is its markup."""
    local = lambda root, name: (n for n in root.iter() if isinstance(n.tag, str) and n.tag.rpartition("}")[2] == name)
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        path = next((n.get("full-path") for n in local(ET.fromstring(z.read("META-INF/container.xml")), "rootfile")), None)
        if path is None:
            raise ValueError("the container names no package file")
        package, base = ET.fromstring(z.read(path)), posixpath.dirname(path)
        items = {n.get("id"): n.get("href") for m in local(package, "manifest") for n in local(m, "item")}
        for k, (key, href) in enumerate(items.items()):
            yield {"kind": "item", "pos": k, "id": key, "href": href}
        for pos, ref in enumerate(n.get("idref") for s in local(package, "spine") for n in local(s, "itemref")):
            href = items.get(ref)
            yield {"kind": "spine" if href else "missing", "pos": pos, "id": ref, "href": href}
            if not href:
                continue
            file = posixpath.join(base, href)
            tree = html_tree(z.read(file).decode("utf-8", "replace"))
            for image in tree.iter("img"):
                if image.get("src"):
                    image.set("src", posixpath.join(posixpath.dirname(file), image.get("src")))
            body = tree.find("body")
            for child, node in enumerate(body if body is not None else ()):
                text = " ".join(node.itertext())
                node.tail = None
                yield {"kind": "block", "pos": pos, "child": child, "id": node.tag, "href": file, "text": text, "content": ET.tostring(node)}
        for name in z.namelist():
            if name.lower().rpartition(".")[2] in ("png", "jpg", "jpeg", "gif", "svg", "webp", "bmp", "tif", "tiff"):
                yield {"kind": "media", "href": name, "content": z.read(name)}


def parse_epub(files: DataFrame) -> DataFrame:
    """All rows of e-books; a file that is no e-book gives a row of kind error with the reason."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, content in zip(pdf["doc_id"], pdf["content"]):
                try:
                    rows += [{"doc_id": doc, **r} for r in epub_rows(doc, bytes(content))]
                except Exception as wrong:  # noqa: BLE001 - one bad file must not end the job
                    rows.append({"doc_id": doc, "kind": "error", "text": f"{type(wrong).__name__}: {wrong}"})
            yield pd.DataFrame(rows, columns=EPUB_COLUMNS, dtype=object)

    return files.select("doc_id", "content").mapInPandas(run, EPUB)


def epub_html(rows: DataFrame) -> DataFrame:
    """(doc_id, html): each e-book's blocks as one XHTML body in spine order."""
    one = F.array_sort(F.collect_list(F.struct("pos", "child", F.decode("content", "UTF-8").alias("h"))))
    return rows.where("kind = 'block'").groupBy("doc_id").agg(F.concat(F.lit("<html><body>"), F.array_join(F.transform(one, lambda x: x["h"]), ""), F.lit("</body></html>")).alias("html"))


def epub_pages(rows: DataFrame) -> DataFrame:
    """(doc_id, page_num, raw_text): each block as a page, numbered in spine order."""
    from pyspark.sql import Window

    return rows.where("kind = 'block'").select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos", "child")).alias("page_num"), F.col("text").alias("raw_text"))


def resolve_media(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, ref, content): each wanted reference with the file of the least `priority` that has its path.

    files is (path, priority, content). A leading slash is tried without it first."""
    keyed = wanted.select("doc_id", "ref", F.explode(F.array_distinct(F.array(F.regexp_replace("ref", "^/+", ""), F.col("ref")))).alias("path"))
    return keyed.join(files, "path", "left").groupBy("doc_id", "ref").agg(F.min_by("content", F.when(F.col("content").isNotNull(), F.col("priority"))).alias("content"))


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, content) of the files under a path; ids are hashes of the paths."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The jobs of a manifest as strings: type, input, out, publisher, ocr_on_image_only.

    A .json file is a list of jobs or an object with `jobs`; anything else is CSV with a header.
    Booleans are taken as their words."""
    names = ["type", "input", "out", "publisher", "ocr_on_image_only"]
    if Path(path).suffix == ".json":
        said = json.loads(Path(path).read_text(encoding="utf-8"))
        jobs = said if isinstance(said, list) else said.get("jobs", [])
        word = lambda v: None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        return spark.createDataFrame([tuple(word(j.get(n)) for n in names) for j in jobs], ", ".join(f"{n} string" for n in names))
    read = spark.read.csv(path, header=True)
    return read.select(*(F.col(n) if n in read.columns else F.lit(None).cast("string").alias(n) for n in names))
