"""The document tree, as a table of nodes: built from labelled blocks or XHTML, split into fragments, written as XML.

A node row is (doc_id, node_id, parent_id, ord, tag, text, attrs, path): node_id counts in document
order from 0, the root, and path has the ids from the root down. Text goes before children."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODE = "doc_id long, node_id int, parent_id int, ord int, tag string, text string, attrs map<string,string>, path array<int>"
#: Tags that begin a fragment, those of metadata, and the indent that makes a sub-entry.
CHAPTER_TAGS = ("chapter", "preface", "appendix", "part", "article", "section", "sect1", "index")
INFO_TAGS = ("bookinfo", "info")
SUB_ENTRY = 18.0


def add(parent: ET.Element, tag: str, text: str | None = None, **attrs: str) -> ET.Element:
    child = ET.SubElement(parent, tag, attrs)
    child.text = text
    return child


def set_title(parent: ET.Element, text: str) -> None:
    """The parent's title, made where it has none, put first."""
    title = parent.find("title")
    if title is None:
        title = ET.Element("title")
        parent.insert(0, title)
    title.text = text.strip()


class IndexBuilder:
    """A back-of-book index from its lines, cleaned and parted before (entry, pages, reference)."""

    def __init__(self, root: ET.Element, title: str):
        self.node, self.division, self.entry, self.base = add(root, "index"), None, None, None
        set_title(self.node, title)

    def _divide(self, letter: str, left: float | None) -> None:
        self.division = add(self.node, "indexdiv")
        set_title(self.division, letter)
        self.base = self.base if left is None else left

    @staticmethod
    def _refer(node: ET.Element, part: dict) -> None:
        if part["pages"]:
            add(node, "seeie", part["pages"])
        if part["reference"]:
            add(node, "seealsoie", part["reference"])

    def line(self, part: dict, left: float | None) -> None:
        clean = part["clean"]
        if not clean:
            return
        self.base = left if self.base is None else self.base
        if re.fullmatch("[A-Z]", clean):
            self._divide(clean, left)
            self.entry = None
            return
        if self.division is None:
            self._divide(clean[0].upper(), left)
        if not part["entry"]:
            if self.entry is not None:
                self._refer(self.entry, part)
        elif self.entry is None or (left or 0.0) - (self.base or 0.0) <= SUB_ENTRY or left is None:
            self.entry = add(self.division, "indexentry")
            add(self.entry, "primaryie", part["entry"])
            self._refer(self.entry, part)
        else:
            inner = add(self.entry, "secondaryie")
            add(inner, "secondaryie", part["entry"])
            self._refer(inner, part)


class TreeBuilder:
    """Blocks in order to elements; what is open decides where a block goes."""

    def __init__(self, root: str):
        self.root = ET.Element(root)
        self.chapter = self.section = self.list = self.index = self.latest = None
        self.caption = ""

    @property
    def container(self) -> ET.Element:
        return next(x for x in (self.index.node if self.index else None, self.section, self.chapter, self.root) if x is not None)

    def _caption_on(self, target: ET.Element | None, text: str) -> bool:
        if target is None or target.tag not in ("figure", "table", "informaltable"):
            return False
        caption = target.find("caption")
        (add(target, "caption") if caption is None else caption).text = text.strip()
        return True

    def _give_caption(self, target: ET.Element | None) -> None:
        """The waiting caption to its figure or table, else as a paragraph of its own."""
        if self.caption and not self._caption_on(target, self.caption):
            add(self.container, "para", self.caption)
            self.latest, self.list = self.container, None
        self.caption = ""

    def _opened(self, node: ET.Element) -> None:
        self.latest, self.list = node, None

    def block(self, b: dict) -> None:
        label, text = b["label"], (b["text"] or "").strip()
        if self.caption and label not in ("caption", "figure", "table"):
            self._give_caption(None)
        if self.index is not None and label in ("para", "section") and (label == "para" or text):
            if text:
                self.index.line(b["index_part"], b["left"])
                self.list = None
            self.latest = self.index.node
        elif label == "figure" and b["src"]:
            figure = add(self.container, "figure")
            add(add(add(figure, "mediaobject"), "imageobject"), "imagedata", fileref=b["src"])
            self._give_caption(figure)
            self._opened(figure)
        elif label == "table" and b["rows"] is not None and len(b["rows"]):
            table = add(self.container, "informaltable")
            body = add(add(table, "tgroup", cols=str(len(b["rows"][0]))), "tbody")
            for row in b["rows"]:
                line = add(body, "row")
                for cell in row:
                    add(line, "entry", (cell or "").strip())
            self._give_caption(table)
            self._opened(table)
        elif not text:
            return
        elif label == "book_title":
            set_title(self.root, text)
            self._opened(self.root)
        elif label == "chapter" and b["chapter_role"] == "index":
            self.index, self.chapter, self.section = IndexBuilder(self.root, text), None, None
            self._opened(self.index.node)
        elif label in ("chapter", "toc"):
            if label == "chapter":
                self.index = None
            role = "toc" if label == "toc" else b["chapter_role"]
            self.chapter, self.section = add(self.root, "chapter", **({"role": role} if role else {})), None
            set_title(self.chapter, text)
            self._opened(self.chapter)
        elif label == "section":
            self.section = add(self.root if self.chapter is None else self.chapter, "sect1")
            set_title(self.section, text)
            self._opened(self.section)
        elif label == "list_item":
            tag = "orderedlist" if b["list_type"] == "ordered" else "itemizedlist"
            if self.list is None or self.list.tag != tag:
                self.list = add(self.container, tag)
            add(add(self.list, "listitem"), "para", text)
            self.latest = self.list
        elif label == "caption":
            if self._caption_on(self.latest, text):
                self.caption = ""
            else:
                self.caption = f"{self.caption} {text}".strip()
        elif label == "footnote":
            note = add(self.container, "footnote")
            add(note, "para", text)
            self._opened(note)
        else:
            add(self.container, "para", text)
            self._opened(self.container)

    def done(self) -> ET.Element:
        self._give_caption(None)
        return self.root


def rows_of(doc: int, root: ET.Element) -> list[tuple]:
    """An element tree as node rows; a node's tail becomes a text node without tag."""
    out, stack = [], [(root, None, 0, [])]
    while stack:
        node, parent, order, above = stack.pop()
        me = len(out)
        path = [*above, me]
        out.append((doc, me, parent, order, node.tag, node.text, dict(node.attrib), path))
        children = []
        for child in node:
            children.append((child, me, len(children), path))
            if child.tail and child.tail.strip():
                text = ET.Element("")
                text.text = child.tail
                children.append((text, me, len(children), path))
        stack += reversed(children)
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "node_id", "parent_id", "ord", "tag", "text", "attrs", "path"], dtype=object)


def build_tree(blocks: DataFrame, root: str = "book") -> DataFrame:
    """The nodes of each document's tree. classifier_label, where there is one, stands for label.

    Index lines are cleaned and parted as columns; the rest follows the order of blocks, document by
    document, and each task holds one document's blocks."""
    from foliospark.functions.text import index_parts, index_text

    label = F.coalesce("classifier_label", "label") if "classifier_label" in blocks.columns else F.col("label")
    clean = index_text(F.coalesce("text", F.lit("")))
    part = index_parts(clean)
    ready = blocks.select("doc_id", "block_ord", F.coalesce(label, F.lit("para")).alias("label"), "text", "left", "rows", "src", "list_type", "chapter_role", F.struct(clean.alias("clean"), part["entry"].alias("entry"), part["pages"].alias("pages"), part["reference"].alias("reference")).alias("index_part"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        builder = TreeBuilder(root)
        for b in pdf.sort_values("block_ord").astype(object).where(pdf.notna(), None).to_dict("records"):
            builder.block(b)
        return _frame(rows_of(pdf["doc_id"].iloc[0], builder.done()))

    return ready.groupBy("doc_id").applyInPandas(build, NODE)


def block_elements(blocks: DataFrame) -> DataFrame:
    """(doc_id, block_ord, tag, role, wrapper, text): the plain mapping of blocks to elements, one element a block."""
    label = F.col("label")
    tag = F.when(label == "title", "title").when(label == "caption", "caption").otherwise("para")
    wrapper = F.when(label == "list_item", "itemizedlist/listitem").when(label == "footnote", "footnote")
    return blocks.select("doc_id", "block_ord", tag.alias("tag"), F.when(label == "section", "section").alias("role"), wrapper.alias("wrapper"), "text")


def with_info(nodes: DataFrame, default_title: str = "Untitled Book") -> DataFrame:
    """The nodes with info elements named bookinfo, and a bookinfo given to each book that has none.

    The new one takes the root's first title, normalised, or the default, and stands first: its
    nodes have ids below 0. Only a root named book is given one."""
    renamed = nodes.withColumn("was", F.col("tag")).withColumn("tag", F.when(F.col("tag") == "info", "bookinfo").otherwise(F.col("tag")))
    top = renamed.where("parent_id = 0 OR node_id = 0")
    clean = F.nullif(F.trim(F.regexp_replace("text", r"[ \t\r\n]+", " ")), F.lit(""))
    books = top.groupBy("doc_id").agg(
        F.max(F.when(F.col("node_id") == 0, F.col("tag") == "book")).alias("book"),
        F.max(F.when(F.col("parent_id") == 0, F.col("was") == "bookinfo").otherwise(False)).alias("has"),
        F.min_by(clean, F.when((F.col("parent_id") == 0) & (F.col("tag") == "title"), F.col("ord"))).alias("title"),
    )
    lacking = books.where("book AND NOT has")
    made = F.array(
        F.struct(F.lit(-2).alias("node_id"), F.lit(0).alias("parent_id"), F.lit(-1).alias("ord"), F.lit("bookinfo").alias("tag"), F.lit(None).cast("string").alias("text"), F.array(F.lit(0), F.lit(-2)).alias("path")),
        F.struct(F.lit(-1).alias("node_id"), F.lit(-2).alias("parent_id"), F.lit(0).alias("ord"), F.lit("title").alias("tag"), F.coalesce("title", F.lit(default_title)).alias("text"), F.array(F.lit(0), F.lit(-2), F.lit(-1)).alias("path")),
    )
    added = lacking.select("doc_id", F.explode(made).alias("n")).select("doc_id", "n.node_id", "n.parent_id", "n.ord", "n.tag", "n.text", F.create_map().cast("map<string,string>").alias("attrs"), "n.path")
    return renamed.drop("was").unionByName(added)


def titles(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent_id, title): the whole text of each node's first title child, stripped."""
    from foliospark.functions.text import strip

    title = nodes.where("tag = 'title'").groupBy("doc_id", "parent_id").agg(F.min_by("node_id", "ord").alias("title_id"))
    texts = nodes.where("text IS NOT NULL").select("doc_id", "node_id", "text", F.explode("path").alias("title_id"))
    return title.join(texts, ["doc_id", "title_id"], "left").groupBy("doc_id", "parent_id").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "")).alias("title"))


def fragments(nodes: DataFrame) -> DataFrame:
    """(doc_id, frag_ord, node_id, entity, filename, kind, title, section_type): the parts of each document.

    Chapter-like children of the root are parts: tables of contents, indexes and, numbered in order,
    the rest. A document with none has one part Ch001 of all its children but metadata, node_id 0."""
    top = nodes.where("parent_id = 0").join(titles(nodes).withColumnRenamed("parent_id", "node_id"), ["doc_id", "node_id"], "left")
    tag, title, role = F.col("tag"), F.coalesce("title", F.lit("")), F.lower(F.coalesce(F.col("attrs")["role"], F.lit("")))
    is_toc = (tag == "chapter") & ((role == "toc") | (F.lower(title) == "table of contents"))
    is_index = (tag == "index") | (tag == "chapter") & ((role == "index") | (F.lower(title) == "index"))
    parts = top.where(tag.isin(*CHAPTER_TAGS)).withColumn("k", F.when(is_toc, "toc").when(is_index, "index").otherwise("chapter"))
    w = Window.partitionBy("doc_id").orderBy("ord")
    number = F.sum(F.when(F.col("k") == "chapter", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    numbered = parts.withColumn("frag_ord", F.row_number().over(w)).withColumn("n", number)
    entity = F.when(F.col("k") == "toc", "toc").when(F.col("k") == "index", "Index").otherwise(F.format_string("Ch%03d", "n"))
    named = numbered.select(
        "doc_id", "frag_ord", "node_id", entity.alias("entity"),
        F.when(F.col("k") == "toc", "TableOfContents.xml").otherwise(F.concat(entity, F.lit(".xml"))).alias("filename"),
        F.when(F.col("k") == "toc", "toc").otherwise("chapter").alias("kind"),
        F.when(F.col("k") == "chapter", title).otherwise(F.coalesce(F.nullif(title, F.lit("")), F.when(F.col("k") == "toc", "Table of Contents").otherwise("Index"))).alias("title"),
        F.when(F.col("k") == "chapter", tag).otherwise(F.col("k")).alias("section_type"),
    )
    bare = nodes.where("node_id = 0").select("doc_id").join(named.select("doc_id").distinct(), "doc_id", "left_anti")
    lone = bare.select("doc_id", F.lit(1).alias("frag_ord"), F.lit(0).alias("node_id"), F.lit("Ch001").alias("entity"), F.lit("Ch001.xml").alias("filename"), F.lit("chapter").alias("kind"), F.lit("").alias("title"), F.lit("chapter").alias("section_type"))
    return named.unionByName(lone)


def contents(parts: DataFrame) -> DataFrame:
    """(doc_id, entries): the table of contents of each document, its chapters by title and file, in order."""
    line = F.concat(F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("filename")), F.lit(" ("), F.col("filename"), F.lit(")"))
    return parts.where("kind = 'chapter'").groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("frag_ord", line.alias("l")))), lambda x: x["l"]).alias("entries"))


def chapter_code(entity: Column, section_type: Column, title: Column) -> Column:
    """struct(code, label): what names a part's images, and what a reader calls it."""
    letter = F.upper(F.coalesce(F.nullif(F.regexp_extract(F.coalesce(title, F.lit("")), r"(?i)appendix\s+([A-Z])", 1), F.lit("")), F.lit("A")))
    number = F.nullif(F.regexp_extract(entity, r"(?i)^Ch(\d+)", 1), F.lit("")).cast("int")
    low = F.lower(entity)
    appendix = F.lower(F.coalesce(section_type, F.lit(""))) == "appendix"
    code = F.when(low == "toc", "TOC").when(low == "index", "Index").when(appendix, F.concat(F.lit("Appendix"), letter)).when(number.isNotNull(), F.format_string("Ch%04d", number)).otherwise("Ch0001")
    label = F.when(low == "toc", "TOC").when(low == "index", "Index").when(appendix, F.concat(F.lit("Appendix "), letter)).when(number.isNotNull(), number.cast("string")).otherwise("1")
    return F.struct(code.alias("code"), label.alias("label"))


def element_of(nodes: Iterator[tuple[int, int | None, int, str, str | None, dict]]) -> dict[int, ET.Element]:
    """Elements by node id, each under its parent; nodes are (id, parent, ord, tag, text, attrs)."""
    made, order = {}, sorted(nodes, key=lambda n: (n[1] is not None, n[1] or 0, n[2]))
    for me, _, _, tag, text, attrs in order:
        made[me] = ET.Element(tag, dict(attrs or {}))
        made[me].text = text
    for me, parent, _, tag, text, _ in order:
        if parent is not None and parent in made:
            above = made[parent]
            if tag:
                above.append(made[me])
            elif len(above):
                above[-1].tail = (above[-1].tail or "") + (text or "")
            else:
                above.text = (above.text or "") + (text or "")
    return made


def xml_of(element: ET.Element, doctype: str = "", instructions: list[tuple[str, str]] = ()) -> bytes:
    """An XML document: declaration, processing instructions, document type, the element indented."""
    ET.indent(element)
    head = "".join(f"<?{t} {d}?>\n" for t, d in instructions)
    return ('<?xml version="1.0" encoding="UTF-8"?>\n' + head + (doctype + "\n" if doctype else "") + ET.tostring(element, encoding="unicode") + "\n").encode()
