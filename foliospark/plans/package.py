"""Images of a document tree, sorted, numbered and catalogued; the tree and they as a ZIP bundle."""

from __future__ import annotations

import csv
import io
import zipfile
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.images import image_info
from foliospark.functions.layout import LOW_RESOLUTION
from foliospark.functions.text import file_size, strip
from foliospark.plans.tree import chapter_code, element_of, fragments, xml_of
from foliospark.session import cut

#: Parts of file names that tell decoration and background, and ancestors of decoration.
DECORATIVE = ("logo", "watermark", "copyright", "trademark", "tm", "brand")
BACKGROUND = ("background", "texture", "gradient", "border", "pattern")
INFO_ANCESTORS = ("bookinfo", "info", "titlepage")
CHAPTERS, SHARED, METADATA = "media/Book_Images/Chapters/", "media/Book_Images/Shared/", "media/Book_Images/Metadata/"
CATALOG = ["filename", "original_filename", "chapter", "figure_number", "caption", "alt_text", "referenced_in_text", "width", "height", "file_size", "format"]
MANIFEST = {"Filename": "filename", "Chapter": "chapter", "Figure": "figure_number", "Caption": "caption", "Alt-Text": "alt_text", "Original_Name": "original_filename", "File_Size": "file_size", "Format": "format"}


def base_name(ref: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(ref, "/+$", ""), "/"), -1)


def suffix_of(ref: Column) -> Column:
    """The last dot of a file name and what follows, `.jpg` where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(base_name(ref), r"[^.](\.[^.]+)$", 1), F.lit("")), F.lit(".jpg"))


def image_class(ref: Column, in_figure: Column, in_info: Column, role: Column) -> Column:
    """content, decorative or background: figures are content; then ancestors, file name and role decide."""
    name, role = F.lower(base_name(ref)), F.lower(F.coalesce(role, F.lit("")))
    named = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(name, w))
    return (
        F.when(in_figure, "content").when(in_info, "decorative").when(named(DECORATIVE), "decorative").when(named(BACKGROUND), "background").when(role.isin("decorative", "background"), role).otherwise("content")
    )


def is_referenced(figure_id: Column, caption: Column) -> Column:
    return (strip(F.coalesce(figure_id, F.lit(""))) != "") | F.coalesce(caption, F.lit("")).rlike(r"(?i)figure\s+\d")


def is_low_resolution(width: Column, height: Column) -> Column:
    """Both sides known and one of them short."""
    return (width > 0) & (height > 0) & ((width < LOW_RESOLUTION) | (height < LOW_RESOLUTION))


#: Children whose texts say something about an image.
TELLING = ("caption", "title", "label", "textobject")


def child_texts(nodes: DataFrame, tags: tuple[str, ...] = TELLING) -> DataFrame:
    """(doc_id, parent_id, texts): whole text, stripped, of each node's first child of each tag, by tag.

    Of textobjects it is the first with any text. One pass for all tags."""
    children = nodes.where(F.col("tag").isin(*tags)).select("doc_id", "parent_id", F.col("node_id").alias("c"), "ord", F.col("tag").alias("of"))
    texts = nodes.where("text IS NOT NULL").select("doc_id", "node_id", "text", F.explode("path").alias("c"))
    whole = children.join(texts, ["doc_id", "c"]).groupBy("doc_id", "parent_id", "c", "ord", "of").agg(strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "")).alias("text"))
    first = whole.where("of <> 'textobject' OR text <> ''").groupBy("doc_id", "parent_id", "of").agg(F.min_by("text", "ord").alias("text"))
    return first.groupBy("doc_id", "parent_id").agg(F.map_from_entries(F.collect_list(F.struct("of", "text"))).alias("texts"))


def image_nodes(nodes: DataFrame) -> DataFrame:
    """One row per image of a tree with what decides about it: figure, captions, labels, alt text and class."""
    images = nodes.where(F.col("tag").isin("imagedata", "graphic")).withColumn("ref", F.col("attrs")["fileref"]).where("ref <> ''")
    above = images.select("doc_id", "node_id", F.explode("path").alias("a")).where("a <> node_id").join(nodes.select("doc_id", F.col("node_id").alias("a"), F.col("tag").alias("atag"), F.col("attrs").alias("aattrs")), ["doc_id", "a"])
    seen = above.groupBy("doc_id", "node_id").agg(F.min(F.when(F.col("atag") == "figure", F.col("a"))).alias("figure"), F.max(F.when(F.col("atag") == "mediaobject", F.col("a"))).alias("media"), F.max(F.col("atag").isin(*INFO_ANCESTORS)).alias("in_info"), F.min_by("aattrs", F.when(F.col("atag") == "figure", F.col("a"))).alias("fattrs"))
    said = cut(child_texts(nodes))
    df = images.select("doc_id", "node_id", "path", "attrs", "ref").join(seen, ["doc_id", "node_id"], "left")
    for on, name in (("figure", "f"), ("media", "m")):
        df = df.join(said.select("doc_id", F.col("parent_id").alias(on), F.col("texts").alias(name)), ["doc_id", on], "left")
    text = lambda c: strip(F.coalesce(c, F.lit("")))
    in_figure = F.col("figure").isNotNull()
    caption = F.coalesce(F.nullif(text(F.col("f")["caption"]), F.lit("")), text(F.col("f")["title"]))
    labels = [caption, text(F.col("fattrs")["label"]), text(F.col("fattrs")["id"]), text(F.col("f")["label"]), text(F.col("m")["caption"]), text(F.col("attrs")["label"]), text(F.col("attrs")["id"])]
    own_alt = F.coalesce(F.nullif(F.col("attrs")["alt"], F.lit("")), F.col("attrs")["xlink:title"])
    return df.select(
        "doc_id", "node_id", "path", "ref", "figure", caption.alias("caption"), (F.concat(*labels) != "").alias("labelled"),
        text(F.coalesce(F.nullif(own_alt, F.lit("")), F.col("m")["textobject"])).alias("alt_text"), F.col("fattrs")["id"].alias("figure_id"),
        image_class(F.col("ref"), in_figure, F.coalesce("in_info", F.lit(False)), F.col("attrs")["role"]).alias("class"),
    )


def number_figures(images: DataFrame) -> DataFrame:
    """Saved content images with number and letter within their part.

    images has doc_id, part, node_id, figure (null: loose) and saved. A figure takes a number if one
    of its images is saved, in document order; its images are lettered by place if it has several.
    Loose images are numbered after all figures."""
    of_figure = Window.partitionBy("doc_id", "part", "figure")
    placed = images.withColumn("any", F.max("saved").over(of_figure)).withColumn("size", F.count("*").over(of_figure)).withColumn("place", F.row_number().over(of_figure.orderBy("node_id")))
    leader = F.when(F.col("figure").isNotNull() & F.col("any") & (F.col("place") == 1), 1).when(F.col("figure").isNull() & F.col("saved"), 1).otherwise(0)
    order = Window.partitionBy("doc_id", "part").orderBy(F.col("figure").isNull(), F.coalesce("figure", "node_id"), "node_id").rowsBetween(Window.unboundedPreceding, 0)
    number = F.sum(leader).over(order)
    place = F.col("place") - 1
    letter = F.when(F.col("figure").isNull() | (F.col("size") == 1), "").when(place < 26, F.char(place + 97)).otherwise(F.concat(F.lit("_"), place.cast("string")))
    return placed.withColumn("number", number).withColumn("letter", letter).where("saved").drop("any", "size", "place")


def first_of_name(images: DataFrame, order: list) -> DataFrame:
    """The images (doc_id, ref, …) with `first`: whether one is the first of its file name in its document."""
    return images.withColumn("first", F.row_number().over(Window.partitionBy("doc_id", base_name(F.col("ref"))).orderBy(*order)) == 1)


def package_images(nodes: DataFrame, media: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """Every image with its target file (null: taken out), content and catalogue entry.

    Content images need a caption or label and bytes; decorative ones are shared by file name in a
    document, the first counts, an absent one becomes an empty file; background goes. Images outside
    all parts count as decorative. `media` is (doc_id, ref, content)."""
    parts = fragments(nodes) if parts is None else parts
    code = chapter_code(F.col("entity"), F.col("section_type"), F.col("title"))
    coded = parts.select(F.col("doc_id").alias("d"), "frag_ord", F.col("node_id").alias("part"), code["code"].alias("code"), code["label"].alias("chapter"))
    images = image_nodes(nodes)
    placed = images.withColumn("top", F.get("path", F.lit(1)))
    inside = placed.join(coded, (F.col("doc_id") == F.col("d")) & ((F.col("part") == F.col("top")) | (F.col("part") == 0)), "left").drop("d")
    fetched = inside.join(media.select("doc_id", "ref", "content"), ["doc_id", "ref"], "left")
    filled = F.coalesce(F.length("content"), F.lit(0)) > 0
    kind = F.when((F.col("class") == "content") & F.col("part").isNull(), "decorative").otherwise(F.col("class"))
    judged = fetched.withColumn("class", kind).withColumn("saved", (kind == "content") & F.col("labelled") & filled)
    content = number_figures(judged.where("class = 'content'"))
    named = content.withColumn("filename", F.format_string("%sf%02d%s%s", "code", F.col("number"), "letter", suffix_of(F.col("ref")))).withColumn("info", image_info("content", suffix_of(F.col("ref"))))
    unlabelled = F.format_string("Figure %s.%02d (Unlabeled)", "chapter", F.col("number"))
    catalogued = named.select(
        "doc_id", "node_id", "frag_ord", F.concat(F.lit(CHAPTERS), "filename").alias("target"), "content", "filename", base_name(F.col("ref")).alias("original_filename"), "chapter",
        F.concat(F.col("number").cast("string"), "letter").alias("figure_number"), F.when(F.col("figure").isNull(), unlabelled).otherwise(F.col("caption")).alias("caption"), "alt_text",
        (F.col("figure").isNotNull() & is_referenced(F.col("figure_id"), F.col("caption"))).alias("referenced_in_text"),
        F.col("info.width").alias("width"), F.col("info.height").alias("height"), file_size(F.length("content")).alias("file_size"), F.col("info.format").alias("format"),
    )
    usable = F.col("content").isNull() | filled
    shared = first_of_name(judged.where("class = 'decorative'").where(usable), [F.coalesce("frag_ord", F.lit(1 << 30)), F.col("node_id")])
    decor = shared.select("doc_id", "node_id", "frag_ord", F.concat(F.lit(SHARED), base_name(F.col("ref"))).alias("target"), F.when(F.col("first"), F.coalesce("content", F.lit(b""))).alias("content"))
    gone = judged.select("doc_id", "node_id", "frag_ord").join(catalogued.select("doc_id", "node_id").unionByName(decor.select("doc_id", "node_id")), ["doc_id", "node_id"], "left_anti")
    return catalogued.unionByName(decor, allowMissingColumns=True).unionByName(gone, allowMissingColumns=True)


def catalog(images: DataFrame) -> DataFrame:
    """(doc_id, position and the catalogue's columns) of the saved content images, in order."""
    order = Window.partitionBy("doc_id").orderBy("frag_ord", F.col("figure_number").cast("int"), "node_id")
    return images.where("filename IS NOT NULL").withColumn("position", F.row_number().over(order)).select("doc_id", "position", *CATALOG)


def catalog_xml(rows: list[dict]) -> bytes:
    root = ET.Element("images")
    for row in rows:
        image = ET.SubElement(root, "image")
        for name in CATALOG:
            value = row[name]
            ET.SubElement(image, name).text = str(value).lower() if name == "referenced_in_text" else str(int(value)) if name in ("width", "height") else str(value)
    return xml_of(root)


def manifest_csv(rows: list[dict]) -> bytes:
    out = io.StringIO(newline="")
    writer = csv.writer(out)
    writer.writerow(MANIFEST)
    writer.writerows([row[c] for c in MANIFEST.values()] for row in rows)
    return out.getvalue().encode()


BUNDLE = "doc_id long, name string, files array<string>, content binary"


def bundles(nodes: DataFrame, media: DataFrame, dtd: str, names: DataFrame | None = None, instructions: list[tuple[str, str]] = (), assets: dict[str, bytes] | None = None) -> DataFrame:
    """(doc_id, name, files, content): one ZIP a document. `names` is (doc_id, name); without it the id is the name.

    Book.xml comes first and pulls the parts in by entity, then the parts in order, the folders,
    media by path, and the assets. Parts that would share a file name get a number. Nodes, parts
    and images of a document meet in one task by cogroup; nothing else is gathered."""
    assets = assets or {}
    parts = cut(fragments(nodes))
    images = cut(package_images(nodes, media, parts))
    framed = parts.select(F.col("doc_id").alias("d"), F.col("node_id").alias("n"), F.struct("frag_ord", "entity", "filename", "kind", "title").alias("frag"))
    left = nodes.join(framed, (F.col("doc_id") == F.col("d")) & (F.col("node_id") == F.col("n")), "left").drop("d", "n")
    named = left if names is None else left.join(names.select("doc_id", F.col("name").alias("bundle")), "doc_id", "left")

    def build(own: pd.DataFrame, pictures: pd.DataFrame) -> pd.DataFrame:
        if own.empty:
            return pd.DataFrame(columns=["doc_id", "name", "files", "content"])
        doc = own["doc_id"].iloc[0]
        rows = own.astype(object).where(own.notna(), None).to_dict("records")
        made = element_of([(r["node_id"], r["parent_id"], r["ord"], r["tag"], r["text"], dict(r["attrs"] or {})) for r in rows])
        parents = {child: parent for parent in made.values() for child in parent}
        pictures = pictures.astype(object).where(pictures.notna(), None).to_dict("records")
        for p in pictures:
            if p["target"]:
                made[p["node_id"]].set("fileref", p["target"])
            elif (above := parents.get(made[p["node_id"]])) is not None:
                above.remove(made[p["node_id"]])
        root, used, members = made[0], set(), []
        parts_of = sorted(((r["frag"], r["node_id"]) for r in rows if r["frag"] is not None), key=lambda x: x[0]["frag_ord"])
        toc = [f"{f['title'] or f['filename']} ({f['filename']})" for f, _ in parts_of if f["kind"] == "chapter"]
        entities, first_toc = [], True
        for part, node in parts_of:
            part = dict(part) if isinstance(part, dict) else part.asDict()
            entity, file, k = part["entity"], part["filename"], 2
            while file in used:
                entity, file, k = f"{part['entity']}_{k}", part["filename"].replace(".xml", f"_{k}.xml"), k + 1
            used.add(file)
            if node == 0:
                element = ET.Element("chapter")
                for child in [c for c in root if c.tag not in ("bookinfo", "info")]:
                    root.remove(child)
                    element.append(child)
                root.append(ET.Comment(f"&{entity};"))
            else:
                element = made[node]
                at = list(root).index(element)
                root.remove(element)
                root.insert(at, ET.Comment(f"&{entity};"))
            if part["kind"] == "toc" and first_toc:
                first_toc = False
                for child in list(element):
                    element.remove(child)
                ET.SubElement(element, "title").text = part["title"]
                listed = ET.SubElement(element, "itemizedlist")
                for line in toc:
                    ET.SubElement(ET.SubElement(listed, "listitem"), "para").text = line
            entities.append((entity, file))
            members.append((file, xml_of(element, f'<!DOCTYPE {element.tag} SYSTEM "{dtd}">', instructions)))
        doctype = f'<!DOCTYPE {root.tag} SYSTEM "{dtd}" [\n' + "".join(f'  <!ENTITY {e} SYSTEM "{f}">\n' for e, f in entities) + "]>"
        book = xml_of(root, doctype, instructions)
        for entity, _ in entities:
            book = book.replace(f"<!--&{entity};-->".encode(), f"&{entity};".encode())
        listed = sorted((p for p in pictures if p["filename"]), key=lambda p: (p["frag_ord"], int("".join(c for c in p["figure_number"].split("_")[0] if c.isdigit())), p["node_id"]))
        files = {p["target"]: bytes(p["content"]) for p in pictures if p["target"] and p["content"] is not None}
        files |= {METADATA + "image_catalog.xml": catalog_xml(listed), METADATA + "image_manifest.csv": manifest_csv(listed)}
        folders = ["media/", "media/Book_Images/", CHAPTERS, SHARED, METADATA]
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for file, content in [("Book.xml", book), *members, *((f, b"") for f in folders), *sorted(files.items()), *assets.items()]:
                z.writestr(zipfile.ZipInfo(file, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
            order = z.namelist()
        name = own["bundle"].iloc[0] if "bundle" in own else None
        return pd.DataFrame([(doc, name or str(doc), order, out.getvalue())], columns=["doc_id", "name", "files", "content"])

    # both sides come of `nodes`: the images' columns are made anew, so that none means either
    images = images.select(*(F.col(c).alias(c) for c in images.columns))
    return named.groupBy("doc_id").cogroup(images.groupBy("doc_id")).applyInPandas(build, BUNDLE)


def write_bundles(made: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle as <name>.zip into a folder that executors share; (name, path) of each. Run again, it writes the same."""
    import os

    def write(batches):
        for pdf in batches:
            os.makedirs(folder, exist_ok=True)
            paths = []
            for name, content in zip(pdf["name"], pdf["content"]):
                path = os.path.join(folder, f"{name}.zip")
                with open(f"{path}.{os.getpid()}", "wb") as out:
                    out.write(content)
                os.replace(f"{path}.{os.getpid()}", path)
                paths.append(path)
            yield pd.DataFrame({"name": pdf["name"], "path": paths})

    return made.select("name", "content").mapInPandas(write, "name string, path string")
