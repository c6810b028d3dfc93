"""Lines of a layout: put together from positioned text, with the features that labelling needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions import layout as L
from foliospark.functions.text import clean_join, list_item, strip

#: Tops within this of the line's first node are on the line.
SAME_LINE = 2.0
SEGMENT = "struct<left:double,ord:int,width:double,font_size:double,text:string>"
LINE = f"doc_id long, page_ord int, line_ord int, page_num int, page_width double, page_height double, top double, left double, height double, font_size double, segments array<{SEGMENT}>"


def with_font_size(nodes: DataFrame, fontspecs: DataFrame) -> DataFrame:
    """The text nodes with font_size: that of their fontspec where there is one, else their own; none is 0.

    Of several specs of an id the last counts. A spec without a size gives 0, not the node's own."""
    last = fontspecs.groupBy("doc_id", "font_id").agg(F.max_by(F.struct(F.col("size").try_cast("double").alias("size")), "ord").alias("spec"))
    size = F.when(F.col("spec").isNotNull(), F.col("spec.size")).otherwise(F.col("size").try_cast("double"))
    return nodes.join(last, ["doc_id", "font_id"], "left").withColumn("font_size", F.coalesce(size, F.lit(0.0))).drop("spec")


def assemble_lines(nodes: DataFrame) -> DataFrame:
    """Lines of text nodes, page by page: a node joins the last line if its top is near that of the line's first node.

    That line's first node, not the one before, so a gap window cannot express it: pages are folded
    in order, as arrays, in one pass without leaving the JVM. A page's nodes are its bound. Blank
    nodes are dropped; sizes and heights are the greatest, left the least."""
    used = nodes.where(strip(F.coalesce("content", F.lit(""))) != "")
    page = ["doc_id", "page_ord", "page_num", "page_width", "page_height"]
    node = F.struct(L.zero(F.col("top")).alias("top"), L.zero(F.col("left")).alias("left"), F.col("node_ord").alias("ord"), L.zero(F.col("width")).alias("width"), L.zero(F.col("height")).alias("height"), L.zero(F.col("font_size")).alias("font_size"), F.col("content").alias("text"))
    pages = used.groupBy(*page).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    segment = "named_struct('left', n.left, 'ord', n.ord, 'width', n.width, 'font_size', n.font_size, 'text', n.text)"
    line = f"named_struct('top', n.top, 'left', n.left, 'height', n.height, 'font_size', n.font_size, 'segments', array({segment}))"
    last = "element_at(lines, -1)"
    grown = f"named_struct('top', {last}.top, 'left', least({last}.left, n.left), 'height', greatest({last}.height, n.height), 'font_size', greatest({last}.font_size, n.font_size), 'segments', concat({last}.segments, array({segment})))"
    empty = f"cast(array() as array<struct<top:double,left:double,height:double,font_size:double,segments:array<{SEGMENT}>>>)"
    fold = f"aggregate(nodes, {empty}, (lines, n) -> case when size(lines) > 0 and abs({last}.top - n.top) <= {SAME_LINE} then concat(slice(lines, 1, size(lines) - 1), array({grown})) else concat(lines, array({line})) end)"
    lines = pages.select(*page, F.posexplode(F.expr(fold)).alias("line_ord", "l")).select(*page, "line_ord", "l.*")
    return lines.withColumn("text", clean_join(F.col("segments"))).where(strip(F.col("text")) != "")


def segment_lines(segments: DataFrame) -> DataFrame:
    """(line_id, text, segments, right, columns) of stored segments: each distinct segment once, in order."""
    one = F.struct(F.col("left_pos").alias("left"), F.col("seg_ord").alias("ord"), L.zero(F.col("width")).alias("width"), L.zero(F.col("font_size")).alias("font_size"), F.col("text").alias("text"))
    lines = segments.groupBy("line_id").agg(F.array_sort(F.collect_set(one)).alias("segments"))
    lefts = F.transform("segments", lambda s: s["left"])
    return lines.select("line_id", clean_join(F.col("segments")).alias("text"), "segments", L.line_right(F.element_at(lefts, 1), F.col("segments")).alias("right"), L.column_positions(lefts).alias("columns"))


def body_sizes(lines: DataFrame) -> DataFrame:
    """(doc_id, body): the median size of a document's long lines, of any sized line where none is long, else 12."""
    sized = F.when(L.zero(F.col("font_size")) > 0, F.col("font_size"))
    long = F.when(F.length(strip(F.col("text"))) >= L.BODY_CHARS, sized)
    return lines.groupBy("doc_id").agg(F.coalesce(F.median(long), F.median(sized), F.lit(L.BODY_DEFAULT)).alias("body"))


def line_features(lines: DataFrame, markers: list[str]) -> DataFrame:
    """The lines with what each by itself looks like; body sizes are joined by document."""
    df = lines.join(body_sizes(lines), "doc_id")
    text, top, height, size, body, page = (F.col(c) for c in ("text", "top", "page_height", "font_size", "body", "page_num"))
    item = list_item(strip(text), markers)
    return df.withColumns(
        {
            "skipped": L.is_header_footer(text, top, height),
            "heading_font": L.has_heading_font(size, body),
            "title_like": L.is_book_title(text, page, top, height, size, body),
            "chapter_like": L.is_chapter_heading(text, top, height, size, body),
            "index_like": L.is_index_heading(text, size, body),
            "contents_like": L.is_contents_heading(text, size, body),
            "section_like": L.is_section_heading(text, size, body),
            "caption_like": L.is_caption(text),
            "keyword": strip(text).rlike(L.CHAPTER_WORD),
            "list_type": item["list_type"],
            "item": item["item"],
        }
    )


def single_labels(features: DataFrame) -> Column:
    """The label of a line by itself, by the order in which labels outrank each other."""
    return (
        F.when(F.col("skipped"), "skipped")
        .when(F.col("index_like"), "index")
        .when(F.col("contents_like"), "toc")
        .when(F.col("title_like"), "book_title")
        .when(F.col("chapter_like"), "chapter")
        .when(F.col("section_like"), "section")
        .when(F.col("caption_like"), "caption")
        .when(F.col("list_type").isNotNull(), "list_item")
        .otherwise("para")
    )


def with_gap(lines: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The lines with `gap`: how far below the next line begins; null for the last."""
    return lines.withColumn("gap", F.lead("top").over(Window.partitionBy(*keys).orderBy(*order)) - F.col("top"))


def paragraphs(lines: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, para, page_num, lines, text, top, left, bottom): neighbouring lines that go on with each other.

    A line continues its predecessor by gap, indent and page alone, so the break flags and their
    running sum give the paragraphs without a fold."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    before = lambda c: F.lag(c).over(w)
    goes_on = L.continues(F.col("page_num"), F.col("top"), F.col("left"), F.col("height"), before("page_num"), before("top"), before("left"), before("height"))
    marked = lines.withColumn("__b", F.when(goes_on, 0).otherwise(1))
    numbered = marked.withColumn("para", F.sum("__b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct(*order, strip(F.col("text")).alias("__t"))))
    return numbered.groupBy("doc_id", "para").agg(F.first("page_num").alias("page_num"), F.count("*").alias("lines"), F.array_join(F.transform(ordered, lambda x: x["__t"]), "\n").alias("text"), F.min("top").alias("top"), F.min("left").alias("left"), F.max(F.col("top") + F.col("height")).alias("bottom"))


def islands(rows: DataFrame, keys: list[str], order: list[str], value: Column) -> DataFrame:
    """The rows with `island`: the number, from 1, of the run of equal values they are in, in order; null equals null."""
    w = Window.partitionBy(*keys).orderBy(*order)
    same = F.lag(value).over(w).eqNullSafe(value) & (F.row_number().over(w) > 1)
    return rows.withColumn("__new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def containers(rows: DataFrame, keys: list[str], order: list[str], label: Column) -> DataFrame:
    """The rows with `container`: the index open at a row, else the section since the chapter, else the chapter, else root.

    A label of `index` opens an index, a chapter closes index and section; containers are named by
    kind and ordinal of the row that opened them."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    df = rows.withColumn("__at", at).withColumn("__label", label)
    last = lambda *kinds: F.max(F.when(F.col("__label").isin(*kinds), F.col("__at"))).over(w)
    df = df.withColumn("__chapter", last("chapter", "toc")).withColumn("__section", last("section")).withColumn("__index", last("index")).withColumn("__closer", last("chapter"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    index_open = zero(F.col("__index")) > zero(F.col("__closer"))
    opened = F.greatest(zero(F.col("__chapter")), zero(F.col("__index")))
    section_open = zero(F.col("__section")) > opened
    chapter_open = zero(F.col("__chapter")) > zero(F.col("__index"))
    name = F.when(index_open, F.concat(F.lit("index"), "__index")).when(section_open, F.concat(F.lit("section"), "__section")).when(chapter_open, F.concat(F.lit("chapter"), "__chapter")).otherwise("root")
    return df.withColumn("container", name).drop("__at", "__label", "__chapter", "__section", "__index", "__closer")
