"""A document's lines and images as labelled blocks.

What a line looks like by itself is told by column expressions before; what depends on the lines
around it is decided here, document by document in reading order, by one pass of a small machine.
Documents are the unit of work: their entries are sorted within one task, which holds one at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions.layout import GAP_EXTRA, GAP_FACTOR, INDENT, OUTDENT, TIGHT_GAP, column_positions
from foliospark.operators.lines import line_features

#: Drift of a table's columns between rows, its least rows and columns, its gap, a heading's font drift.
DRIFT, TABLE_ROWS, TABLE_COLUMNS, ROW_GAP, FONT_DRIFT = 25.0, 2, 2, 1.8, 1.0

BLOCK = "doc_id long, block_ord int, label string, text string, page_num int, top double, left double, width double, height double, font_size double, rows array<array<string>>, src string, list_type string, chapter_role string"
COLUMNS = [c.split()[0] for c in BLOCK.split(", ")]


def right_of(line: dict) -> float:
    return max((s["left"] + s["width"] for s in line["segments"]), default=line["left"])


def block_of(label: str, lines: list[dict], **more) -> dict:
    """A block over lines: their texts one below the other, the box around them, the largest size (none if no line has one)."""
    left, top = min(x["left"] for x in lines), lines[0]["top"]
    return {
        "label": label, "text": "\n".join(t for x in lines if (t := x["text"].strip())), "page_num": lines[0]["page_num"],
        "top": top, "left": left, "width": max(map(right_of, lines)) - left, "height": max(x["top"] + x["height"] for x in lines) - top,
        "font_size": max((x["font_size"] for x in lines if x["font_size"]), default=None), **more,
    }


def goes_on(a: dict, b: dict) -> bool:
    """Line b continues the paragraph that ends with line a."""
    gap, shift = b["top"] - a["top"], b["left"] - a["left"]
    return a["page_num"] == b["page_num"] and gap <= max(a["height"], b["height"]) * GAP_FACTOR + GAP_EXTRA and not (abs(shift) > INDENT and gap > min(a["height"], b["height"]) * TIGHT_GAP) and shift >= -OUTDENT


def table_at(lines: list[dict], start: int) -> int:
    """One past the last row of a table that begins at a line; `start` itself if none does."""
    first, end = lines[start]["columns"], start
    while end < len(lines):
        columns = lines[end]["columns"]
        if len(columns) < TABLE_COLUMNS or len(columns) != len(first) or any(abs(a - b) > DRIFT for a, b in zip(columns, first)):
            break
        end += 1
        if end < len(lines) and lines[end]["top"] - lines[end - 1]["top"] > max(lines[end - 1]["height"], lines[end]["height"]) * ROW_GAP:
            break
    return end if end - start >= TABLE_ROWS else start


def cells_of(line: dict, columns: list[float]) -> list[str]:
    """A row's cells: each segment goes to the nearest column, of equals the first."""
    cells = [""] * len(columns)
    for s in sorted(line["segments"], key=lambda s: (s["left"], s["ord"])):
        if text := s["text"] if s["text"].strip() else "":
            k = min(range(len(columns)), key=lambda i: abs(columns[i] - s["left"]))
            cells[k] = text.strip() if not cells[k] else cells[k] + ("" if cells[k].endswith(" ") or text.startswith(" ") else " ") + text
    return [c.strip() for c in cells]


class Labeller:
    """The machine over one document's entries: lines with features, and images."""

    def __init__(self, entries: list[dict], keep_images: bool = False):
        self.entries, self.blocks, self.open, self.keep_images = entries, [], [], keep_images
        self.at, self.titled, self.in_index, self.chapter_size, self.worded = 0, False, False, None, False
        self.wants_word = any(e["kind"] == "line" and e["keyword"] and e["heading_font"] for e in entries)
        self.lines = [e for e in entries if e["kind"] == "line"]
        self.line_number, n = [], 0
        for e in entries:
            self.line_number.append(n)
            n += e["kind"] == "line"

    def flush(self) -> None:
        if self.open:
            self.blocks.append(block_of("para", self.open))
            self.open = []

    def put(self, block: dict) -> None:
        self.flush()
        self.blocks.append(block)

    def run_from(self, joins) -> list[dict]:
        """The line here and those after it that join; stops at an image, a skipped line or one that does not join."""
        first, end = self.entries[self.at], self.at + 1
        while end < len(self.entries) and (e := self.entries[end])["kind"] == "line" and not e["skipped"] and joins(first, e):
            end += 1
        found, self.at = self.entries[self.at : end], end
        return found

    @staticmethod
    def like_size(a: dict, b: dict) -> bool:
        return bool(a["font_size"] and b["font_size"]) and abs(a["font_size"] - b["font_size"]) <= FONT_DRIFT

    def like_title(self, a: dict, b: dict) -> bool:
        return b["text"].strip().lower() != "table of contents" and a["page_num"] == b["page_num"] and (self.like_size(a, b) or b["title_like"])

    def chapter(self) -> None:
        """A chapter heading, or a section where chapters go by their word and size and this one does not."""
        lines = self.run_from(self.like_size)
        worded, size = any(x["keyword"] for x in lines), lines[0]["font_size"]
        if worded and size:
            accepted = self.chapter_size is None or abs(size - self.chapter_size) <= FONT_DRIFT
            self.chapter_size = size if accepted else self.chapter_size
        else:
            accepted = worded or not (self.wants_word and self.worded)
        if accepted:
            self.worded |= worded
        self.put(block_of("chapter" if accepted else "section", lines))

    def step(self) -> None:
        e = self.entries[self.at]
        if e["kind"] == "image":
            self.put({"label": "figure", "text": "", "page_num": e["page_num"], "src": e["src"], **{k: e[k] for k in ("top", "left", "width", "height")}})
        elif e["skipped"]:
            pass
        elif self.in_index and e["heading_font"]:
            if not e["index_like"]:
                if len(e["text"].strip()) > 1:
                    self.in_index = False
                    return
                self.put(block_of("para", [e]))
        elif (end := table_at(self.lines, self.line_number[self.at])) > self.line_number[self.at]:
            rows = self.lines[self.line_number[self.at] : end]
            columns = rows[0]["columns"]
            cells = [cells_of(r, columns) for r in rows]
            self.put({"label": "table", "text": "\n".join(" | ".join(r) for r in cells), "rows": cells, "page_num": e["page_num"], "top": e["top"], "left": min(columns), "width": max(columns) - min(columns), "height": rows[-1]["top"] - e["top"] + rows[-1]["height"]})
            left = len(rows)
            while left:
                skipped = self.entries[self.at]
                left -= skipped["kind"] == "line"
                if self.keep_images and skipped["kind"] == "image":
                    self.put({"label": "figure", "text": "", "page_num": skipped["page_num"], "src": skipped["src"], **{k: skipped[k] for k in ("top", "left", "width", "height")}})
                self.at += 1
            return
        elif e["index_like"]:
            self.put(block_of("chapter", self.run_from(self.like_size), chapter_role="index"))
            self.in_index = True
            return
        elif e["contents_like"]:
            self.put(block_of("toc", self.run_from(self.like_size)))
            return
        elif not self.titled and e["title_like"]:
            self.put(block_of("book_title", self.run_from(self.like_title)))
            self.titled = True
            return
        elif e["chapter_like"]:
            self.chapter()
            return
        elif e["section_like"] or e["caption_like"]:
            self.put(block_of("section" if e["section_like"] else "caption", [e]))
        elif e["list_type"]:
            self.put(block_of("list_item", [e]) | {"text": e["item"], "list_type": e["list_type"]})
        else:
            if self.open and not goes_on(self.open[-1], e):
                self.flush()
            self.open.append(e)
        self.at += 1

    def run(self) -> list[dict]:
        while self.at < len(self.entries):
            self.step()
        self.flush()
        return self.blocks


def label_document(pdf: pd.DataFrame, keep_images: bool = False) -> pd.DataFrame:
    """The blocks of one document's entries; images between a table's rows are dropped unless kept."""
    entries = pdf.sort_values(["page_ord", "top", "left", "kind", "ord"], kind="stable", key=lambda c: c.map({"line": 0, "image": 1}) if c.name == "kind" else c).to_dict("records")
    for e in entries:
        e["columns"] = list(e["columns"]) if e["columns"] is not None else []
        e["segments"] = list(e["segments"]) if e["segments"] is not None else []
    blocks = [{"doc_id": entries[0]["doc_id"], "block_ord": i, **b} for i, b in enumerate(Labeller(entries, keep_images).run())]
    return pd.DataFrame(blocks, columns=COLUMNS).astype(object).where(lambda d: d.notna(), None)


def label_blocks(lines: DataFrame, images: DataFrame | None, markers: list[str], keep_images: bool = False) -> DataFrame:
    """Blocks of assembled lines and, if given, images (doc_id, page_ord, page_num, ord, src, top, left, width, height).

    Features are computed before the one shuffle by document; skew is that of the largest document,
    which one task must hold, as its labels depend on each other from end to end."""
    featured = line_features(lines, markers).withColumn("columns", column_positions(F.transform("segments", lambda s: s["left"])))
    wanted = ["doc_id", "page_ord", "page_num", "top", "left", "height", "font_size", "text", "segments", "columns", "skipped", "heading_font", "title_like", "chapter_like", "index_like", "contents_like", "section_like", "caption_like", "keyword", "list_type", "item"]
    entries = featured.select(F.lit("line").alias("kind"), F.col("line_ord").alias("ord"), F.lit(None).cast("string").alias("src"), F.lit(0.0).alias("width"), *wanted)
    if images is not None:
        entries = entries.unionByName(images.where("src IS NOT NULL AND src <> ''").withColumn("kind", F.lit("image")), allowMissingColumns=True)
    return entries.groupBy("doc_id").applyInPandas(lambda pdf: label_document(pdf, keep_images), BLOCK)


def classify(blocks: DataFrame, classifier=None, threshold: float = 0.85, abstain: str = "abstain") -> DataFrame:
    """The blocks with classifier_label and classifier_confidence; texts stay as they are.

    `classifier` maps columns (label, text) to a struct of label and confidence, as a pandas UDF
    does; under `threshold` it abstains. Without one the label itself stands, with confidence 1."""
    if classifier is None:
        return blocks.withColumn("classifier_label", F.col("label")).withColumn("classifier_confidence", F.lit(1.0))
    said = blocks.withColumn("__c", classifier(F.col("label"), F.col("text")))
    sure = F.col("__c.confidence") >= threshold
    return said.withColumn("classifier_label", F.when(sure, F.col("__c.label")).otherwise(abstain)).withColumn("classifier_confidence", F.col("__c.confidence")).drop("__c")
