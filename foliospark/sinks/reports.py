"""Quality reports as CSV and HTML, whole documents as XML."""

from __future__ import annotations

from html import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.plans.tree import element_of, xml_of

REPORT = ["file", "page", "chars_in", "chars_out", "words_in", "words_out", "checksum_in", "checksum_out", "flags", "has_ocr", "status"]


def write_csv(report: DataFrame, path: str) -> None:
    """The report rows as CSV with a header, sorted within files."""
    report.select(*REPORT).sortWithinPartitions("file", "page").write.mode("overwrite").csv(path, header=True, emptyValue="")


def html_reports(report: DataFrame) -> DataFrame:
    """(file, html): one table a file, rows in page order, those with a discrepancy marked."""
    head = "".join(f"<th>{name.replace('_', ' ').title()}</th>" for name in REPORT[1:])

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        file = pdf["file"].iloc[0]
        body = "".join(
            f"<tr{' class="has-discrepancy"' if r.status == 'discrepancy' else ''}>" + "".join(f"<td>{escape(str(getattr(r, n)))}</td>" for n in REPORT[1:]) + "</tr>" for r in pdf.sort_values("page").itertuples()
        )
        return pd.DataFrame([(file, html_page(file, head, body))], columns=["file", "html"])

    return report.select(*REPORT).groupBy("file").applyInPandas(page, "file string, html string")


def html_page(file: str, head: str, body: str) -> str:
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Quality of {escape(file)}</title></head><body><h1>{escape(file)}</h1><table><thead><tr>{head}</tr></thead><tbody>{body or "<tr><td>No pages processed</td></tr>"}</tbody></table></body></html>'


def book_xml(nodes: DataFrame, dtd: str, instructions: list[tuple[str, str]] = ()) -> DataFrame:
    """(doc_id, xml): each document's tree written out."""

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.astype(object).where(pdf.notna(), None)
        root = element_of([(r.node_id, r.parent_id, r.ord, r.tag, r.text, dict(r.attrs or {})) for r in rows.itertuples()])[0]
        return pd.DataFrame([(pdf["doc_id"].iloc[0], xml_of(root, f'<!DOCTYPE {root.tag} SYSTEM "{dtd}">', instructions).decode())], columns=["doc_id", "xml"])

    return nodes.groupBy("doc_id").applyInPandas(write, "doc_id long, xml string")


def output_pages(nodes: DataFrame) -> DataFrame:
    """(doc_id, text): what a tree says, in document order, to compare a bundle's text with the pages it came from."""
    return nodes.where("text IS NOT NULL AND trim(text) <> ''").groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), "\n").alias("text"))
