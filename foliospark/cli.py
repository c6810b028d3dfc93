"""Commands: pdf, epub, batch, validate. A batch converts all of its jobs of a kind in one plan."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path
from xml.etree import ElementTree as ET

from pyspark.sql import functions as F

from foliospark import config
from foliospark.operators.pages import page_ranges, report_rows, split_pages
from foliospark.pipeline import Converted, convert_epubs, convert_layouts, to_read_again
from foliospark.plans.tree import NODE, rows_of
from foliospark.session import cut, local_session
from foliospark.sinks.reports import write_csv
from foliospark.sources.markup import read_manifest
from foliospark.sources.tools import extract, missing
from foliospark.validation import compile_type, violations


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="foliospark", description=__doc__)
    top.add_argument("--config-dir", default=None)
    top.add_argument("--report-dir", default="reports")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("pdf", "epub"):
        one = commands.add_parser(name)
        one.add_argument("--input", required=True, type=existing_file)
        one.add_argument("--out", required=True)
        one.add_argument("--publisher", required=True)
        one.add_argument("--strict", action="store_true")
        if name == "pdf":
            one.add_argument("--ocr-on-image-only", action="store_true")
    batch = commands.add_parser("batch")
    batch.add_argument("--manifest", required=True, type=existing_file)
    batch.add_argument("--parallel", type=int, default=8)
    batch.add_argument("--strict", action="store_true")
    validate = commands.add_parser("validate")
    validate.add_argument("--input", required=True, type=existing_file)
    validate.add_argument("--dtd", required=True, type=existing_file)
    return top


def existing_file(path: str) -> str:
    if not Path(path).is_file():
        raise argparse.ArgumentTypeError(f"no such file: {path}")
    return path


def _convert_pdfs(files, again: list[int], settings: dict, strict: bool) -> tuple[Converted, list[int]]:
    """The conversion of PDF files, image-only pages of those in `again` read by the ocr tool first; those it failed on."""

    def pages_of(files):
        return cut(split_pages(extract(files, "text").select("doc_id", F.decode("output", "UTF-8").alias("t")), "doc_id", "t"))

    pages, blank, unread = pages_of(files), None, []
    if again:
        blank = cut(to_read_again(pages, pages, settings).where(F.col("doc_id").isin(again)))
        read = cut(extract(files.join(page_ranges(blank).withColumnRenamed("ranges", "pages"), "doc_id"), "ocr"))
        unread = [r.doc_id for r in read.where("output IS NULL").collect()]
        blank = blank.where(~F.col("doc_id").isin(unread)) if unread else blank
        files = cut(files.join(read.select("doc_id", "output"), "doc_id", "left").select("doc_id", F.coalesce("output", "content").alias("content")))
        pages = pages_of(files)
    layouts = cut(extract(files, "layout", media=True))
    media = layouts.select("doc_id", F.inline("media"))
    return convert_layouts(pages, pages, layouts.select("doc_id", F.col("output").alias("content")), media, settings, strict, bool(again), blank), unread


def _convert(spark, jobs: list[dict], kind: str, args) -> list[str]:
    """Bundles and reports of the jobs of a kind and publisher; the inputs that failed."""
    failed = []
    for publisher in sorted({j["publisher"] or "" for j in jobs}):
        own = [j for j in jobs if (j["publisher"] or "") == publisher]
        settings = config.load(args.config_dir, publisher)
        readable = [j for j in own if j["input"] and j["out"] and Path(j["input"]).is_file()]
        failed += [j["input"] for j in own if j not in readable]
        if not readable:
            continue
        files = spark.createDataFrame([(i, bytearray(Path(j["input"]).read_bytes())) for i, j in enumerate(readable)], "doc_id long, content binary")
        if kind == "epub":
            made = convert_epubs(files, settings, args.strict)
        else:
            again = [i for i, j in enumerate(readable) if str(j.get("ocr_on_image_only") or "").lower() in ("true", "1", "yes")]
            if lacking := missing(["pdftotext", "pdftohtml", *(["ocrmypdf"] if again else [])]):
                raise RuntimeError("not installed: " + ", ".join(lacking))
            made, unread = _convert_pdfs(files, again, settings, args.strict)
            failed += [readable[i]["input"] for i in unread]
        failed += [readable[r.doc_id]["input"] for r in made.errors.collect()]
        for row in made.bundles.select("doc_id", "content").toLocalIterator():
            target = Path(readable[row.doc_id]["out"])
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(row.content)
            print(target)
        names = spark.createDataFrame([(i, j["input"]) for i, j in enumerate(readable)], "doc_id long, file string")
        write_csv(report_rows(made.quality.join(names, "doc_id"), F.col("file")), str(Path(args.report_dir, f"{kind}_{publisher or 'none'}_qa")))
    return failed


def _isolated(spark, jobs: list[dict], kind: str, args) -> list[str]:
    """The inputs that failed; where jobs together fail, each half by itself, so that a bad one takes no other with it."""
    try:
        return _convert(spark, jobs, kind, args)
    except Exception as wrong:  # noqa: BLE001 - whatever one job meets must not end the others
        if len(jobs) > 1:
            middle = len(jobs) // 2
            return _isolated(spark, jobs[:middle], kind, args) + _isolated(spark, jobs[middle:], kind, args)
        print(f"{kind}: {jobs[0]['input']}: {wrong}", file=sys.stderr)
        return [jobs[0]["input"]]


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 1 if a job failed or a document is not valid."""
    args = parser().parse_args(argv)
    spark = local_session(getattr(args, "parallel", 8))
    if args.command == "validate":
        nodes = spark.createDataFrame(rows_of(0, ET.fromstring(Path(args.input).read_bytes())), NODE)
        kind = compile_type(Path(args.dtd).read_text(encoding="utf-8", errors="replace"), Path(args.dtd).parent)
        found = violations(nodes, kind).sort("node_id").collect()
        for v in found:
            print(f"{v.tag} (node {v.node_id}): {v.rule} {v.detail}".rstrip(), file=sys.stderr)
        print("valid" if not found else "not valid")
        return int(bool(found))
    if args.command == "batch":
        jobs = [r.asDict() for r in read_manifest(spark, args.manifest).toLocalIterator()]
    else:
        jobs = [{"type": args.command, "input": args.input, "out": args.out, "publisher": args.publisher, "ocr_on_image_only": getattr(args, "ocr_on_image_only", False)}]
    failed = [j["input"] for j in jobs if j["type"] not in ("pdf", "epub")]
    for kind in ("pdf", "epub"):
        if own := [j for j in jobs if j["type"] == kind]:
            failed += _isolated(spark, own, kind, args)
    for name in failed:
        print(f"failed: {name}", file=sys.stderr)
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
