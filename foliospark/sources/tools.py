"""External programs that read PDF files, run where a file lies; each is an option, none is needed to import."""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def run(args: list[str], folder: str | None = None, env: dict[str, str] | None = None) -> bytes:
    """A program's output; RuntimeError with what it said if it fails or is not there."""
    if shutil.which(args[0]) is None:
        raise RuntimeError(f"{args[0]} is not installed")
    done = subprocess.run(args, cwd=folder, env=os.environ | (env or {}), capture_output=True)
    if done.returncode:
        raise RuntimeError(f"{args[0]} ended with {done.returncode}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def missing(programs: list[str], modules: list[str] = ()) -> list[str]:
    """Those programs and modules that are not installed; of modules only their packages, each once."""
    from importlib.util import find_spec

    return sorted({p for p in programs if shutil.which(p) is None} | {m.split(".")[0] for m in modules if find_spec(m.split(".")[0]) is None})


def _text(path: str) -> bytes:
    return run(["pdftotext", "-enc", "UTF-8", "-layout", path, "-"])


def _layout(path: str) -> bytes:
    target = os.path.join(os.path.dirname(path), "layout")
    run(["pdftohtml", "-xml", "-hidden", "-nodrm", "-zoom", "1.0", path, target], os.path.dirname(path))
    with open(target + ".xml", "rb") as out:
        return out.read()


def _mined(path: str) -> bytes:
    try:
        from pdfminer.high_level import extract_text
    except ImportError as wrong:
        raise RuntimeError("pdfminer is not installed") from wrong
    return extract_text(path).encode()


def _ocr(path: str, pages: str = "") -> bytes:
    if not pages:
        with open(path, "rb") as same:
            return same.read()
    run(["ocrmypdf", "--force-ocr", "--pages", pages, path, path + ".ocr"])
    with open(path + ".ocr", "rb") as out:
        return out.read()


TOOLS = {"text": _text, "layout": _layout, "mined": _mined, "ocr": _ocr}


def _made(folder: str) -> list[dict]:
    """The files that a program left beside its input and its own output."""
    found = []
    for name in sorted(os.listdir(folder)):
        if name not in ("in.pdf", "layout.xml") and os.path.isfile(os.path.join(folder, name)):
            with open(os.path.join(folder, name), "rb") as one:
                found.append({"ref": name, "content": one.read()})
    return found


def extract(files: DataFrame, tool: str, media: bool = False) -> DataFrame:
    """(doc_id, output, error): what a tool makes of each (doc_id, content[, pages]); one file's failure is its own.

    `text` gives pages apart by form feeds, `layout` layout XML, `mined` the second extraction,
    `ocr` the PDF with the pages of `pages` read again, unchanged where that is empty. With
    `media` there is a column of that name too: the files that the tool wrote, by the names (ref)
    that its output has for them."""
    work, paged = TOOLS[tool], tool == "ocr"
    names = ["doc_id", "output", "error", *(["media"] if media else [])]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, (doc, content) in enumerate(zip(pdf["doc_id"], pdf["content"])):
                with tempfile.TemporaryDirectory() as folder:
                    path = os.path.join(folder, "in.pdf")
                    with open(path, "wb") as out:
                        out.write(bytes(content))
                    try:
                        output = work(path, pdf["pages"].iloc[i] or "") if paged else work(path)
                        # names without the folder, which is gone with this file
                        rows.append((doc, output.replace(os.fsencode(folder + os.sep), b"") if media else output, None, _made(folder) if media else []))
                    except (RuntimeError, OSError) as wrong:
                        rows.append((doc, None, str(wrong), []))
            yield pd.DataFrame(rows, columns=["doc_id", "output", "error", "media"])[names]

    return files.select("doc_id", "content", *(["pages"] if paged else [])).mapInPandas(each, "doc_id long, output binary, error string" + ", media array<struct<ref string, content binary>>" * media)
