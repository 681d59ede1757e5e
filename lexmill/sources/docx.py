"""Blocks of DOCX files: paragraphs and tables of the body in document order.

Files are scanned as binary rows and parsed where they lie, one file at a time; a file that cannot be read, or has no
block (empty), gives one row with its error and no block. Temporary files (~$) are left out.
"""

from __future__ import annotations

import html
import io
import unicodedata
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, pos int, kind string, text string, style string, is_bold boolean, is_italic boolean, error string"


def scan(spark: SparkSession, folder: str, suffix: str = ".docx") -> DataFrame:
    """path and content of the files below a folder whose name ends with the suffix in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(F.lower(name).endswith(suffix) & ~name.startswith("~$")).select("path", "content")


def _normal(text: str) -> str:
    return " ".join(unicodedata.normalize("NFC", text).replace("\u00a0", " ").split())


def _run_text(run: ET.Element) -> str:
    out = []
    for e in run.iter():
        if e.tag == W + "t":
            out.append(e.text or "")
        elif e.tag == W + "tab":
            out.append("\t")
        elif e.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def _text(paragraph: ET.Element) -> str:
    return "".join(_run_text(r) for r in paragraph.iter(W + "r"))


def _marked(paragraph: ET.Element, tag: str) -> bool:
    """Whether every run with a visible character carries the mark."""
    runs = [r for r in paragraph.iter(W + "r") if _run_text(r).strip()]

    def on(run: ET.Element) -> bool:
        e = run.find(f"{W}rPr/{W}{tag}")
        return e is not None and e.get(W + "val", "1") not in ("0", "false", "none")

    return bool(runs) and all(map(on, runs))


def _cell_lines(cell: ET.Element) -> list[str]:
    return [_normal(x) for p in cell.findall(W + "p") for x in _text(p).splitlines() if x.strip()]


def render_table(rows: list[list[list[str]]]) -> str:
    """A pipe table of rows of cells of lines; a single row becomes HTML, since it has no header."""
    if not rows:
        return ""
    if len(rows) == 1:
        cells = "".join(f"      <td>{'<br>'.join(map(html.escape, c))}</td>\n" for c in rows[0])
        return f"<table>\n  <tbody>\n    <tr>\n{cells}    </tr>\n  </tbody>\n</table>"
    width = max(map(len, rows))
    flat = [["<br>".join(c).replace("|", "\\|") for c in r] + [""] * (width - len(r)) for r in rows]
    return "\n".join(f"| {' | '.join(r)} |" for r in (flat[0], ["---"] * width, *flat[1:]))


def parse(content: bytes) -> list[tuple]:
    """(kind, text, style, is_bold, is_italic) of each block that isn't empty."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(W + "body")
    out = []
    for e in body if body is not None else ():
        if e.tag == W + "p":
            if text := _normal(_text(e)):
                style = e.find(f"{W}pPr/{W}pStyle")
                out.append(("paragraph", text, None if style is None else style.get(W + "val"), _marked(e, "b"), _marked(e, "i")))
        elif e.tag == W + "tbl":
            if text := render_table([[_cell_lines(c) for c in r.findall(W + "tc")] for r in e.findall(W + "tr")]):
                out.append(("table", text, None, False, False))
    return out


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """One row per block of each file; see SCHEMA."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                try:
                    rows = [(path, k + 1, *b, None) for k, b in enumerate(parse(content))] or [(path, 0, None, None, None, None, None, "empty")]
                except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
                    rows = [(path, 0, None, None, None, None, None, type(e).__name__)]
                yield pd.DataFrame(rows, columns=names)

    return scan(spark, folder).mapInPandas(run, SCHEMA)


def mirrored(path, source: str, target: str, suffix: str):
    """The output path of an input path: same place below the target folder, with another suffix."""
    return F.concat(F.lit(target.rstrip("/")), F.regexp_replace(F.replace(path, F.lit(source.rstrip("/")), F.lit("")), "\\.[^./]*$", suffix))
