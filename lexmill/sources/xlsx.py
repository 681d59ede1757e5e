"""Rows of XLSX sheets, by zip and XML only."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .docx import scan

M = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse(content: bytes, sheet: str = "xl/worksheets/sheet1.xml") -> list[list[str | None]]:
    """Cells of the first sheet as text; blank ones are None."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(M + "t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall(M + "si")]
        root = ET.fromstring(z.read(sheet))
    rows = []
    for r in root.iter(M + "row"):
        cells: dict[int, str | None] = {}
        for c in r.findall(M + "c"):
            letters = re.match(r"[A-Z]+", c.get("r", "A"))[0]
            column = 0
            for x in letters:
                column = column * 26 + ord(x) - 64
            v = c.find(M + "v")
            if c.get("t") == "s" and v is not None:
                cells[column] = shared[int(v.text)]
            elif c.get("t") == "inlineStr":
                cells[column] = "".join(t.text or "" for t in c.iter(M + "t"))
            else:
                cells[column] = None if v is None else v.text
        rows.append([cells.get(k) or None for k in range(1, max(cells, default=0) + 1)])
    return rows


def read_xlsx(spark: SparkSession, folder: str) -> DataFrame:
    """path, row, column (name from the first row) and value: one row per cell that isn't blank."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"], pdf["content"]):
                head, *rest = parse(content) or [[]]
                out += [(path, k, head[j], v) for k, row in enumerate(rest, 1) for j, v in enumerate(row) if v is not None and j < len(head) and head[j]]
            yield pd.DataFrame(out, columns=["path", "row", "column", "value"])

    return scan(spark, folder, ".xlsx").mapInPandas(run, "path string, row int, column string, value string")


def metric_means(cells: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean and count per metric; blanks and text don't count."""
    from pyspark.sql import functions as F

    value = F.col("value").try_cast("double")
    return cells.filter(F.col("column").isin(metrics)).groupBy(F.col("column").alias("metric")).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))
