"""Rows of .xlsx workbooks as cell arrays, and their header rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, functions as F

from ventara.functions.text import clean

ROWS_SCHEMA = "file string, sheet string, row_no long, cells array<string>"
BATCH_ROWS = 5000

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
# Built-in number formats that show a date, and date letters in custom ones.
_DATE_FORMATS = frozenset((14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47))
_DATE_LETTERS = ("yy", "dd", "mm", "m/", "d/", "h:", "ss")


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(f"{_MAIN}t")) for item in root.findall(f"{_MAIN}si")]


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode", "").lower() for f in root.iter(f"{_MAIN}numFmt")}
    cell_formats = root.find(f"{_MAIN}cellXfs")
    styles = set()
    for i, xf in enumerate(cell_formats if cell_formats is not None else ()):
        number = int(xf.get("numFmtId", "0"))
        code = custom.get(number, "")
        if number in _DATE_FORMATS or ("[h]" not in code and any(x in code for x in _DATE_LETTERS)):
            styles.add(i)
    return styles


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    root = ElementTree.fromstring(book.read("xl/workbook.xml"))
    return [(s.get("name"), "xl/" + links[s.get(f"{_REL}id")].removeprefix("/xl/")) for s in root.iter(f"{_MAIN}sheet")]


def column_number(reference: str) -> int:
    """Zero-based column of a cell reference such as AB12."""
    number = 0
    for letter in re.match("[A-Za-z]*", reference).group().upper():
        number = number * 26 + ord(letter) - ord("A") + 1
    return max(number - 1, 0)


def serial_text(raw: str) -> str:
    """Text of a serial date: the day, or day and minute when it has a time."""
    moment = datetime(1899, 12, 30) + timedelta(days=float(raw))
    whole = (moment.hour, moment.minute, moment.second) == (0, 0, 0)
    return f"{moment:%Y-%m-%d}" if whole else f"{moment:%Y-%m-%d %H:%M}"


def _cell_text(cell, texts: list[str], date_styles: set[int]) -> str:
    kind = cell.get("t")
    if kind == "inlineStr":
        node = cell.find(f"{_MAIN}is/{_MAIN}t")
        return (node.text or "") if node is not None else ""
    value = cell.find(f"{_MAIN}v")
    raw = (value.text or "") if value is not None else ""
    if kind == "s" and raw:
        return texts[int(raw)] if int(raw) < len(texts) else raw
    if kind == "b":
        return "True" if raw == "1" else ""
    if raw and kind != "str" and int(cell.get("s", "0")) in date_styles:
        return serial_text(raw)
    return repr(float(raw)) if kind != "str" and re.fullmatch(r"-?\d+\.\d+", raw) else raw


def sheet_rows(content: bytes, only_sheet: str | None = None, max_rows: int | None = None) -> Iterator[tuple[str, int, list[str]]]:
    """(sheet, row number, cells) of a workbook; blank rows are skipped and not numbered."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        texts, styles = _shared_texts(book), _date_styles(book)
        for name, target in _sheets(book):
            if only_sheet is not None and name != only_sheet:
                continue
            width, count = 0, 0
            with book.open(target) as stream:
                for _, row in ElementTree.iterparse(stream):
                    if row.tag != f"{_MAIN}row":
                        continue
                    cells = {column_number(c.get("r", "A1")): _cell_text(c, texts, styles) for c in row.findall(f"{_MAIN}c")}
                    row.clear()
                    width = max([width, *[i + 1 for i in cells]])
                    listed = [cells.get(i, "") for i in range(width)]
                    if not any(c.strip() for c in listed):
                        continue
                    yield name, count, listed
                    count += 1
                    if max_rows and count >= max_rows:
                        break


def read_workbooks(spark: SparkSession, path, sheet: str | None = None, max_rows: int | None = None) -> DataFrame:
    """Rows of all workbooks under a path (any file system Spark reads): file (its whole path), sheet, row_no and cells.

    Spark lists the files and spreads them over tasks; a task decodes one workbook at a time and
    emits its rows in batches. A sheet holds about a million rows at most by its format.
    """
    import pandas as pd

    def decode(batches):
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                found = False
                rows = []
                for name, number, cells in sheet_rows(content, sheet, max_rows):
                    found = True
                    rows.append((file, name, number, cells))
                    if len(rows) >= BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=["file", "sheet", "row_no", "cells"])
                        rows = []
                if sheet is not None and not found:
                    raise ValueError(f"no sheet {sheet!r} with rows in {file}")
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "sheet", "row_no", "cells"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(decode, ROWS_SCHEMA)


def file_label(file="file"):
    """Base name of a file, to show; two files may share it, so rows are keyed by the whole path."""
    return F.substring_index(file, "/", -1)


def preview_sheet(spark: SparkSession, path, sheet: str, n: int = 12) -> DataFrame:
    """First rows of a sheet."""
    return read_workbooks(spark, path, sheet, n)


def header_rows(rows: DataFrame, first: int = 10) -> DataFrame:
    """Header row per sheet: the best scored among the first rows, the earlier one on equal score.

    The score adds 0.7 per filled cell, up to 5 for distinct texts and up to 5 for texts with letters.
    """
    filled = F.filter(F.transform("cells", clean), lambda c: c != "")
    n = F.size(filled)
    unique = F.size(F.array_distinct(filled)) / n
    letters = F.size(F.filter(filled, lambda c: c.rlike(r"\p{L}"))) / n
    scored = rows.filter((F.col("row_no") < first) & (n > 0)).withColumn("score", n * 0.7 + unique * 5 + letters * 5)
    best = scored.groupBy("file", "sheet").agg(F.max_by(F.struct("row_no", "cells"), F.struct("score", -F.col("row_no"))).alias("best"))
    return best.select("file", "sheet", F.col("best.row_no").alias("header_row"), make_headers("best.cells").alias("headers"))


def make_headers(cells):
    """Header texts; a blank one is named after its position."""
    return F.transform(cells, lambda c, i: F.coalesce(F.nullif(clean(c), F.lit("")), F.concat(F.lit("Columna "), (i + 1).cast("string"))))


def data_rows(rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Rows below the header, numbered from one, with the sheet's headers."""
    headers = headers if headers is not None else header_rows(rows)
    joined = rows.join(headers, ["file", "sheet"]).filter(F.col("row_no") > F.col("header_row"))
    return joined.select("file", "sheet", (F.col("row_no") - F.col("header_row")).alias("row_no"), "headers", "cells")
