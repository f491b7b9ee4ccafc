"""Workbooks (.xlsx, .xlsm): one task per file, rows out in small frames.

A workbook is a zip archive and cannot be split; uploads are limited to 50 MB, which bounds
the task. Spark reads, distributes and retries the files; the code below only takes cells out
of one archive.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from decimal import Decimal
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_SCHEMA = (
    "source_file string, sheet_index int, sheet_name string, source_row_index bigint, "
    "cells array<struct<header:string,value:string>>"
)
#: row index of the record that describes a sheet itself, so that empty sheets are seen
SHEET_ROW = -1
FRAME_ROWS = 2_000
#: shown for a cell that holds an object without any text
OPAQUE = "[object Object]"
BUILTIN_DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_workbooks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Every row of every sheet, plus one record per sheet with index SHEET_ROW."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_frames, ROW_SCHEMA)


def data_rows(scan: DataFrame) -> DataFrame:
    return scan.filter(F.col("source_row_index") >= 0)


def sheet_list(scan: DataFrame) -> DataFrame:
    """Sheets with their headers and row counts, empty sheets included."""
    described = F.col("source_row_index") == SHEET_ROW
    return scan.groupBy("source_file", "sheet_index", "sheet_name").agg(
        F.max(F.when(described, F.col("cells.header"))).alias("headers"),
        F.count_if(~described).alias("row_count"),
    )


def _frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["source_file", "sheet_index", "sheet_name", "source_row_index", "cells"]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            held: list[tuple] = []
            for row in _workbook_rows(content):
                held.append((path, *row))
                if len(held) == FRAME_ROWS:
                    yield pd.DataFrame(held, columns=names)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=names)


def _workbook_rows(content: bytes) -> Iterator[tuple]:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        book = ElementTree.fromstring(archive.read("xl/workbook.xml"))
        links = {
            rel.get("Id"): rel.get("Target")
            for rel in ElementTree.fromstring(archive.read("xl/_rels/workbook.xml.rels"))
        }
        props = book.find(f"{_MAIN}workbookPr")
        late = props is not None and props.get("date1904") in ("1", "true")
        shared = _shared_strings(archive)
        dated = _date_styles(archive)
        for index, sheet in enumerate(book.iter(f"{_MAIN}sheet")):
            target = links[sheet.get(f"{_REL}id")]
            part = target.lstrip("/") if target.startswith("/") else posixpath.join("xl", target)
            merges = _merges(archive, part)
            headers: list[str] | None = None
            kept = 0
            for number, cells in _sheet_cells(archive, part, shared, dated, late, merges):
                if number == 1:
                    headers = _headers(cells)
                    yield index, sheet.get("name"), SHEET_ROW, [
                        {"header": h, "value": None} for h in headers if h
                    ]
                    continue
                if headers is None:
                    headers = []
                    yield index, sheet.get("name"), SHEET_ROW, []
                if all(text in (None, "") for text, _ in cells.values()):
                    continue
                yield index, sheet.get("name"), kept, [
                    {"header": h, "value": cells.get(i, (None, True))[0]}
                    for i, h in enumerate(headers) if h
                ]
                kept += 1
            if headers is None:
                yield index, sheet.get("name"), SHEET_ROW, []


def _headers(cells: dict[int, tuple[str | None, bool]]) -> list[str]:
    """Header texts by column; a header that is not plain text shows as an opaque object."""
    width = max(cells, default=-1) + 1
    out = []
    for i in range(width):
        text, plain = cells.get(i, (None, True))
        out.append((text or "").strip() if plain else OPAQUE)
    return out


def _sheet_cells(archive, part, shared, dated, late, merges):
    """Row number and {column: (text, is plain)} for every row present in the sheet."""
    masters: dict[tuple[int, int], tuple[str | None, bool]] = {}
    inner = {cell: master for master, cells in merges.items() for cell in cells}
    with archive.open(part) as stream:
        number = 0
        for _, row in ElementTree.iterparse(stream):
            if row.tag != f"{_MAIN}row":
                continue
            number = int(row.get("r") or number + 1)
            cells: dict[int, tuple[str | None, bool]] = {}
            for place, c in enumerate(row.findall(f"{_MAIN}c")):
                column = _column(c.get("r")) if c.get("r") else place
                cells[column] = _flatten(c, shared, dated, late)
            for column, value in cells.items():
                if (number, column) in merges:
                    masters[number, column] = value
            for (r, column), master in inner.items():
                if r == number and master in masters:
                    cells[column] = masters[master]
            row.clear()
            yield number, cells


def _flatten(c, shared, dated, late) -> tuple[str | None, bool]:
    """Text of a cell: its text, else the formula's result, else an opaque object."""
    kind = c.get("t", "n")
    value = c.find(f"{_MAIN}v")
    raw = value.text if value is not None else None
    plain = c.find(f"{_MAIN}f") is None
    if kind == "inlineStr":
        text, simple = _rich(c.find(f"{_MAIN}is"))
        return text, plain and simple
    if raw is None:
        return (None, True) if plain else (OPAQUE, False)
    if kind == "s":
        text, simple = shared[int(raw)]
        return text, plain and simple
    if kind == "b":
        return ("true" if raw == "1" else "false"), plain
    if kind == "e":
        return OPAQUE, False
    if kind in ("str", "d"):
        return raw, plain
    if int(c.get("s", 0)) in dated:
        return _iso(float(raw), late), plain
    return _number(raw), plain


def _number(raw: str) -> str:
    """Shortest decimal text, without exponent, so that it coerces like the number itself."""
    value = float(raw)
    return str(int(value)) if value == int(value) else format(Decimal(repr(value)), "f")


def _iso(serial: float, late: bool) -> str:
    days = serial - 25569 + (1462 if late else 0)
    at = datetime(1970, 1, 1) + timedelta(milliseconds=round(days * 86_400_000))
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def _rich(node) -> tuple[str, bool]:
    """Joined text of a string item and whether it is one plain run."""
    if node is None:
        return "", True
    runs = node.findall(f"{_MAIN}r")
    if not runs:
        text = node.find(f"{_MAIN}t")
        return ((text.text or "") if text is not None else ""), True
    return "".join((r.findtext(f"{_MAIN}t") or "") for r in runs), False


def _shared_strings(archive) -> list[tuple[str, bool]]:
    if "xl/sharedStrings.xml" not in archive.namelist():
        return []
    return [_rich(si) for si in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")).findall(f"{_MAIN}si")]


def _date_styles(archive) -> set[int]:
    """Positions of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in archive.namelist():
        return set()
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    custom = {
        int(f.get("numFmtId")): re.sub(r'\[[^\]]*\]|"[^"]*"', "", f.get("formatCode", ""))
        for f in root.iter(f"{_MAIN}numFmt")
    }
    formats = root.find(f"{_MAIN}cellXfs")
    out = set()
    for i, xf in enumerate(formats if formats is not None else []):
        number = int(xf.get("numFmtId", 0))
        shown = re.search("[ymdhMsb]", custom[number]) if number in custom else number in BUILTIN_DATES
        if shown:
            out.add(i)
    return out


def _merges(archive, part) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """Merged areas: top-left cell -> the other cells, which show its value."""
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    with archive.open(part) as stream:
        for _, node in ElementTree.iterparse(stream):
            if node.tag == f"{_MAIN}mergeCell":
                start, _, end = node.get("ref").partition(":")
                r0, c0, r1, c1 = _row(start), _column(start), _row(end or start), _column(end or start)
                out[r0, c0] = [(r, c) for r in range(r0, r1 + 1) for c in range(c0, c1 + 1)
                               if (r, c) != (r0, c0)]
            elif node.tag == f"{_MAIN}row":
                node.clear()
    return out


def _row(ref: str) -> int:
    return int(re.sub(r"\D", "", ref))


def _column(ref: str) -> int:
    n = 0
    for ch in re.sub(r"[^A-Z]", "", ref.upper()):
        n = n * 26 + ord(ch) - 64
    return n - 1
