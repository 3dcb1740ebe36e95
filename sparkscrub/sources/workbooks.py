"""A folder of ``.xlsx`` workbooks as one table, one task per workbook."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# The built-in number formats that show a date or a time.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_ROWS = "path string, row_no bigint, cells array<string>"
_BATCH = 5000


def read_workbooks(spark: SparkSession, path: str) -> DataFrame:
    """Active sheet of every workbook under ``path``; row 1 of each names its columns, which must
    agree. All cells are text (dates as
    ``yyyy-MM-dd HH:mm:ss``), blank cells are null. Adds ``source_path`` and ``source_row``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.xlsx")
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "content")
    )
    rows = files.mapInPandas(_sheet_rows, _ROWS)
    # One header per distinct layout; two are enough to see that the files disagree.
    headers = files.mapInPandas(_headers, "cells array<string>").distinct().limit(2).collect()
    if len(headers) != 1:
        raise ValueError(f"the workbooks under {path!r} have {'different headers' if headers else 'no header'}")
    names = headers[0]["cells"]
    wide = F.raise_error(F.concat(F.lit("a row has more cells than the header: "), "path", F.lit(" row "), "row_no"))
    cells = F.when(F.size("cells") > len(names), wide).otherwise(F.col("cells"))
    body = rows.where("row_no > 1").withColumn("cells", cells)
    return body.select(
        *[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)],
        F.col("path").alias("source_path"),
        F.col("row_no").alias("source_row"),
    )


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        firsts = []
        for content in batch["content"]:
            for _, cells in _read_sheet(content):
                firsts.append([c if c is not None else f"column_{i + 1}" for i, c in enumerate(cells)])
                break
        yield pd.DataFrame({"cells": firsts})


def _sheet_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            pending: list[tuple] = []
            for number, cells in _read_sheet(content):
                pending.append((path, number, cells))
                if len(pending) == _BATCH:
                    yield pd.DataFrame(pending, columns=["path", "row_no", "cells"])
                    pending = []
            if pending:
                yield pd.DataFrame(pending, columns=["path", "row_no", "cells"])


def _read_sheet(content: bytes) -> Iterator[tuple[int, list[str | None]]]:
    """(row number, cell texts) of the active sheet, streamed."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        root = ElementTree.fromstring(book.read("xl/workbook.xml"))
        settings = root.find(_MAIN + "workbookPr")
        from_1904 = settings is not None and settings.get("date1904") in ("1", "true")
        shared, dated = _shared_texts(book), _date_styles(book)
        with book.open(_active_sheet(book, root)) as sheet:
            for _, element in ElementTree.iterparse(sheet):
                if element.tag != _MAIN + "row":
                    continue
                cells: list[str | None] = []
                for cell in element.iter(_MAIN + "c"):
                    at = _column_number(cell.get("r")) if cell.get("r") else len(cells)
                    cells += [None] * (at - len(cells))
                    cells.append(_cell_text(cell, shared, dated, from_1904))
                while cells and cells[-1] is None:
                    cells.pop()
                yield int(element.get("r", 0)), cells
                element.clear()


def _active_sheet(book: zipfile.ZipFile, root: ElementTree.Element) -> str:
    view = root.find(f"{_MAIN}bookViews/{_MAIN}workbookView")
    sheets = root.findall(f"{_MAIN}sheets/{_MAIN}sheet")
    active = int(view.get("activeTab", 0)) if view is not None else 0
    link = sheets[active if active < len(sheets) else 0].get(_LINK)
    for target in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")):
        if target.get("Id") == link:
            path = target.get("Target")
            return path.lstrip("/") if path.startswith("/") else f"xl/{path}"
    raise ValueError("the workbook has no sheet")


def _shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    texts = ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(_MAIN + "si")
    return ["".join(t.text or "" for t in item.iter(_MAIN + "t")) for item in texts]


def _date_styles(book: zipfile.ZipFile) -> set[str]:
    """The style numbers whose number format shows a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {f.get("numFmtId"): f.get("formatCode", "") for f in root.iter(_MAIN + "numFmt")}

    def shows_date(number: str) -> bool:
        if number not in own:
            return int(number) in _DATE_FORMATS
        # Letters in quotes, brackets and escapes are not part of the layout.
        layout = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|_.', "", own[number].split(";")[0])
        return re.search("[dmyhs]", layout, re.IGNORECASE) is not None

    formats = root.find(_MAIN + "cellXfs")
    styles = [] if formats is None else list(formats)
    return {str(i) for i, style in enumerate(styles) if shows_date(style.get("numFmtId", "0"))}


def _column_number(reference: str) -> int:
    number = 0
    for letter in re.match(r"[A-Z]+", reference).group():
        number = number * 26 + ord(letter) - ord("A") + 1
    return number - 1


def _cell_text(cell: ElementTree.Element, shared: list[str], dated: set[str], from_1904: bool) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(_MAIN + "t"))
    value = cell.find(_MAIN + "v")
    if value is None or value.text is None:
        return None
    if kind == "s":
        return shared[int(value.text)]
    if kind == "b":
        return "True" if value.text == "1" else "False"
    if kind != "n":
        return value.text
    if cell.get("s") in dated:
        return _date_text(float(value.text), from_1904)
    return value.text if value.text.lstrip("-").isdigit() else repr(float(value.text))


def _date_text(days: float, from_1904: bool) -> str:
    """A day number as text; numbers below one are times of day."""
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)
    if not from_1904 and 1 <= days < 60:
        days += 1  # this calendar has a 29 February 1900
    moment = start + timedelta(milliseconds=round(days * 86_400_000))
    return str(moment.time() if 0 <= days < 1 else moment)
