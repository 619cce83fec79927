"""Spreadsheet files (xlsx) as tables of cells, then rows."""

from __future__ import annotations

import datetime as dt
import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = "path string, sheet int, row int, col int, value string, is_string boolean"
SHEET_ROWS = 15


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


#: Number formats of dates and times that have no code in the file, by id.
BUILT_IN = {14: "d", 15: "d", 16: "d", 17: "d", 18: "h", 19: "h", 20: "h", 21: "h", 22: "dh", 45: "h", 46: "[h]", 47: "h"} | dict.fromkeys((*range(27, 32), 36, *range(50, 59)), "d") | dict.fromkeys((32, 33), "h") | dict.fromkeys((34, 35), "d")
#: What a format's code says apart from its letters: quoted and escaped text, colours and conditions, fillers.
ASIDE = re.compile(r'"[^"]*"|\\.|_.|\*.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', re.IGNORECASE)
#: Days from day 0 of a workbook's calendar to 1970-01-01, for the calendars from 1900 and 1904.
DAY_0 = (25_569, 24_107)


def _kind(code: str) -> str:
    """What a number format shows: `d` a day, `h` a time of day, `dh` both, `[h]` a length of time, nothing a number."""
    bare = ASIDE.sub("", code.split(";")[0]).lower()
    if bare.strip() == "general":
        return ""
    if re.search(r"\[(h+|m+|s+)\]", bare):
        return "[h]"
    day, hour = bool(re.search("[dy]", bare)), bool(re.search("[hs]", bare))
    # m alone is a month; beside hours or seconds it is minutes
    return ("d" if day or ("m" in bare and not hour) else "") + ("h" if hour else "")


def _styles(z: zipfile.ZipFile) -> list[str]:
    """What each cell style shows."""
    if "xl/styles.xml" not in z.namelist():
        return []
    codes, out, inside = {}, [], False
    for event, el in ET.iterparse(z.open("xl/styles.xml"), ("start", "end")):
        tag = el.tag.rpartition("}")[2]
        if tag == "cellXfs":
            inside = event == "start"
        elif event == "end" and tag == "numFmt":
            codes[int(el.get("numFmtId"))] = _kind(el.get("formatCode", ""))
        elif event == "end" and tag == "xf" and inside:
            number = int(el.get("numFmtId", 0))
            out.append(codes.get(number, BUILT_IN.get(number, "")))
    return out


def _strings(z: zipfile.ZipFile) -> list[str]:
    """The shared strings, read as a stream; phonetic runs are left out."""
    out, parts, aside = [], [], 0
    if "xl/sharedStrings.xml" not in z.namelist():
        return out
    root = None
    for event, el in ET.iterparse(z.open("xl/sharedStrings.xml"), ("start", "end")):
        tag = el.tag.rpartition("}")[2]
        if root is None:
            root = el
        if tag == "rPh":
            aside += 1 if event == "start" else -1
        elif event == "end" and tag == "t" and not aside:
            parts.append(el.text or "")
        elif event == "end" and tag == "si":
            out.append("".join(parts))
            parts = []
            root.clear()
    return out


def _from_1904(z: zipfile.ZipFile) -> bool:
    if "xl/workbook.xml" not in z.namelist():
        return False
    return any(el.tag.rpartition("}")[2] == "workbookPr" and el.get("date1904") in ("1", "true") for _, el in ET.iterparse(z.open("xl/workbook.xml")))


def _shown(number: str, kind: str, late: bool) -> str:
    """A number as the day, time or length of time that its format shows; the number itself where it is none."""
    try:
        seconds = round(float(number) * 86_400)
    except (ValueError, OverflowError):
        return number
    if seconds < 0:
        return number
    clock = f"{seconds // 3600 if kind == '[h]' else seconds // 3600 % 24:02d}:{seconds // 60 % 60:02d}:{seconds % 60:02d}"
    if kind == "[h]" or (kind == "h" and seconds < 86_400):
        return clock
    # the calendar from 1900 has a 29 February in that year, which was none
    days = seconds // 86_400 + (not late and seconds < 60 * 86_400)
    try:
        day = (EPOCH + dt.timedelta(days=days - DAY_0[late])).isoformat()
    except OverflowError:
        return number
    return day if not seconds % 86_400 else f"{day} {clock}"


EPOCH = dt.date(1970, 1, 1)


def _cells(content: bytes) -> Iterator[tuple[int, int, int, str, bool]]:
    """(sheet, row, column, text, whether it is text) of the cells that aren't empty; none of a file in the old binary format.

    Numbers with a format of dates are days (`2024-01-15`), days with a time, or times; truth values are True or False;
    errors are empty cells, as a table of values has none for them.
    """
    if not zipfile.is_zipfile(io.BytesIO(content)):
        return
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        texts, styles, late = _strings(z), _styles(z), _from_1904(z)
        sheets = sorted((int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", n)))
        for number, name in sheets:
            data, row, col = None, -1, -1
            for event, el in ET.iterparse(z.open(name), ("start", "end")):
                tag = el.tag.rpartition("}")[2]
                if event == "start":
                    if tag == "sheetData":
                        data = el
                    elif tag == "row":
                        # rows and cells without a place follow the one before
                        row, col = int(el.get("r", row + 2)) - 1, -1
                    continue
                if tag == "row" and data is not None:
                    data.clear()
                if tag != "c":
                    continue
                col = _column(el.get("r")) if el.get("r") else col + 1
                kind, style, v = el.get("t", "n"), int(el.get("s", 0)), el.find("{*}v")
                text = "".join(t.text or "" for t in el.iterfind("{*}is//{*}t")) if kind == "inlineStr" else v.text if v is not None else None
                if text is None or kind == "e":
                    continue
                if kind == "s":
                    text = texts[int(text)]
                elif kind == "b":
                    text = "True" if text.strip() == "1" else "False"
                elif kind == "d":
                    text = text.removesuffix("T00:00:00").replace("T", " ")
                elif kind == "n" and style < len(styles) and styles[style]:
                    text = _shown(text, styles[style], late)
                if text.strip():
                    yield number, row, col, text, kind in ("s", "inlineStr", "str")


def cells(files: DataFrame) -> DataFrame:
    """The cells of workbooks given as (path, content); a file is unpacked in the task that holds it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CELLS.split(", ")]
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield pd.DataFrame([(path, *c) for c in _cells(bytes(content))], columns=names)

    return files.select("path", "content").mapInPandas(run, CELLS)


def rows(found: DataFrame) -> DataFrame:
    """(path, source_row_number, fields map) of each workbook's fullest sheet.

    The header is the first of its first 15 rows in which half of the cells are text, else the first row;
    a column without a header is column_<i>, of equal headers all but the first end in _<i>; rows before the header
    and blank rows are left out.
    """
    per = found.groupBy("path", "sheet").agg(F.countDistinct("row").alias("n"))
    best = per.groupBy("path").agg(F.max(F.struct("n", (-F.col("sheet")).alias("s"))).alias("b")).select("path", (-F.col("b")["s"]).alias("sheet"))
    mine = found.join(best, ["path", "sheet"], "left_semi")
    lines = mine.groupBy("path", "row").agg(F.avg(F.col("is_string").cast("int")).alias("share"))
    head = lines.groupBy("path").agg(F.coalesce(F.min(F.when((F.col("row") < SHEET_ROWS) & (F.col("share") >= 0.5), F.col("row"))), F.min("row")).alias("head"))
    names = mine.join(head, "path").where("row = head").select("path", "col", F.trim("value").alias("name"))
    nth = F.row_number().over(Window.partitionBy("path", "name").orderBy("col"))
    names = names.withColumn("nth", nth).select("path", "col", F.when(F.col("nth") > 1, F.concat("name", F.lit("_"), F.col("col").cast("string"))).otherwise(F.col("name")).alias("name"))
    body = mine.join(head, "path").where("row > head").join(names, ["path", "col"], "left").withColumn("name", F.coalesce("name", F.concat(F.lit("column_"), F.col("col").cast("string"))))
    packed = body.groupBy("path", "row").agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("col", "name", "value"))), lambda c: F.struct(c["name"], c["value"]))).alias("fields"))
    return packed.select("path", F.row_number().over(Window.partitionBy("path").orderBy("row")).alias("source_row_number"), "fields")
