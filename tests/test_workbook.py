"""Values of workbook cells: dates in both calendars, times, truth values, shared strings."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyloom.plans import jobs
from tallyloom.sources import files, workbook

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
FORMATS = ("General", "0.00", "dd/mm/yyyy", "d\\-mmm\\-yy", "yyyy-mm-dd hh:mm", "h:mm AM/PM", "[h]:mm:ss", "[Red]0.00;[Blue]-0.00", '#,##0 "days"', "mmm-yy", "mm:ss", "[$-409]m/d/yy")


def book(rows, late=False, strings=(), sheets=1):
    """The bytes of a workbook; a cell is text, a number, (number, place in FORMATS or built-in id as `id<n>`), or raw XML in a list."""
    ids = {f: 164 + i for i, f in enumerate(FORMATS)}
    xfs = [0, *ids.values(), *range(14, 23), 45, 46, 47]

    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r + 1}"
        if isinstance(v, list):
            return v[0].replace("REF", ref)
        if isinstance(v, tuple):
            number = ids[FORMATS[v[1]]] if isinstance(v[1], int) else int(v[1][2:])
            return f'<c r="{ref}" s="{xfs.index(number)}"><v>{v[0]}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f'<c r="{ref}"><v>{v}</v></c>'

    body = "".join(f'<row r="{r + 1}">' + "".join(cell(r, c, v) for c, v in enumerate(row) if v is not None) + "</row>" for r, row in enumerate(rows))
    escaped = lambda f: f.replace("&", "&amp;").replace('"', "&quot;")
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN}><workbookPr date1904="{int(late)}"/></workbook>')
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts>' + "".join(f'<numFmt numFmtId="{i}" formatCode="{escaped(f)}"/>' for f, i in ids.items()) + '</numFmts><cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs>' + "".join(f'<xf numFmtId="{i}"/>' for i in xfs) + "</cellXfs></styleSheet>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {MAIN}><sheetData>{body}</sheetData></worksheet>")
    return data.getvalue()


def values(data):
    return {(r, c): v for _, r, c, v, _ in workbook._cells(data)}


def test_dates_and_times():
    day = (dt.date(2024, 1, 15) - dt.date(1899, 12, 30)).days
    cells = [day, (day, 0), (day, 1), (day, 2), (day, 3), (day + 0.5, 4), (0.75, 5), (1.5, 6), (5, 7), (5, 8), (day, 9), (0.5, 10), (day, 11), (day, "id14"), (day + 0.25, "id22"), (0.25, "id20"), (2, "id46"), ("x", 2), (-1, 2)]
    got = values(book([cells]))
    want = [str(day), str(day), str(day), "2024-01-15", "2024-01-15", "2024-01-15 12:00:00", "18:00:00", "36:00:00", "5", "5", "2024-01-15", "12:00:00", "2024-01-15", "2024-01-15", "2024-01-15 06:00:00", "06:00:00", "48:00:00", "x", "-1"]
    assert [got[0, i] for i in range(len(cells))] == want


@pytest.mark.parametrize("late", [False, True])
def test_both_calendars(late):
    first = dt.date(1904, 1, 1) if late else dt.date(1899, 12, 30)
    days = [dt.date(1904, 1, 2), dt.date(1999, 12, 31), dt.date(2000, 2, 29), dt.date(2024, 2, 29), dt.date(9999, 12, 31)]
    assert list(values(book([[((d - first).days, 2) for d in days]], late)).values()) == [d.isoformat() for d in days]
    if not late:
        assert list(values(book([[(1, 2), (59, 2), (61, 2)]])).values()) == ["1900-01-01", "1900-02-28", "1900-03-01"]
    assert list(values(book([[(10**9, 2)]], late)).values()) == [str(10**9)]


def test_other_kinds_of_cells():
    strings = ["<t>plain</t>", "<r><t>rich </t></r><r><t>text</t></r><rPh><t>phonetic</t></rPh>", "<t/>"]
    cells = [['<c r="REF" t="s"><v>0</v></c>'], ['<c r="REF" t="s"><v>1</v></c>'], ['<c r="REF" t="s"><v>2</v></c>'], ['<c r="REF" t="b"><v>1</v></c>'], ['<c r="REF" t="b"><v>0</v></c>'], ['<c r="REF" t="e"><v>#N/A</v></c>'], ['<c r="REF" t="d"><v>2024-01-15T00:00:00</v></c>'], ['<c r="REF" t="str"><f>A1</f><v>made</v></c>'], ["<c><v>7</v></c>"]]
    got = values(book([cells], strings=strings))
    assert got == {(0, 0): "plain", (0, 1): "rich text", (0, 3): "True", (0, 4): "False", (0, 6): "2024-01-15", (0, 7): "made", (0, 8): "7"}


def test_a_workbook_of_dates_goes_to_gold_as_its_csv_twin(spark, tmp_path):
    days = [dt.date(2024, 1, 15), dt.date(2024, 2, 1), dt.date(2024, 3, 4), dt.date(2024, 12, 31)]
    lines = [(d, f"Rent {i}", "Landlord", 1000 + i, "debit" if i % 2 else "credit") for i, d in enumerate(days)]
    header = ["Date", "Description", "Party", "Amount", "Type"]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "book.xlsx").write_bytes(book([header, *([((d - dt.date(1899, 12, 30)).days, 2), t, p, a, k] for d, t, p, a, k in lines)]))
    (folder / "late.xlsx").write_bytes(book([header, *([((d - dt.date(1904, 1, 1)).days, "id14"), t, p, a, k] for d, t, p, a, k in lines)], late=True))
    (folder / "twin.csv").write_text("\n".join([",".join(header), *(f"{d:%d/%m/%Y},{t},{p},{a},{k}" for d, t, p, a, k in lines)]) + "\n")
    got = {}
    for name in ("book.xlsx", "late.xlsx", "twin.csv"):
        lake = str(tmp_path / name)
        done = jobs.ingest(spark, files.manifest(spark, str(folder), contents=True).where(F.col("path").endswith(name)), lake, "b")
        assert (done["bronze"], done["quarantine"], done["gold"]) == (4, 0, 4)
        got[name] = sorted(tuple(r) for r in spark.read.parquet(f"{lake}/gold").drop("bronze_id").collect())
    assert got["book.xlsx"] == got["late.xlsx"] == got["twin.csv"]
