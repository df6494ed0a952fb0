"""Workbooks written by hand: shared and inline strings, dates, gaps, padding columns, missing sheets and columns."""

import zipfile

import pytest

from ledgerloom.sources import workbook

STYLES = """<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="164" formatCode="[Red]dd/mm/yyyy"/><numFmt numFmtId="165" formatCode="0.00 &quot;days&quot;"/></numFmts>
<cellStyleXfs><xf numFmtId="14"/></cellStyleXfs><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/><xf numFmtId="20"/></cellXfs></styleSheet>"""
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def write(path, sheets, strings):
    names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="rId{k}" Target="{"/xl/" if k % 2 else ""}worksheets/s{k}.xml" Type="t"/>' for k, _ in enumerate(sheets, 1))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", STYLES)
        for k, body in enumerate(sheets.values(), 1):
            z.writestr(f"xl/worksheets/s{k}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
    return str(path)


def cells(number, *values):
    """A row; a value is text for a shared string's number, or the cell's XML."""
    out = "".join(v.replace("@", f"{chr(65 + k)}{number}") if isinstance(v, str) else f'<c r="{chr(65 + k)}{number}" t="s"><v>{v}</v></c>' for k, v in enumerate(values) if v is not None)
    return f'<row r="{number}">{out}</row>'


@pytest.fixture
def book(tmp_path):
    strings = ["<t>Name </t>", "<r><t>Va</t></r><r><t>lue</t></r><rPh><t>no</t></rPh>", "<t xml:space='preserve'>\tNordvik  SCSp </t>", "<t>title</t>", "<t>Code</t>"]
    n = lambda v, s=0: f'<c r="@" s="{s}"><v>{v}</v></c>'
    inline = lambda t: f'<c r="@" t="inlineStr"><is><t>{t}</t></is></c>'
    body = cells(1, 3) + cells(3, 0, None, 1, 4, inline(" ")) + cells(4, 2, None, n(46086, 1), n(5)) + cells(6, inline("b"), inline("x"), n("46086.5", 2), n("5.50")) + cells(7, None, n(1), None)
    body += cells(8, '<c r="@" t="b"><v>1</v></c>', None, n("0.25", 4), '<c r="@" t="str"><f>A1</f><v>f</v></c>') + cells(9, '<c r="@" t="e"><v>#N/A</v></c>', None, n("2.5", 3))
    return write(tmp_path / "a.xlsx", {"Other": cells(1, 4), "DIU ": body}, strings)


def test_a_sheet(spark, book):
    got = workbook.sheet(spark, book, " DIU", header_row=2)
    assert got.columns == ["row_index", "Name", "Value", "Code"]
    assert [tuple(r) for r in got.orderBy("row_index").collect()] == [
        (3, "Nordvik SCSp", "2026-03-05 00:00:00", "5"), (5, "b", "2026-03-05 12:00:00", "5.5"), (7, "True", "06:00:00", "f"), (8, "#N/A", "2.5", ""),
    ]
    some = workbook.sheet(spark, book, "DIU", 2, ["VALUE", "gone", " code"])
    assert some.columns == ["row_index", "Value", "Code"] and some.count() == 4


def test_what_is_missing_raises(spark, book, tmp_path):
    with pytest.raises(KeyError, match="no sheet 'Gone'.*Other, DIU"):
        workbook.sheet(spark, book, "Gone")
    with pytest.raises(ValueError, match="none of the columns"):
        workbook.sheet(spark, book, "DIU", 2, ["gone"])
    with pytest.raises(ValueError):
        workbook.sheet(spark, book, "Other", header_row=5)


def test_many_rows_and_dumps(spark, tmp_path):
    text = lambda t: f'<c r="@" t="inlineStr"><is><t>{t}</t></is></c>'
    path = write(tmp_path / "big.xlsx", {"S": cells(1, text("K"), text("V")) + "".join(cells(k, text(f"k{k}"), text(f"v {k}")) for k in range(2, 5003))}, [])
    tables = workbook.mounted(spark, path, {"t": {"sheet": "S"}, "k": {"sheet": "s".upper(), "columns": ["k"]}})
    assert workbook.mounted(spark, path, {}) == {} and tables["t"].count() == 5001 and tables["k"].columns == ["K"]
    workbook.dump(tables, str(tmp_path / "out"))
    back = workbook.undumped(spark, str(tmp_path / "out"), {"t": ["K", "V"]})["t"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, tables["t"].collect()))
