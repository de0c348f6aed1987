"""Excel workbooks as bytes, with the standard library only: one sheet in, one sheet out."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from datetime import date, datetime, timedelta
from decimal import Decimal
from xml.etree import ElementTree
from xml.sax.saxutils import escape

# The format's names, the built-in number formats that are dates, and the day that dates are counted from.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))
EPOCH = datetime(1899, 12, 30)
#: Characters that XML has no place for.
_CONTROLS = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _letters(n: int) -> str:
    """The name of column n, from 0."""
    out = ""
    while n >= 0:
        out, n = chr(65 + n % 26) + out, n // 26 - 1
    return out


def _number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n - 1


def _cell(where: str, value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{where}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)) and value - value == 0:
        return f'<c r="{where}"><v>{value!s}</v></c>'
    if isinstance(value, datetime):
        return f'<c r="{where}" s="1"><v>{(value.replace(tzinfo=None) - EPOCH) / timedelta(days=1)!r}</v></c>'
    if isinstance(value, date):
        return f'<c r="{where}" s="1"><v>{(value - EPOCH.date()).days}</v></c>'
    return f'<c r="{where}" t="inlineStr"><is><t xml:space="preserve">{escape(_CONTROLS.sub("", str(value)))}</t></is></c>'


def write_sheet(head: list[str], rows: Iterable, sheet: str) -> bytes:
    """A workbook of one sheet: a row of names, then the rows. Null cells are left out; what is no number, date or truth value is text."""
    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        parts = (("/xl/workbook.xml", f"{kind}.sheet.main+xml"), ("/xl/worksheets/sheet1.xml", f"{kind}.worksheet+xml"), ("/xl/styles.xml", f"{kind}.styles+xml"))
        book.writestr("[Content_Types].xml", f'{xml}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + "".join(f'<Override PartName="{p}" ContentType="{t}"/>' for p, t in parts) + "</Types>")
        book.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="r1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>')
        book.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        book.writestr("xl/styles.xml", f'{xml}<styleSheet xmlns="{MAIN}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="22" applyNumberFormat="1"/></cellXfs></styleSheet>')
        with book.open("xl/worksheets/sheet1.xml", "w") as page:
            page.write(f'{xml}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
            for i, row in enumerate((head, *rows) if isinstance(rows, (list, tuple)) else _chain(head, rows), 1):
                cells = "".join(_cell(f"{_letters(j)}{i}", v) for j, v in enumerate(row))
                page.write(f'<row r="{i}">{cells}</row>'.encode())
            page.write(b"</sheetData></worksheet>")
    return out.getvalue()


def _chain(head, rows):
    yield head
    yield from rows


def read_sheet(data: bytes) -> list[list]:
    """The rows of a workbook's first sheet, names included; cells that are not there are None."""
    tag = lambda name: f"{{{MAIN}}}{name}"
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        tree = lambda path: ElementTree.fromstring(book.read(path))
        shared = ["".join(t.text or "" for t in x.iter(tag("t"))) for x in tree("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
        dates = set()
        if "xl/styles.xml" in names:
            styles = tree("xl/styles.xml")
            own = {int(x.get("numFmtId")) for x in styles.iter(tag("numFmt")) if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^]]*\]', "", x.get("formatCode", "").lower()))}
            formats = styles.find(tag("cellXfs"))
            dates = {i for i, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}
        links = {x.get("Id"): x.get("Target") for x in tree("xl/_rels/workbook.xml.rels")}
        first = next(tree("xl/workbook.xml").iter(tag("sheet")))
        target = links[first.get(f"{{{OFFICE}}}id")]
        page = tree(target.lstrip("/") if target.startswith("/") else f"xl/{target}")
    out = []
    for row in page.iter(tag("row")):
        found: dict[int, object] = {}
        for c in row:
            at = _number(re.match(r"[A-Z]+", c.get("r")).group()) if c.get("r") else len(found)
            kind, v = c.get("t", "n"), c.find(tag("v"))
            if kind == "inlineStr":
                found[at] = "".join(t.text or "" for t in c.iter(tag("t")))
            elif v is not None and v.text is not None:
                found[at] = _value(kind, v.text, shared, int(c.get("s", 0)) in dates)
        out.append([found.get(i) for i in range(max(found, default=-1) + 1)])
    return out


def _value(kind: str, text: str, shared: list[str], is_date: bool):
    if kind == "s":
        return shared[int(text)]
    if kind == "b":
        return text == "1"
    if kind != "n":
        return None if kind == "e" else text
    number = float(text)
    if is_date:
        return EPOCH + timedelta(microseconds=round(number * 86_400_000_000))
    return int(number) if number.is_integer() and not re.search("[.eE]", text) else number
