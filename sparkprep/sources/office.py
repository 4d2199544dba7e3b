"""XLSX sheets and DOCX tables, read with the standard library; XLSX writing of one sheet."""

from __future__ import annotations

import datetime as dt
import re
import zipfile
from collections.abc import Iterable
from typing import BinaryIO
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _column(ref: str) -> int:
    n = 0
    for c in re.match(r"[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def sheets(f: BinaryIO) -> list[tuple[str, str]]:
    """(name, member) of the sheets in order."""
    z = zipfile.ZipFile(f)
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(z.read("xl/workbook.xml")).iter(_S + "sheet"):
        target = rels[s.get(_R + "id")].lstrip("/")
        out.append((s.get("name"), target if target.startswith("xl/") else "xl/" + target))
    return out


def active_sheet(f: BinaryIO) -> int:
    view = ET.fromstring(zipfile.ZipFile(f).read("xl/workbook.xml")).find(f"{_S}bookViews/{_S}workbookView")
    return int(view.get("activeTab", 0)) if view is not None else 0


def sheet_rows(f: BinaryIO, index: int | None = None) -> list[list]:
    """Cells of one sheet (the active one by default): text, number, bool, date or None; gaps are None."""
    z = zipfile.ZipFile(f)
    names = z.namelist()
    member = sheets(f)[active_sheet(f) if index is None else index][1]
    shared = ["".join(t.text or "" for t in si.iter(_S + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_S + "si")] if "xl/sharedStrings.xml" in names else []
    dates: list[bool] = []
    if "xl/styles.xml" in names:
        styles = ET.fromstring(z.read("xl/styles.xml"))
        own = {int(n.get("numFmtId")): n.get("formatCode", "") for n in styles.iter(_S + "numFmt")}
        for xf in styles.findall(f"{_S}cellXfs/{_S}xf"):
            k = int(xf.get("numFmtId", 0))
            code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(k, ""))
            dates.append(14 <= k <= 22 or 45 <= k <= 47 or bool(re.search("[ymdhs]", code, re.I)))
    out = []
    for row in ET.fromstring(z.read(member)).iter(_S + "row"):
        cells: list = []
        for c in row.iter(_S + "c"):
            at = _column(c.get("r")) if c.get("r") else len(cells)
            cells += [None] * (at - len(cells))
            v, kind = c.find(_S + "v"), c.get("t")
            raw = None if v is None else v.text
            if kind == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter(_S + "t")))
            elif raw is None:
                cells.append(None)
            elif kind == "s":
                cells.append(shared[int(raw)])
            elif kind == "b":
                cells.append(raw == "1")
            elif kind in ("str", "e", "d"):
                cells.append(raw)
            else:
                x = float(raw)
                style = int(c.get("s", 0))
                if style < len(dates) and dates[style]:
                    cells.append(dt.datetime(1899, 12, 30) + dt.timedelta(days=x))
                else:
                    cells.append(int(x) if x.is_integer() else x)
        out.append(cells)
    return out


def sheet_records(f: BinaryIO, index: int | None = None, start_line: int = 0, fields: list[str] | None = None) -> list[dict]:
    rows = [r for r in sheet_rows(f, index)[start_line:]]
    if fields is None:
        if not rows:
            return []
        head, rows = rows[0], rows[1:]
        fields = [str(x) if x is not None else f"column{k + 1}" for k, x in enumerate(head)]
    return [dict(zip(fields, [*r, *[None] * (len(fields) - len(r))])) for r in rows if any(x is not None for x in r)]


def write_sheet(f: BinaryIO, names: list[str], rows: Iterable[tuple]) -> None:
    """One sheet with a header; numbers and booleans keep their type, all else is text."""

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f"<c><v>{v!r}</v></c>"
        text = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(v))
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'

    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_R[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{_R[1:-1]}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as out:
            out.write(f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{_S[1:-1]}"><sheetData>'.encode())
            for r in (tuple(names), *rows):
                out.write(("<row>" + "".join(map(cell, r)) + "</row>").encode())
            out.write(b"</sheetData></worksheet>")


def docx_tables(f: BinaryIO) -> list[list[list[str]]]:
    """Every table as rows of texts; a vertically merged cell repeats the one above, a spanning cell the one at its left."""
    body = ET.fromstring(zipfile.ZipFile(f).read("word/document.xml"))
    out = []
    for table in body.iter(_W + "tbl"):
        rows: list[list[str]] = []
        for tr in table.findall(_W + "tr"):
            cells: list[str] = []
            for tc in tr.findall(_W + "tc"):
                text = " ".join("".join(t.text or "" for t in p.iter(_W + "t")) for p in tc.findall(_W + "p")).replace("\n", " ").strip()
                props = tc.find(_W + "tcPr")
                span, merged = 1, False
                if props is not None:
                    g, v = props.find(_W + "gridSpan"), props.find(_W + "vMerge")
                    span = int(g.get(_W + "val")) if g is not None else 1
                    merged = v is not None and v.get(_W + "val", "continue") != "restart"
                if merged and rows and len(cells) < len(rows[-1]):
                    text = rows[-1][len(cells)]
                cells += [text] * span
            rows.append(cells)
        out.append(rows)
    return out


def docx_records(f: BinaryIO, index: int = 0) -> list[dict]:
    tables = docx_tables(f)
    if index >= len(tables) or not tables[index]:
        return []
    head, *rows = tables[index]
    return [dict(zip(head, r)) for r in rows]
