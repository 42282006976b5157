"""Spreadsheet packages written with the standard library."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape


def letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def book(sheets: list[tuple], shared: bool = True) -> bytes:
    """sheets: (name, rows[, state]); a cell is a number, a text or None. Every second sheet's target is spelled in another way."""
    strings: list[str] = []
    parts = {}
    for n, (_, rows, *_rest) in enumerate(sheets):
        xml = []
        for r, row in enumerate(rows):
            cells = []
            for c, v in enumerate(row):
                ref = f"{letters(c)}{r + 1}"
                if v is None:
                    continue
                if isinstance(v, int | float):
                    cells.append(f'<c r="{ref}"><v>{v}</v></c>')
                elif shared and (r + c) % 3:
                    strings.append(v)
                    cells.append(f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>')
                else:
                    cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v)}</t></is></c>')
            xml.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{n + 1}.xml"] = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(xml)}</sheetData></worksheet>'
    spelled = ["worksheets/sheet{}.xml", "/xl/worksheets/sheet{}.xml", "xl/worksheets/sheet{}.xml"]
    names = "".join(f'<sheet name="{escape(s[0])}" sheetId="{n + 1}" r:id="r{n}" {f"""state="{s[2]}" """ if len(s) > 2 else ""}/>' for n, s in enumerate(sheets))
    parts["xl/workbook.xml"] = f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}<sheet name="lost" sheetId="99" r:id="none"/></sheets></workbook>'
    rels = "".join(f'<Relationship Id="r{n}" Target="{spelled[n % 3].format(n + 1)}"/>' for n in range(len(sheets)))
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'
    if strings:
        items = "".join(f"<si><r><t>{escape(s[:1])}</t></r><r><t>{escape(s[1:])}</t></r></si>" for s in strings)
        parts["xl/sharedStrings.xml"] = f'<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">{items}</sst>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()
