"""Writes small workbooks for the reader's tests."""

import zipfile
from xml.sax.saxutils import escape

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"


def letters(i):
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def cell_xml(ref, value, shared):
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, tuple):  # ("date", serial) or ("inline", text)
        kind, raw = value
        return f'<c r="{ref}" s="1"><v>{raw}</v></c>' if kind == "date" else f'<c r="{ref}" t="inlineStr"><is><t>{escape(raw)}</t></is></c>'
    if isinstance(value, (int, float)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    if value not in shared:
        shared.append(value)
    return f'<c r="{ref}" t="s"><v>{shared.index(value)}</v></c>'


def write_book(path, sheets):
    shared, parts = [], []
    for rows in sheets.values():
        body = "".join(
            f'<row r="{r}">' + "".join(cell_xml(f"{letters(c)}{r}", v, shared) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
        parts.append(f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
    with zipfile.ZipFile(path, "w") as book:
        names = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(parts) + 1))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE}">{links}</Relationships>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><t>{escape(t)}</t></si>" for t in shared) + "</sst>")
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        for i, xml in enumerate(parts, 1):
            book.writestr(f"xl/worksheets/sheet{i}.xml", xml)
