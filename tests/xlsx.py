"""Writes small xlsx files for tests with the standard library only."""

import zipfile
from xml.sax.saxutils import escape

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def column(i):
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def write(path, sheets):
    """sheets: name -> rows of values: None (no cell), text, number, bool, ('date', serial), ('inline', text), ('error', text)."""
    strings = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if isinstance(v, tuple):
            kind, x = v
            return {"date": f'<c r="{ref}" s="1"><v>{x}</v></c>', "inline": f'<c r="{ref}" t="inlineStr"><is><t>{escape(str(x))}</t></is></c>', "error": f'<c r="{ref}" t="e"><v>{x}</v></c>'}[kind]
        strings.append(v)
        return f'<c r="{ref}" t="s"><v>{len(strings) - 1}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        names = list(sheets)
        for n, name in enumerate(names, 1):
            rows = "".join(f'<row r="{i}">' + "".join(cell(f"{column(j)}{i}", v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(sheets[name], 1) if r is not None)
            z.writestr(f"xl/worksheets/sheet{n}.xml", f"<worksheet {NS}><sheetData>{rows}</sheetData></worksheet>")
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook {NS} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(s)}" sheetId="{i}" r:id="rId{i}"/>' for i, s in enumerate(names, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{escape(s)}</t></si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
