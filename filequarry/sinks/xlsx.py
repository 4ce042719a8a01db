"""A workbook writer for results, made of the parts of an Office Open XML package: one sheet, and more if one can't hold all rows."""

from __future__ import annotations

import itertools
import re
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"
LEAST_WIDTH, MOST_WIDTH = 8, 50
#: Rows of results on one sheet; with the header, an empty line and the closing line it is full.
MOST_ROWS = 1_048_576 - 3
#: Stands for the number of a row; no cell can hold it.
_ROW = "\x01"

_FIXED = {
    "[Content_Types].xml": f'<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>'
    '{types}'
    '<Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{{sheets}}</sheets></workbook>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_PKG}/relationships">{{rels}}<Relationship Id="styles" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill>'
    '<fill><patternFill patternType="solid"><fgColor rgb="FFD9E1F2"/></patternFill></fill></fills><borders count="2"><border/><border><left style="thin"/><right style="thin"/><top style="thin"/><bottom style="thin"/></border></borders>'
    '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf/><xf fontId="1" fillId="2" borderId="1" applyFont="1" applyFill="1" applyBorder="1"/><xf borderId="1" applyBorder="1"/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
}


def _name(i: int) -> str:
    out = ""
    i += 1
    while i:
        i, r = divmod(i - 1, 26)
        out = chr(65 + r) + out
    return out


def _cell(col: int, row: object, v: object, style: int) -> str:
    at = f'r="{_name(col)}{row}" s="{style}"'
    if v is None:
        return f"<c {at}/>"
    if isinstance(v, bool):
        return f'<c {at} t="b"><v>{int(v)}</v></c>'
    if isinstance(v, (int, float)) and v == v and abs(v) != float("inf"):
        return f"<c {at}><v>{v!r}</v></c>"
    safe = "".join(ch for ch in str(v) if ch >= " " or ch in "\t\n")
    return f'<c {at} t="inlineStr"><is><t xml:space="preserve">{escape(safe)}</t></is></c>'


def row_lines(rows: list[list]) -> tuple[str, list[int]]:
    """Rows as lines of XML in which _ROW stands for their numbers, and the widths of the columns."""
    lines = [f'<row r="{_ROW}">' + "".join(_cell(i, _ROW, v, 2) for i, v in enumerate(r)) + "</row>" for r in rows]
    return "\n".join(x.replace("\n", "&#10;") for x in lines), [max(len(str(v)) for v in c) for c in zip(*rows, strict=True)]


def pack(path: str, columns: list[str], wide: list[int], lines: Iterable[bytes], n: int) -> None:
    """A workbook of n lines that row_lines made, row by row."""
    head = '<row r="1">' + "".join(_cell(i, 1, c, 1) for i, c in enumerate(columns)) + "</row>"
    widths = "".join(f'<col min="{i}" max="{i}" width="{min(MOST_WIDTH, max(LEAST_WIDTH, w + 2))}" customWidth="1"/>' for i, w in enumerate(wide, 1))
    cols = f"<cols>{widths}</cols>" if columns else ""
    lines, count = iter(lines), max(1, -(-n // MOST_ROWS))
    each = lambda text: "".join(text.format(i=i, name=f"Data{'' if i == 1 else i}") for i in range(1, count + 1))
    told = {
        "types": each('<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>'),
        "sheets": each('<sheet name="{name}" sheetId="{i}" r:id="r{i}"/>'),
        "rels": each(f'<Relationship Id="r{{i}}" Type="{_REL}/worksheet" Target="worksheets/sheet{{i}}.xml"/>'),
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part in _FIXED.items():
            for k, v in told.items():
                part = part.replace(f"{{{k}}}", v)
            z.writestr(name, _HEAD + part)
        for i in range(1, count + 1):
            # the size isn't known before: a full sheet may be over what plain zip entries hold
            with z.open(f"xl/worksheets/sheet{i}.xml", "w", force_zip64=n > 100_000) as out:
                out.write((_HEAD + f'<worksheet xmlns="{_MAIN}">{cols}<sheetData>{head}').encode())
                row = 1
                for row, line in enumerate(itertools.islice(lines, MOST_ROWS), 2):
                    out.write(line.rstrip(b"\n").replace(_ROW.encode(), b"%d" % row))
                if i == count:
                    out.write(f'<row r="{row + 2}">{_cell(0, row + 2, f"Total Rows: {n}", 3)}</row>'.encode())
                out.write(b"</sheetData></worksheet>")


def write_xlsx(path: str, columns: list[str], rows: Iterable[list]) -> int:
    """Columns as a bold header, then rows, then a line with their number. Returns that number."""
    wide, n = [len(c) for c in columns], 0
    with tempfile.TemporaryFile() as lines:
        for r in rows:
            line, told = row_lines([r])
            wide, n = [max(w, x) for w, x in zip(wide, told, strict=True)], n + 1
            lines.write(line.encode() + b"\n")
        lines.seek(0)
        pack(path, columns, wide, lines, n)
    return n


def row_texts(path: str, size: int = 1 << 18) -> Iterator[str]:
    """XML of some whole rows at a time of a workbook that write_xlsx made: the header, and without the closing line."""
    with zipfile.ZipFile(path) as z:
        sheets = sorted((x for x in z.namelist() if x.startswith("xl/worksheets/sheet")), key=lambda x: int(re.findall(r"\d+", x)[0]))
        for i, sheet in enumerate(sheets):
            rest = b""
            with z.open(sheet) as f:
                while not (begin := rest.find(b"<sheetData>")) + 1 and (raw := f.read(size)):
                    rest += raw
                rest = rest[begin + len(b"<sheetData>") :]
                if i:  # the header again
                    while b"</row>" not in rest and (raw := f.read(size)):
                        rest += raw
                    rest = rest[rest.find(b"</row>") + 6 :]
                while raw := f.read(size):
                    # the last row is kept back: it may be the closing one
                    rest += raw
                    cut = rest.rfind(b"<row ")
                    if cut > 0:
                        yield rest[:cut].decode()
                        rest = rest[cut:]
            end = rest.rfind(b"<row ") if i == len(sheets) - 1 else rest.rfind(b"</sheetData>")
            if end > 0:
                yield rest[:end].decode()


def rows_of(text: str) -> list[list[str | float | bool | None]]:
    """Cells of rows that row_texts gave."""
    import xml.etree.ElementTree as ET

    out = []
    for row in ET.fromstring(f"<rows>{text}</rows>"):
        cells = []
        for c in row:
            v, t = c.find("v"), c.find("is/t")
            kind = c.get("t")
            cells.append((t.text or "") if t is not None else None if v is None else v.text == "1" if kind == "b" else float(v.text))
        out.append(cells)
    return out


def read_xlsx(path: str) -> list[list[str | float | bool | None]]:
    """The rows of a workbook that write_xlsx made, header first, without the closing line."""
    return [row for text in row_texts(path) for row in rows_of(text)]
