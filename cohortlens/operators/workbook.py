"""Workbooks (xlsx) of bounded tables, written with the standard library.

A workbook opens with a sheet on the run and one on the methods, has a sheet for each
table (a line that says what it shows, a header, numbers with four digits, columns as wide
as their content), and closes with an index of the charts.
"""

from __future__ import annotations

import math
import re
import zipfile
from dataclasses import dataclass, field
from pathlib import Path
from xml.sax.saxutils import escape

import pandas as pd

#: Digits of numbers, and the widest column in characters.
DIGITS, WIDEST = 4, 60
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
#: Places in the style sheet: plain, bold header, four digits, description.
_PLAIN, _BOLD, _NUMBER, _NOTE = range(4)


@dataclass
class Sheet:
    name: str
    table: pd.DataFrame
    description: str = ""
    widths: dict[str, int] = field(default_factory=dict)


def sheet_names(names: list[str]) -> list[str]:
    """At most 31 characters, none that a workbook forbids, and no two alike."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[:\\/?*\[\]]", "_", name)[:31] or "Sheet"
        new, k = base, 2
        while new.lower() in (x.lower() for x in out):
            tail = f"_{k}"
            new, k = base[: 31 - len(tail)] + tail, k + 1
        out.append(new)
    return out


def column_letters(index: int) -> str:
    """0 is A, 26 is AA."""
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(row: int, col: int, value: object, style: int) -> str:
    at = f'{column_letters(col)}{row}'
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return f'<c r="{at}" s="{style}" t="b"><v>{int(value)}</v></c>'
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, int):
        return f'<c r="{at}" s="{style}"><v>{value}</v></c>'
    if isinstance(value, float) and math.isfinite(value):
        return f'<c r="{at}" s="{_NUMBER}"><v>{round(value, DIGITS)!r}</v></c>'
    text = ", ".join(map(str, value)) if isinstance(value, (list, tuple)) else str(value)
    text = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text)[:32767]
    return f'<c r="{at}" s="{style}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def _sheet_xml(sheet: Sheet) -> str:
    t = sheet.table
    rows, at = [], 1
    if sheet.description:
        rows.append([(sheet.description, _NOTE)])
    rows.append([(str(c), _BOLD) for c in t.columns])
    rows += [[(v, _PLAIN) for v in r] for r in t.itertuples(index=False, name=None)]
    body = []
    for r in rows:
        body.append(f'<row r="{at}">{"".join(_cell(at, i, v, style) for i, (v, style) in enumerate(r))}</row>')
        at += 1
    widths = []
    for i, c in enumerate(t.columns):
        shown = [len(str(c)), *(len(f"{v:.{DIGITS}f}") if isinstance(v, float) else len(str(v)) for v in t.iloc[:, i].head(1000))]
        width = sheet.widths.get(str(c), min(WIDEST, max(shown) + 2))
        widths.append(f'<col min="{i + 1}" max="{i + 1}" width="{width}" customWidth="1"/>')
    cols = f"<cols>{''.join(widths)}</cols>" if widths else ""
    return f'{_HEAD}<worksheet xmlns="{_MAIN}">{cols}<sheetData>{"".join(body)}</sheetData></worksheet>'


_STYLES = (f'{_HEAD}<styleSheet xmlns="{_MAIN}"><numFmts count="1"><numFmt numFmtId="164" formatCode="0.0000"/></numFmts>'
           '<fonts count="3"><font><sz val="11"/><name val="Calibri"/></font><font><b/><sz val="11"/><name val="Calibri"/></font><font><i/><sz val="11"/><name val="Calibri"/></font></fonts>'
           '<fills count="2"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders>'
           '<cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="4"><xf fontId="0"/><xf fontId="1" applyFont="1"/><xf numFmtId="164" fontId="0" applyNumberFormat="1"/><xf fontId="2" applyFont="1"/></cellXfs></styleSheet>')


def write_xlsx(path: Path, sheets: list[Sheet]) -> str:
    """The workbook's path; sheets stand in the order given."""
    names = sheet_names([s.name for s in sheets])
    count = range(1, len(sheets) + 1)
    office = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    parts = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{office}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{office}.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{office}.worksheet+xml"/>' for i in count) + "</Types>",
        "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>' + "".join(f'<sheet name="{escape(n, {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(count, names)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in count)
        + f'<Relationship Id="rId{len(sheets) + 1}" Type="{_REL}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": _STYLES,
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
        for i, s in zip(count, sheets):
            z.writestr(f"xl/worksheets/sheet{i}.xml", _sheet_xml(s))
    return str(path)


def report_workbook(path: Path, tables: list[tuple[str, str, pd.DataFrame]], metadata: dict[str, object], methods: list[str], charts: list[tuple[str, str]]) -> str:
    """Metadata, Methodology, a sheet for each (name, description, table), and Chart_Index of (file, what it shows)."""
    about = pd.DataFrame([(k, str(v)) for k, v in {**metadata, "Tables": len(tables), "Charts": len(charts)}.items()], columns=["Item", "Value"])
    how = pd.DataFrame({"Methods": methods})
    index = pd.DataFrame([(i + 1, f, what) for i, (f, what) in enumerate(charts)], columns=["Number", "File", "Content"])
    data = [Sheet(name, t if len(t) else pd.DataFrame({"Note": ["no rows"]}), note) for name, note, t in tables]
    return write_xlsx(path, [Sheet("Metadata", about, widths={"Item": 40, "Value": 60}), Sheet("Methodology", how, widths={"Methods": 100}), *data, Sheet("Chart_Index", index)])
