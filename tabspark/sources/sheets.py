"""Spreadsheet files (.xlsx and .ods), with the standard library's zip and XML only.

A sheet is read and written on the driver: one file of the format holds at most about a million rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import SparkSession

from tabspark.errors import UnsupportedFormat
from tabspark.functions import semantics as S
from tabspark.operators.cells import column_letters, parse_ref
from tabspark.operators.query import Query, Row
from tabspark.sources.files import read_bytes, write_bytes

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
OFFICE = "urn:oasis:names:tc:opendocument:xmlns:office:1.0"
TABLE = "urn:oasis:names:tc:opendocument:xmlns:table:1.0"
TEXT = "urn:oasis:names:tc:opendocument:xmlns:text:1.0"
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _xml(text: str) -> str:
    return escape(_CONTROL.sub("", text))


class Xlsx:
    """A workbook as sheets of text rows."""

    def __init__(self, data: bytes | None = None) -> None:
        self.sheets: dict[str, list[list[str]]] = {}
        if data:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                self._read(z)

    def _read(self, z: zipfile.ZipFile) -> None:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            for si in ET.fromstring(z.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in si.iter(f"{{{MAIN}}}t")))
        targets = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in ET.fromstring(z.read("xl/workbook.xml")).iter(f"{{{MAIN}}}sheet"):
            target = targets[sheet.get(f"{{{REL}}}id")]
            name = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
            rows: list[list[str]] = []
            for row in ET.fromstring(z.read(name)).iter(f"{{{MAIN}}}row"):
                at = int(row.get("r", len(rows) + 1))
                rows += [[] for _ in range(at - len(rows))]
                cells = rows[at - 1]
                for c in row:
                    col = parse_ref(c.get("r"))[0] if c.get("r") else len(cells) + 1
                    cells += [""] * (col - len(cells))
                    cells[col - 1] = self._value(c, shared)
            self.sheets[sheet.get("name")] = rows

    @staticmethod
    def _value(c: ET.Element, shared: list[str]) -> str:
        v, kind = c.find(f"{{{MAIN}}}v"), c.get("t")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{{{MAIN}}}t"))
        text = (v.text or "") if v is not None else ""
        if kind == "s":
            return shared[int(text)]
        if kind == "b":
            return "TRUE" if text == "1" else "FALSE"
        return text

    @staticmethod
    def _cell(ref: str, text: str, typed: bool) -> str:
        if text == "":
            return ""
        if typed:
            if re.fullmatch(r"[+-]?\d+", text) and -(1 << 63) <= int(text) < 1 << 63:
                return f'<c r="{ref}"><v>{int(text)}</v></c>'
            n = S.py_num(text)
            if n is not None and n == n and abs(n) != float("inf"):
                return f'<c r="{ref}"><v>{n!r}</v></c>'
            if text.lower() in ("true", "false"):
                return f'<c r="{ref}" t="b"><v>{int(text.lower() == "true")}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{_xml(text)}</t></is></c>'

    def to_bytes(self, typed: bool = False, auto_filter: bool = False) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            n = len(self.sheets)
            parts = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, n + 1))
            z.writestr("[Content_Types].xml", f'<?xml version="1.0" encoding="UTF-8"?><Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
            z.writestr("_rels/.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
            z.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, n + 1)) + "</Relationships>")
            z.writestr("xl/workbook.xml", f'<?xml version="1.0" encoding="UTF-8"?><workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(self.sheets, 1)) + "</sheets></workbook>")
            for i, rows in enumerate(self.sheets.values(), 1):
                body = "".join(f'<row r="{r}">' + "".join(self._cell(f"{column_letters(c)}{r}", v, typed and r > 1) for c, v in enumerate(row, 1)) + "</row>" for r, row in enumerate(rows, 1))
                width = max(map(len, rows), default=0)
                bar = f'<autoFilter ref="A1:{column_letters(width)}{len(rows)}"/>' if auto_filter and width else ""
                z.writestr(f"xl/worksheets/sheet{i}.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData>{bar}</worksheet>')
        return out.getvalue()


class Ods:
    """The same of an OpenDocument spreadsheet; all cells are text."""

    def __init__(self, data: bytes | None = None) -> None:
        self.sheets: dict[str, list[list[str]]] = {}
        if data:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for table in ET.fromstring(z.read("content.xml")).iter(f"{{{TABLE}}}table"):
                    self.sheets[table.get(f"{{{TABLE}}}name")] = self._rows(table)

    @staticmethod
    def _rows(table: ET.Element) -> list[list[str]]:
        rows: list[list[str]] = []
        for row in table.iter(f"{{{TABLE}}}table-row"):
            cells: list[str] = []
            for c in row:
                paragraphs = ["".join(p.itertext()) for p in c.iter(f"{{{TEXT}}}p")]
                times = int(c.get(f"{{{TABLE}}}number-columns-repeated", 1))
                text = "\n".join(paragraphs) or c.get(f"{{{OFFICE}}}value") or ""
                cells += [text] * (times if text or times < 1000 else 0)
            while cells and cells[-1] == "":
                cells.pop()
            times = int(row.get(f"{{{TABLE}}}number-rows-repeated", 1))
            rows += [list(cells) for _ in range(times if cells or times < 1000 else 0)]
        while rows and not rows[-1]:
            rows.pop()
        return rows

    def to_bytes(self, **_: object) -> bytes:
        def cell(v: str) -> str:
            return f'<table:table-cell office:value-type="string">{"".join(f"<text:p>{_xml(p)}</text:p>" for p in v.split(chr(10)))}</table:table-cell>' if v else "<table:table-cell/>"

        body = "".join(f"<table:table table:name={quoteattr(name)}>" + "".join("<table:table-row>" + "".join(map(cell, row)) + "</table:table-row>" for row in rows) + "</table:table>" for name, rows in self.sheets.items())
        kind = "application/vnd.oasis.opendocument.spreadsheet"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("mimetype", kind, zipfile.ZIP_STORED)
            z.writestr("META-INF/manifest.xml", f'<?xml version="1.0" encoding="UTF-8"?><manifest:manifest xmlns:manifest="urn:oasis:names:tc:opendocument:xmlns:manifest:1.0" manifest:version="1.2"><manifest:file-entry manifest:full-path="/" manifest:media-type="{kind}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>')
            z.writestr("content.xml", f'<?xml version="1.0" encoding="UTF-8"?><office:document-content xmlns:office="{OFFICE}" xmlns:table="{TABLE}" xmlns:text="{TEXT}" office:version="1.2"><office:body><office:spreadsheet>{body}</office:spreadsheet></office:body></office:document-content>')
        return out.getvalue()


def _book(path: str) -> type[Xlsx] | type[Ods]:
    kind = {"xlsx": Xlsx, "ods": Ods}.get(path.lower().rpartition(".")[2])
    if kind is None:
        raise UnsupportedFormat(path)
    return kind


def sheet_names(spark: SparkSession, path: str) -> list[str]:
    return list(_book(path)(read_bytes(spark, path)).sheets)


def read_sheet(spark: SparkSession, path: str, sheet: str | None = None, header: bool = True) -> Query:
    """A sheet as a table of text; the first sheet if none is named."""
    sheets = _book(path)(read_bytes(spark, path)).sheets
    name = sheet or next(iter(sheets), None)
    if name not in sheets:
        raise UnsupportedFormat(f"{path} has no sheet {name!r}")
    rows = sheets[name]
    width = max(map(len, rows), default=0)
    if header and rows:
        return Query.from_rows(spark, rows[1:], [*rows[0], *[""] * (width - len(rows[0]))])
    return Query.from_rows(spark, rows, [f"column{i + 1}" for i in range(width)])


def iterate_sheet(spark: SparkSession, path: str, sheet: str | None = None) -> Iterator[Row]:
    sheets = _book(path)(read_bytes(spark, path)).sheets
    rows = sheets[sheet or next(iter(sheets))]
    for r in rows[1:]:
        yield Row(rows[0], r)


def write_sheet(q: Query, path: str, sheet: str = "Sheet1", header: bool = True, type_infer: bool = False, auto_filter: bool = False) -> None:
    write_rows(q.df.sparkSession, path, ([q.headers] if header else []) + q.to_rows(), sheet, type_infer, auto_filter)


def write_rows(spark: SparkSession, path: str, rows: Iterable[list[str]], sheet: str = "Sheet1", type_infer: bool = False, auto_filter: bool = False) -> None:
    book = _book(path)()
    book.sheets[sheet] = list(rows)
    write_bytes(spark, path, book.to_bytes(typed=type_infer, auto_filter=auto_filter))


def append_sheet(q: Query, path: str, sheet: str) -> None:
    """Adds or replaces a sheet; makes the file if there is none."""
    try:
        book = _book(path)(read_bytes(q.df.sparkSession, path))
    except Exception as e:  # the file system's own error for a missing file
        if "FileNotFound" not in str(e) and "does not exist" not in str(e):
            raise
        book = _book(path)()
    book.sheets[sheet] = [q.headers, *q.to_rows()]
    write_bytes(q.df.sparkSession, path, book.to_bytes())
