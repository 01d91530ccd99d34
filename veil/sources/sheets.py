"""Excel workbooks (.xlsx) without a library: zipped XML, read and written on the driver, as sheets are small by nature."""

from __future__ import annotations

import datetime
import io
import re
import zipfile
from collections.abc import Iterator, Mapping
from typing import Any
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from veil.errors import UnsupportedFormatError

MOST_ROWS = 1_048_575
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _open(path: str) -> zipfile.ZipFile:
    fs, at = _store(path)
    try:
        with fs.open_input_stream(at) as f:
            return zipfile.ZipFile(io.BytesIO(f.read()))
    except zipfile.BadZipFile as e:
        raise UnsupportedFormatError(f"{path} is no .xlsx workbook", "Older .xls files must be saved as .xlsx first.") from e


def _sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """Part of each sheet by name, in order."""
    links = {r.get("Id"): r.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).findall("m:sheets/m:sheet", _NS)
    return {s.get("name", ""): (lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}")(links[s.get(_REL)]) for s in found}


def sheet_names(path: str) -> list[str]:
    with _open(path) as book:
        return list(_sheets(book))


def _column(name: str) -> int:
    """A to 0, Z to 25, AA to 26."""
    n = 0
    for c in re.match("[A-Z]*", name).group():
        n = n * 26 + ord(c) - 64
    return n - 1


def _letters(i: int) -> str:
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


def _cells(book: zipfile.ZipFile, part: str) -> Iterator[list[str | None]]:
    shared = []
    if "xl/sharedStrings.xml" in book.namelist():
        shared = ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml"))]
    last = 0
    for row in ElementTree.fromstring(book.read(part)).findall("m:sheetData/m:row", _NS):
        number = int(row.get("r", last + 1))
        for _ in range(last + 1, number):
            yield []
        last, out = number, []
        for cell in row.findall("m:c", _NS):
            at = _column(cell.get("r", "")) if cell.get("r") else len(out)
            out += [None] * (at - len(out))
            value, kind = cell.find("m:v", _NS), cell.get("t")
            if kind == "inlineStr":
                out.append("".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")))
            elif value is None or value.text is None:
                out.append(None)
            elif kind == "s":
                out.append(shared[int(value.text)])
            elif kind == "b":
                out.append("true" if value.text == "1" else "false")
            else:
                out.append(value.text)
        yield out


def read_sheet(spark: SparkSession, path: str, sheet: str | int = 0, *, header: bool = True, skip_rows: int = 0, columns: list[str] | str | None = None, rows: int | None = None) -> DataFrame:
    """A sheet by name or number as strings; empty cells are null.

    columns: names, or letters such as "A:C,E".  Names that are missing are _1, _2, ...; names that repeat get a number.
    """
    with _open(path) as book:
        parts = _sheets(book)
        if isinstance(sheet, str) and sheet not in parts:
            raise UnsupportedFormatError(f"no sheet {sheet!r}", f"Sheets: {', '.join(parts)}.")
        lines = list(_cells(book, parts[sheet] if isinstance(sheet, str) else list(parts.values())[sheet]))[skip_rows:]
    names = lines.pop(0) if header and lines else []
    width = max([len(names), *map(len, lines)], default=0)
    taken: set[str] = set()
    shown = []
    for i in range(width):
        name = (names[i] if i < len(names) else None) or f"_{i + 1}"
        while name in taken:
            name = f"{name}_{i + 1}"
        taken.add(name)
        shown.append(name)
    chosen = list(range(width))
    if isinstance(columns, str):
        spans = [p.strip().upper().split(":") for p in columns.split(",")]
        chosen = [i for s in spans for i in range(_column(s[0]), _column(s[-1]) + 1) if i < width]
    elif columns:
        chosen = [shown.index(c) for c in columns]
    table = [tuple(line[i] if i < len(line) else None for i in chosen) for line in lines[:rows] if any(v is not None for v in line)]
    return spark.createDataFrame(table, ", ".join(f"`{shown[i]}` string" for i in chosen) or "_1 string")


def read_sheets(spark: SparkSession, path: str, **options: Any) -> dict[str, DataFrame]:
    return {name: read_sheet(spark, path, name, **options) for name in sheet_names(path)}


def _cell(at: str, value: Any) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int | float) and value == value and abs(value) != float("inf") and (isinstance(value, float) or abs(value) < 1 << 53):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    text = value.isoformat() if isinstance(value, datetime.date) else str(value)
    clean = re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "�", text)  # which XML can't hold
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(clean)}</t></is></c>'


def write_sheets(sheets: Mapping[str, DataFrame], path: str, most_rows: int = MOST_ROWS) -> None:
    """A workbook of several sheets; one with more rows than a sheet holds is refused."""
    fs, at = _store(path)
    for name in sheets:
        if not name or len(name) > 31 or re.search(r"[\[\]:*?/\\]", name):
            raise UnsupportedFormatError(f"{name!r} is no name for a sheet")
    held = {name: (df, df.limit(most_rows + 1).collect()) for name, df in sheets.items()}
    if any(len(rows) > most_rows for _, rows in held.values()):
        raise UnsupportedFormatError(f"a sheet holds at most {most_rows} rows", "Write CSV or Parquet instead.")
    names = list(sheets)
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    numbers = range(1, len(names) + 1)
    with fs.open_output_stream(f"{at}.new") as out, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("[Content_Types].xml", f'<?xml version="1.0"?><Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in numbers) + "</Types>")
        book.writestr("_rels/.rels", f'<?xml version="1.0"?><Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<?xml version="1.0"?><Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in numbers) + "</Relationships>")
        book.writestr("xl/workbook.xml", f'<?xml version="1.0"?><workbook xmlns="{_NS["m"]}" xmlns:r="{_OFFICE}"><sheets>' + "".join(f'<sheet name={quoteattr(n)} sheetId="{i}" r:id="rId{i}"/>' for i, n in zip(numbers, names, strict=True)) + "</sheets></workbook>")
        for i, (df, rows) in zip(numbers, held.values(), strict=True):
            letters = [_letters(j) for j in range(len(df.columns))]
            with book.open(f"xl/worksheets/sheet{i}.xml", "w") as sheet:
                line = lambda row, n, letters=letters: f'<row r="{n}">{"".join(_cell(f"{c}{n}", v) for c, v in zip(letters, row, strict=True))}</row>'.encode()
                sheet.write(f'<?xml version="1.0"?><worksheet xmlns="{_NS["m"]}"><sheetData>'.encode() + line(df.columns, 1))
                for n, row in enumerate(rows, 2):
                    sheet.write(line(row, n))
                sheet.write(b"</sheetData></worksheet>")
    fs.move(f"{at}.new", at)
