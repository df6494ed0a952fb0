"""Sheets of xlsx workbooks as tables.

Spark reads the files, from any store that it knows; a task unpacks one workbook and streams one sheet's cells against the shared strings.  Each sheet is a
table of its own, so sheets are read side by side, and only the columns that are asked for leave the task.
"""

from __future__ import annotations

import datetime as dt
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree.ElementTree import Element, iterparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 2_000
# Number formats that mean dates and times, and the day that serial numbers count from.
DATES = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
EPOCH = dt.datetime(1899, 12, 30)


def _clean(value: object) -> str:
    return " ".join(str("" if value is None else value).split())


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _texts(e: Element) -> str:
    """Text of a string item, runs joined, phonetic hints left out."""
    return "".join(_texts(x) if _local(x.tag) == "r" else x.text or "" for x in e if _local(x.tag) in ("t", "r"))


class Workbook:
    """An unpacked workbook: sheets by name, shared strings, and which cell styles are dates."""

    def __init__(self, content: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        targets = {}
        for e in self._elements("xl/_rels/workbook.xml.rels", "Relationship"):
            target = e.get("Target", "")
            targets[e.get("Id")] = target.lstrip("/") if target.startswith("/") else f"xl/{target}"
        self.sheets = {}
        for e in self._elements("xl/workbook.xml", "sheet"):
            link = next(v for k, v in e.attrib.items() if _local(k) == "id")
            self.sheets[e.get("name")] = targets[link]

    def _elements(self, member: str, *names: str) -> Iterator[Element]:
        if member in self.zip.namelist():
            with self.zip.open(member) as f:
                for _, e in iterparse(f):
                    if _local(e.tag) in names:
                        yield e
                        e.clear()

    def _date_styles(self) -> set[int]:
        formats, dates, k = {}, set(), 0
        with self.zip.open("xl/styles.xml") if "xl/styles.xml" in self.zip.namelist() else io.BytesIO(b"<x/>") as f:
            inside = False
            for event, e in iterparse(f, ("start", "end")):
                name = _local(e.tag)
                if name == "cellXfs":
                    inside = event == "start"
                elif event == "start" and name == "numFmt":
                    formats[int(e.get("numFmtId"))] = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", e.get("formatCode", ""))
                elif event == "start" and name == "xf" and inside:
                    code = int(e.get("numFmtId", "0"))
                    if code in DATES or re.search("[dmyhs]", formats.get(code, ""), re.I):
                        dates.add(k)
                    k += 1
        return dates

    def find(self, name: str) -> str | None:
        return next((member for sheet, member in self.sheets.items() if _clean(sheet) == _clean(name)), None)

    def rows(self, member: str) -> Iterator[tuple[int, list[str]]]:
        """Rows that have cells, with their numbers from 0; cells that are missing are empty."""
        strings = [_texts(e) for e in self._elements("xl/sharedStrings.xml", "si")]
        dates = self._date_styles()
        number = -1
        for row in self._elements(member, "row"):
            number = int(row.get("r", number + 2)) - 1
            cells: list[str] = []
            for c in row:
                place = _column(c.get("r", "")) if c.get("r") else len(cells)
                cells += [""] * (place - len(cells) + 1)
                cells[place] = _clean(self._value(c, strings, dates))
            yield number, cells

    def _value(self, c: Element, strings: list[str], dates: set[int]) -> object:
        kind = c.get("t", "n")
        if kind == "inlineStr":
            return next((_texts(e) for e in c if _local(e.tag) == "is"), "")
        text = next((e.text for e in c if _local(e.tag) == "v"), None)
        if text is None:
            return None
        if kind == "s":
            return strings[int(text)]
        if kind == "b":
            return text == "1"
        if kind != "n":
            return text
        value = float(text) if re.search("[.eE]", text) else int(text)
        if int(c.get("s", "0")) in dates:
            return EPOCH + dt.timedelta(seconds=round(value * 86_400)) if value >= 1 else (EPOCH + dt.timedelta(seconds=round(value * 86_400))).time()
        return value


def _column(reference: str) -> int:
    n = 0
    for ch in re.match("[A-Za-z]*", reference)[0].upper():
        n = 26 * n + ord(ch) - 64
    return n - 1


def sheet(spark: SparkSession, path: str, name: str, header_row: int = 0, columns: list[str] | None = None) -> DataFrame:
    """A sheet as a table of cleaned texts, with ``row_index``, the sheet's row from 0.

    Sheet and columns are found by their names, white space and (of columns) case apart.  Columns without a header and rows without a cell go.  A workbook
    that lacks the sheet, or a sheet without the columns, raises.  Only the header is read while the plan is built.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                book = Workbook(content)
                member = book.find(name)
                cells = next((c for n, c in book.rows(member) if n >= header_row), []) if member else []
                yield pa.RecordBatch.from_pylist([{"path": file, "there": member is not None, "sheets": list(book.sheets), "cells": cells}], schema=pa.schema([("path", pa.string()), ("there", pa.bool_()), ("sheets", pa.list_(pa.string())), ("cells", pa.list_(pa.string()))]))

    found = files.mapInArrow(head, "path string, there boolean, sheets array<string>, cells array<string>").collect()  # a header per workbook
    if not found:
        raise FileNotFoundError(path)
    for r in found:
        if not r["there"]:
            raise KeyError(f"no sheet {name!r} in {r['path'].rpartition('/')[2]} (has: {', '.join(r['sheets'])})")
    wanted = None if columns is None else {_clean(c).casefold() for c in columns}
    kept: list[str] = []
    for cell in found[0]["cells"]:
        if cell and cell not in kept and (wanted is None or cell.casefold() in wanted):
            kept.append(cell)
    if not kept:
        raise ValueError(f"sheet {name!r} has none of the columns")
    schema = pa.schema([("row_index", pa.int64()), *[(c, pa.string()) for c in kept]])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                book = Workbook(content)
                at, out = None, []
                for n, cells in book.rows(book.find(name)):
                    if n < header_row:
                        continue
                    if at is None:
                        at = [max((k for k, x in enumerate(cells) if x == c), default=-1) for c in kept]
                        continue
                    values = [cells[k] if 0 <= k < len(cells) else "" for k in at]
                    if any(values):
                        out.append((n, *values))
                    if len(out) == ROWS:
                        yield _batch(out, schema)
                        out = []
                yield _batch(out, schema)

    types = ", ".join(["row_index bigint", *[f"`{c.replace('`', '``')}` string" for c in kept]])
    return files.select("content").mapInArrow(body, types)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in schema], schema)], schema=schema)


def mounted(spark: SparkSession, path: str, spec: dict[str, dict]) -> dict[str, DataFrame]:
    """The sheets that a specification names: ``alias -> {"sheet", "header_row", "columns"}``; nothing declared, nothing mounted."""
    return {alias: sheet(spark, path, want["sheet"], want.get("header_row", 0), want.get("columns")).drop("row_index") for alias, want in (spec or {}).items()}


def dump(tables: dict[str, DataFrame], path: str) -> None:
    """Tables as JSON lines, a folder each, for jobs that have no workbook to read."""
    for name, t in tables.items():
        t.select(F.struct(*[F.col(f"`{c}`") for c in t.columns]).alias("row")).select(F.to_json("row").alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def undumped(spark: SparkSession, path: str, names: dict[str, list[str]]) -> dict[str, DataFrame]:
    """Dumped tables by name, with their columns."""
    return {name: spark.read.schema(", ".join(f"`{c}` string" for c in columns)).json(f"{path}/{name}") for name, columns in names.items()}
