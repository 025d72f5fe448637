"""Workbooks as a data source: a partition a sheet, streamed out of the file's ZIP.

A sheet's XML is parsed row by row and handed on in batches, so a task holds one batch and the workbook's shared
strings, as one array of bytes with offsets. Files are opened through `pyarrow.fs`, by ranges.
"""

from __future__ import annotations

import json
import zipfile
from array import array
from collections.abc import Iterator
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH_ROWS = 5_000
#: Namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
FILE, SHEET = "_source_file", "_sheet"
ALL = "*"


def opened(path: str) -> pa.NativeFile:
    """A file by its URI, or by a local path."""
    if "://" not in path:
        path = path.replace("file:", "", 1)
        return pa.fs.LocalFileSystem().open_input_file(path)
    store, name = pa.fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


class Shared:
    """The workbook's shared strings."""

    def __init__(self, book: zipfile.ZipFile):
        self.text, self.ends = bytearray(), array("q", [0])
        if "xl/sharedStrings.xml" not in book.namelist():
            return
        with book.open("xl/sharedStrings.xml") as part:
            root = None
            for event, el in ElementTree.iterparse(part, events=("start", "end")):
                root = el if root is None else root
                if event == "end" and el.tag == f"{MAIN}si":
                    # phonetic hints stand in runs of their own and are no text
                    hints = {id(t) for r in el.iter(f"{MAIN}rPh") for t in r.iter(f"{MAIN}t")}
                    self.text += "".join(t.text or "" for t in el.iter(f"{MAIN}t") if id(t) not in hints).encode()
                    self.ends.append(len(self.text))
                    root.clear()

    def __getitem__(self, i: int) -> str:
        return self.text[self.ends[i] : self.ends[i + 1]].decode()


def sheets(book: zipfile.ZipFile) -> dict[str, str]:
    """The part of each sheet, by its name, in their order."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    found = ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")
    return {s.get("name"): target.lstrip("/") if (target := links[s.get(LINK)]).startswith("/") else f"xl/{target}" for s in found}


def column_of(reference: str) -> int:
    """From 0: A is 0, AA is 26."""
    out = 0
    for x in reference:
        if x.isalpha():
            out = out * 26 + ord(x.upper()) - 64
    return out - 1


def rows_of(part: IO[bytes], shared: Shared) -> Iterator[list[str | None]]:
    """The cells of each row as text; rows and cells that the file leaves out are empty."""
    data, at = None, 0
    for event, el in ElementTree.iterparse(part, events=("start", "end")):
        if event == "start":
            data = el if el.tag == f"{MAIN}sheetData" else data
        elif el.tag == f"{MAIN}row":
            number = int(el.get("r") or at + 1)
            while at + 1 < number:
                at += 1
                yield []
            at = number
            cells: list[str | None] = []
            for c in el.findall(f"{MAIN}c"):
                place = column_of(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (place - len(cells))
                kind, value = c.get("t"), c.findtext(f"{MAIN}v")
                if kind == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter(f"{MAIN}t"))
                elif kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind == "b" and value is not None:
                    value = "true" if value == "1" else "false"
                elif kind == "e":
                    value = None  # an error such as #N/A
                cells.append(value)
            yield cells
            data.clear()


def header_of(path: str, sheet: str | None) -> list[str]:
    """The first row's names. Only that row is read."""
    with opened(path) as file, zipfile.ZipFile(file) as book:
        with book.open(part_of(book, path, sheet)) as part:
            return [c or "" for c in next(rows_of(part, Shared(book)), [])]


def part_of(book: zipfile.ZipFile, path: str, sheet: str | None) -> str:
    held = sheets(book)
    if sheet is not None and sheet not in held:
        raise ValueError(f"{path} has no sheet {sheet!r}")
    return held[sheet] if sheet is not None else next(iter(held.values()))


class Part(InputPartition):
    def __init__(self, path: str, sheet: str | None):
        self.path, self.sheet = path, sheet


class WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, paths: list[str], sheet: str | None):
        self.names, self.paths, self.sheet = [n for n in schema.names if n not in (FILE, SHEET)], paths, sheet

    def partitions(self) -> list[Part]:
        if self.sheet != ALL:
            return [Part(p, self.sheet) for p in self.paths]
        out = []
        for path in self.paths:
            with opened(path) as file, zipfile.ZipFile(file) as book:
                out += [Part(path, s) for s in sheets(book)]
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in (*self.names, FILE, SHEET)])
        with opened(part.path) as file, zipfile.ZipFile(file) as book:
            sheet = part.sheet if part.sheet is not None else next(iter(sheets(book)))
            with book.open(part_of(book, part.path, sheet)) as xml:
                rows = rows_of(xml, Shared(book))
                head = {n: k for k, n in reversed(list(enumerate(next(rows, []))))}  # of repeated names the first counts
                places = [head.get(n, -1) for n in self.names]
                held: list[list[str | None]] = []

                def batch() -> pa.RecordBatch:
                    columns = [pa.array([r[k] if 0 <= k < len(r) else None for r in held], pa.string()) for k in places]
                    return pa.RecordBatch.from_arrays([*columns, pa.array([part.path] * len(held)), pa.array([sheet] * len(held))], schema=schema)

                for row in rows:
                    if not any(c is not None for c in row):
                        continue
                    held.append(row)
                    if len(held) == BATCH_ROWS:
                        yield batch()
                        held.clear()
                if held:
                    yield batch()


class WorkbookSource(DataSource):
    """Options: paths (a JSON list of files), sheet (a name, `*` for all, by default the first)."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _paths(self) -> list[str]:
        return json.loads(self.options["paths"])

    def schema(self) -> T.StructType:
        sheet = self.options.get("sheet")
        names = [n for n in header_of(self._paths()[0], None if sheet == ALL else sheet) if n]
        return T.StructType([T.StructField(n, T.StringType()) for n in (*dict.fromkeys(names), FILE, SHEET)])

    def reader(self, schema: T.StructType) -> WorkbookReader:
        return WorkbookReader(schema, self._paths(), self.options.get("sheet"))


def read_workbooks(spark: SparkSession, paths: list[str], sheet: str | None = None) -> DataFrame:
    """One sheet of each workbook, or all of them: all cells as text, and each row's file and sheet.

    The first workbook's first row names the columns; a column that another one lacks is null there, others are left
    out. Rows without any cell don't count.
    """
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").option("paths", json.dumps(paths))
    return (reader.option("sheet", sheet) if sheet is not None else reader).load()
