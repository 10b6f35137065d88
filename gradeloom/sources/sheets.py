"""Workbooks read by several tasks (S4): a Python data source that is cut into ranges of rows.

A workbook's sheet is one compressed stream, so each task inflates it from the start, but looks into the cells of its
own rows only and stops after them: up to there pieces are passed over by the number of their last row. As each task
reads what lies before its rows, a workbook is cut into a bounded number of parts, so the work grows with its rows, not
with their square. A task holds one piece of the sheet and the workbook's shared strings. (CSV files are cut by Spark's
own reader.)
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gradeloom.sources.files import canonical

SCHEMA = "path string, row long, cells map<string,string>"
NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
ROW = re.compile(rb'<row\b[^>]*?\br="(\d+)"')
#: Bytes of a sheet read at once, and parts of a workbook at most.
CHUNK, PARTS = 1 << 20, 128


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def column_of(place: str) -> int:
    """A cell's column from its place such as AB12, from 0."""
    n = 0
    for letter in place:
        if not letter.isalpha():
            break
        n = n * 26 + ord(letter.upper()) - 64
    return n - 1


def cells_of(row: ElementTree.Element, shared: list[str]) -> list[str]:
    found: dict[int, str] = {}
    for i, cell in enumerate(row.iter(f"{NS}c")):
        kind, value = cell.get("t"), cell.find(f"{NS}v")
        text = "".join(t.text or "" for t in cell.iter(f"{NS}t")) if kind == "inlineStr" else (value.text or "" if value is not None else "")
        if kind == "s" and text:
            text = shared[int(text)]
        elif kind == "b":
            text = {"1": "TRUE", "0": "FALSE"}.get(text, text)
        found[column_of(cell.get("r")) if cell.get("r") else i] = text
    return [found.get(i, "") for i in range(max(found, default=-1) + 1)]


class Workbook:
    """The first sheet of an open workbook."""

    def __init__(self, file):
        self.zip = zipfile.ZipFile(file)
        sheets = [n for n in self.zip.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        if not sheets:
            raise ValueError("a workbook without sheets")
        self.sheet = min(sheets, key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2]).group()))

    def shared(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        root = ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml"))
        return ["".join(t.text or "" for t in item.iter(f"{NS}t")) for item in root.iter(f"{NS}si")]

    def last_row(self) -> int:
        """The last row as the sheet's head tells it, 0 if it does not."""
        with self.zip.open(self.sheet) as f:
            found = re.search(rb'<dimension ref="[A-Z]+\d+:[A-Z]+(\d+)"', f.read(4096))
        return int(found.group(1)) if found else 0

    def rows(self, first: int, last: int | None, shared: list[str]) -> Iterator[tuple[int, list[str]]]:
        """Rows from first to last (None: to the end) with their numbers: what lies before is passed over, the rest is not read."""
        with self.zip.open(self.sheet) as f:
            held, number = b"", 0
            while True:
                chunk = f.read(CHUNK)
                held += chunk
                at = 0
                # rows ascend: where the last that began is still before the first wanted, none before it is looked at
                begun = held.rfind(b"<row ")
                told = ROW.match(held, begun) if begun > 0 else None
                if told and int(told.group(1)) < first:
                    at = begun
                while True:
                    begin = held.find(b"<row", at)
                    if begin < 0:
                        break
                    tag = held.find(b">", begin)
                    if tag < 0:
                        break
                    end = tag + 1 if held[tag - 1 : tag] == b"/" else held.find(b"</row>", tag) + 6
                    if end < tag:
                        break
                    told = ROW.match(held[begin : tag + 1])
                    number = int(told.group(1)) if told else number + 1
                    if last is not None and number > last:
                        return
                    if number >= first:
                        row = held[begin:end].replace(b"<row", b'<row xmlns="' + NS[1:-1].encode() + b'"', 1)
                        yield number, cells_of(ElementTree.fromstring(row), shared)
                    at = end
                held = held[at:]
                if not chunk:
                    return


@dataclass
class Part(InputPartition):
    path: str
    first: int
    last: int | None


def header_of(cells: list[str], name: str) -> list[str]:
    head = [x.strip() for x in cells]
    keys = [k for k in map(canonical, head) if k]
    if len(keys) != len(set(keys)):
        raise ValueError(f"{name}: repeated headers")
    return head


class SheetReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.rows = int(options.get("rows", 100_000))

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths:
            store, place = store_of(path)
            with store.open_input_file(place) as f:
                last = Workbook(f).last_row()
            cuts = list(range(1, max(2, last + 1), max(self.rows, -(-last // PARTS))))
            out += [Part(path, a, b) for a, b in zip(cuts, [*(c - 1 for c in cuts[1:]), None], strict=True)]
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        store, place = store_of(partition.path)
        with store.open_input_file(place) as f:
            book = Workbook(f)
            shared = book.shared()
            # the header is the first row that is not empty
            head_at, head = next(((n, r) for n, r in book.rows(1, None, shared) if any(x.strip() for x in r)), (0, []))
            head = header_of(head, partition.path)
            for n, row in book.rows(max(partition.first, head_at + 1), partition.last, shared):
                if any(x.strip() for x in row):
                    yield partition.path, n, {h: (row[i] if i < len(row) else "") for i, h in enumerate(head) if h}


class SheetSource(DataSource):
    """format("gradeloom_workbook"): path (several by commas) and rows to a task."""

    @classmethod
    def name(cls) -> str:
        return "gradeloom_workbook"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SheetReader:
        return SheetReader(dict(self.options))


def read_workbooks(spark: SparkSession, paths: list[str], rows: int = 100_000) -> DataFrame:
    """Path, row and cells (header -> text) of workbooks, each read by as many tasks as its rows ask for."""
    spark.dataSource.register(SheetSource)
    return spark.read.format("gradeloom_workbook").option("path", ",".join(paths)).option("rows", rows).load()


def workbook(rows: list[list[str]]) -> bytes:
    """A workbook of one sheet with the cells as text."""
    name = lambda i: (chr(64 + i // 26) if i >= 26 else "") + chr(65 + i % 26)
    body = "".join(f'<row r="{n}">' + "".join(f'<c r="{name(i)}{n}" t="inlineStr"><is><t xml:space="preserve">{escape(x)}</t></is></c>' for i, x in enumerate(r)) + "</row>" for n, r in enumerate(rows, 1))
    wide = max(map(len, rows), default=1)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="{NS[1:-1]}"><dimension ref="A1:{name(wide - 1)}{max(1, len(rows))}"/><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()
