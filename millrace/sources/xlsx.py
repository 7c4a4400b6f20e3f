"""Workbooks as a Spark data source: tasks write the rows of sheets, the commit puts them together.

    spark.dataSource.register(Workbooks)
    rows.repartitionByRange("book", "sheet", "place").sortWithinPartitions("book", "sheet", "place") \\
        .write.format("xlsx").mode("append").option("parts", shared).save(folder)

Rows are (book, sheet, place, top, spec, cells), see ROWS; place 1 stands in row `top` of the sheet. A sheet is its row of place 0, whose `spec` is a JSON text (SPEC), and
its cells from place 1 on, in any task. A task writes one file of parts in the folder `parts`, which driver and executors
share, and tells where each sheet's part lies; only that goes through the driver, and files of lost attempts count for nothing.
The commit copies parts into workbooks a block at a time, gives files and sheets free names and moves each workbook into place
at once; `receipt` names a file that then lists them. An abort removes the parts and writes no workbook.

A book of no sheet with a spec, and cells of a sheet without one, are an error. Sheets hold as many rows as the format allows
(1,048,576), a row beyond is an error too.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path

from pyarrow import fs as filesystems
from pyspark.sql import Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from millrace.operators.workbook import Chart, Sheet, cell_at, file_name, free_path, row_of_texts, sheet_name, write_workbook

ROWS = "book string, sheet int, place int, top int, spec string, cells array<struct<kind:string,value:string,url:string>>"
#: What a sheet says of itself: its file's name pattern and tokens, its own name, title lines, the link of the third one,
#: headers, kinds and widths of columns, `top`, whether it is hidden or shades prices, and its charts.
SPEC = (
    "pattern string, company string, commodity string, name string, title array<string>, link string, headers array<string>, kinds array<string>, "
    "widths array<double>, top int, hidden boolean, best boolean, charts array<struct<kind:string,title:string,first:int,count:int>>"
)
#: Rows of a sheet, by the format.
SHEET_ROWS = 1_048_576
BLOCK = 1 << 20


@dataclass
class _Part:
    book: str
    sheet: int
    first: int
    last: int
    spec: str | None
    file: str
    start: int
    size: int
    links: list[tuple[str, str]]


@dataclass
class _Written(WriterCommitMessage):
    parts: list[_Part]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict):
        self.folder = options["path"]
        shared = options.get("parts") or self.folder
        self.parts = f"{shared.rstrip('/')}/parts-{uuid.uuid4().hex}"
        self.tokens = json.loads(options.get("tokens", "{}"))
        self.decimals = json.loads(options.get("decimals", "{}"))
        self.receipt = options.get("receipt")

    def _place(self) -> tuple[filesystems.FileSystem, str]:
        return filesystems.FileSystem.from_uri(self.parts if ":" in self.parts else str(Path(self.parts).absolute()))

    def write(self, iterator: Iterator[Row]) -> _Written:
        store, base = self._place()
        store.create_dir(base, recursive=True)
        file, parts, at = f"{base}/{uuid.uuid4().hex}.xml", [], 0
        with store.open_output_stream(file, compression=None) as out:
            for (book, sheet), rows in groupby(iterator, lambda r: (r.book, r.sheet)):
                part = _Part(book, sheet, 0, 0, None, file, at, 0, [])
                for row in rows:
                    if row.place == 0:
                        part.spec = row.spec
                        continue
                    number = row.top + row.place - 1
                    if number > SHEET_ROWS:
                        raise ValueError(f"sheet {sheet} of {book} has more rows than a sheet can hold")
                    text = row_of_texts(number, [(c.kind, c.value) for c in row.cells]).encode()
                    out.write(text)
                    part.links += [(cell_at(number, k), c.url) for k, c in enumerate(row.cells) if c.url]
                    part.first, part.last, part.size = part.first or number, number, part.size + len(text)
                at += part.size
                parts.append(part)
        return _Written(parts)

    def _read(self, parts: list[_Part]) -> Iterator[bytes]:
        store, _ = self._place()
        for part in parts:
            with store.open_input_file(part.file) as f:
                f.seek(part.start)
                left = part.size
                while left:
                    block = f.read(min(BLOCK, left))
                    left -= len(block)
                    yield block

    def _sheet(self, parts: list[_Part], taken: set[str]) -> tuple[Sheet, dict]:
        said = [p.spec for p in parts if p.spec]
        if len(said) != 1:
            raise ValueError(f"sheet {parts[0].sheet} of {parts[0].book} has {len(said)} rows that say what it is")
        spec = json.loads(said[0])
        parts = sorted((p for p in parts if p.size), key=lambda p: p.first)
        charts = [Chart(c["kind"], c["title"], c["first"], c["count"]) for c in spec.get("charts") or []]
        links = [("A3", spec["link"])] if spec.get("link") else []
        name = spec["name"] if spec["hidden"] else sheet_name(spec["name"], taken)
        sheet = Sheet(
            name, spec["title"], spec["headers"], spec["kinds"], spec["widths"], [], spec["hidden"], spec["top"], charts,
            links + [x for p in parts for x in p.links], spec["best"], self._read(parts), parts[-1].last if parts else 0,
        )
        return sheet, spec

    def commit(self, messages: list[_Written | None]) -> None:
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: (p.book, p.sheet))
        paths = []
        for _, of_book in groupby(parts, lambda p: p.book):
            taken: set[str] = set()
            sheets = [self._sheet(list(of_sheet), taken) for _, of_sheet in groupby(of_book, lambda p: p.sheet)]
            spec = sheets[0][1]
            name = file_name(spec["pattern"], **self.tokens, company=spec.get("company") or "", commodity=spec.get("commodity") or "")
            paths.append(write_workbook(free_path(Path(self.folder.removeprefix("file:")), name), [s for s, _ in sheets], self.decimals))
        if self.receipt:
            Path(self.receipt).write_text(json.dumps([str(p) for p in paths]))
        self._clean()

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean()

    def _clean(self) -> None:
        store, base = self._place()
        if store.get_file_info(base).type == filesystems.FileType.Directory:
            store.delete_dir(base)


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))
