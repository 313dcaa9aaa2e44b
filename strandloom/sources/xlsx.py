"""A Python data source for XLSX workbooks: every sheet, cells as strings.

Sheets are pulled row by row from the compressed file, so a task holds one row, the shared strings and a batch of records,
however long a sheet is.  A workbook can be read in ``parts``: each walks over the sheet and builds the records of every
``parts``-th run of rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from typing import IO
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

#: Rows of a run, and of a batch.
RUN = 1024
_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _column(reference: str) -> int:
    """Column number, from zero, of a cell reference."""
    n = 0
    for c in re.match("[A-Z]*", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _pulled(file: IO[bytes], tag: str) -> Iterator[ElementTree.Element]:
    """Each element of a name as it is read; what has been read goes."""
    events = ElementTree.iterparse(file, ("start", "end"))
    _, root = next(events)
    above = root
    for event, node in events:
        if event == "start" and node.tag != tag:
            above = node if node.tag == f"{_MAIN}sheetData" else above
        elif event == "end" and node.tag == tag:
            yield node
            above.clear()


def rows_of(raw: bytes | IO[bytes], part: int = 0, parts: int = 1, sheet: str | None = None, columns: Sequence[str] | None = None) -> Iterator[tuple[str, int, dict[str, str]]]:
    """Sheet, number in the workbook and record of each row below a header; blank cells are empty, blank header cells ``column_{i}``.

    Only records of the runs that fall to ``part``, of one ``sheet`` if it is named, with the ``columns`` that are named.
    """
    with zipfile.ZipFile(io.BytesIO(raw) if isinstance(raw, bytes) else raw) as book:
        names, shared, number = book.namelist(), [], -1
        if "xl/sharedStrings.xml" in names:
            with book.open("xl/sharedStrings.xml") as file:
                shared = [_text(x) for x in _pulled(file, f"{_MAIN}si")]
        for name in sorted(n for n in names if re.fullmatch(r"xl/worksheets/[^/]+\.xml", n)):
            header: list[str] | None = None
            with book.open(name) as file:
                for row in _pulled(file, f"{_MAIN}row"):
                    if header is not None:
                        number += 1
                        if number // RUN % parts != part or sheet not in (None, name):
                            continue
                    cells: dict[int, str] = {}
                    for at, cell in enumerate(row.iter(f"{_MAIN}c")):
                        place = _column(cell.get("r", "")) if cell.get("r") else at
                        if header is not None and columns is not None and (place >= len(header) or header[place] not in columns):
                            continue
                        value = cell.find(f"{_MAIN}v")
                        kind = cell.get("t")
                        cells[place] = _text(cell) if kind == "inlineStr" else "" if value is None else shared[int(value.text)] if kind == "s" else value.text or ""
                    if header is None:
                        header = [cells.get(i) or f"column_{i}" for i in range(max(cells, default=-1) + 1)]
                        continue
                    yield name, number, {h: cells.get(i, "") for i, h in enumerate(header) if columns is None or h in columns}


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.parts, self.sheet = options["path"].split(","), int(options.get("parts", 1)), None
        self.columns = options["columns"].split(",") if "columns" in options else None

    def partitions(self) -> list[InputPartition]:
        return [InputPartition((p, i)) for p in self.paths for i in range(self.parts)]

    def read(self, partition: InputPartition):
        path, part = partition.value
        with open(path, "rb") as file:
            for sheet, i, record in rows_of(file, part, self.parts, self.sheet, self.columns):
                yield path, sheet, i, record


class _Pushing(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """A sheet that is asked for by name is the only one whose records are built."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("sheet",) and self.sheet is None:
                self.sheet = f.value
            else:
                yield f


class XlsxSource(DataSource):
    """``spark.read.format("xlsx").load(path)`` for files that every executor can open by path.

    Options: ``parts``, tasks for each workbook; ``columns``, the headers to keep, parted by commas; ``pushdown``, whether a
    filter on ``sheet`` is pushed down, which needs ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "xlsx"

    def schema(self) -> str:
        return "source_file string, sheet string, record_ord bigint, record map<string,string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return (_Pushing if self.options.get("pushdown") == "true" else _Reader)(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(XlsxSource)


def read_xlsx(spark: SparkSession, path: str, parts: int = 1, columns: Sequence[str] | None = None) -> DataFrame:
    """``source_file, sheet, record_ord, record`` of every workbook at ``path``, through Spark's own file systems."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held: list[tuple[str, int, dict[str, str]]] = []

                def flush() -> pa.RecordBatch:
                    columns_ = [[name] * len(held), [s for s, _, _ in held], [i for _, i, _ in held], [list(r.items()) for _, _, r in held]]  # noqa: B023
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns_, kinds, strict=True)], ["source_file", "sheet", "record_ord", "record"])

                for row in rows_of(raw, part, parts, None, columns):
                    held.append(row)
                    if len(held) == RUN:
                        yield flush()
                        held.clear()
                if held:
                    yield flush()

    return (files.repartition(parts, "part") if parts > 1 else files).mapInArrow(run, "source_file string, sheet string, record_ord bigint, record map<string,string>")
