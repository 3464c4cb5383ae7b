"""Workbooks and series matrices as data sources: ``spark.read.format("sheet")`` and ``spark.read.format("series_matrix")`` after ``register``.

Nothing is read on the driver but what a schema needs: a sheet's first rows, a matrix's header lines. Tasks stream their rows from the file, so memory
is that of a batch (and of a workbook's table of texts). Paths are local, or URIs that Arrow's file systems open.
"""

from __future__ import annotations

import gzip
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

#: Rows of a sheet in a task, and bytes of a plain matrix.
ROWS_PER_TASK, BYTES_PER_TASK = 50_000, 32 << 20
_MISSING = {"", "NA", "null", "NaN", "nan"}


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SheetSource)
    spark.dataSource.register(SeriesMatrixSource)


def _open(path: str):
    if re.match(r"[a-z0-9+]+://", path):
        from pyarrow import fs

        system, at = fs.FileSystem.from_uri(path)
        return system.open_input_file(at)
    return open(path, "rb")


def _number(x: str | None) -> float | None:
    if x is None or x.strip() in _MISSING:
        return None
    return float(x)


# --- sheets --------------------------------------------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _column(ref: str) -> int:
    """A1 is 0, Z9 is 25, AA1 is 26."""
    n = 0
    for ch in ref:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def _events(stream, name: str) -> Iterator[ElementTree.Element]:
    """Whole elements of a name, each let go before the next is read."""
    root = None
    for kind, e in ElementTree.iterparse(stream, events=("start", "end")):
        if root is None:
            root = e
        if kind == "end" and _local(e.tag) == name:
            yield e
            e.clear()
            root.clear()


class Book:
    """One sheet of a zipped workbook."""

    def __init__(self, path: str, sheet: str = "1"):
        self.file = _open(path)
        self.zip = zipfile.ZipFile(self.file)
        self.name = self._find(sheet)
        self._texts: list[str] | None = None

    def __enter__(self) -> Book:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()
        self.file.close()

    def _find(self, sheet: str) -> str:
        targets = {}
        with self.zip.open("xl/_rels/workbook.xml.rels") as f:
            for e in _events(f, "Relationship"):
                targets[e.get("Id")] = e.get("Target").lstrip("/").removeprefix("xl/")
        sheets = []
        with self.zip.open("xl/workbook.xml") as f:
            for e in _events(f, "sheet"):
                sheets.append((e.get("name"), targets[next(v for k, v in e.attrib.items() if _local(k) == "id")]))
        for i, (name, target) in enumerate(sheets):
            if name == sheet or str(i + 1) == sheet:
                return f"xl/{target}"
        raise ValueError(f"no sheet {sheet!r} among {[n for n, _ in sheets]}")

    @property
    def texts(self) -> list[str]:
        if self._texts is None:
            self._texts = []
            if "xl/sharedStrings.xml" in self.zip.namelist():
                with self.zip.open("xl/sharedStrings.xml") as f:
                    self._texts = ["".join(t.text or "" for t in e.iter() if _local(t.tag) == "t") for e in _events(f, "si")]
        return self._texts

    def rows(self, first: int = 1, end: int | None = None) -> Iterator[tuple[int, dict[int, str]]]:
        """Numbers, from 1, and cells of the sheet's rows from one to before another; empty cells and rows are left out."""
        with self.zip.open(self.name) as f:
            number = 0
            for row in _events(f, "row"):
                number = int(row.get("r") or number + 1)
                if end is not None and number >= end:
                    return
                if number < first:
                    continue
                cells, at = {}, -1
                for c in row:
                    if _local(c.tag) != "c":
                        continue
                    at = _column(c.get("r")) if c.get("r") else at + 1
                    kind = c.get("t")
                    if kind == "inlineStr":
                        value = "".join(t.text or "" for t in c.iter() if _local(t.tag) == "t")
                    else:
                        value = next((v.text for v in c if _local(v.tag) == "v"), None)
                        if kind == "s" and value is not None:
                            value = self.texts[int(value)]
                        elif kind == "b" and value is not None:
                            value = "true" if value == "1" else "false"
                        elif kind == "e":
                            value = None
                    if value is not None and value != "":
                        cells[at] = value
                if cells:
                    yield number, cells

    def last_row(self) -> int | None:
        """From the sheet's own dimension, which stands before its rows; None where there is none."""
        with self.zip.open(self.name) as f:
            head = f.read(1 << 16)
        m = re.search(rb'<(?:\w+:)?dimension ref="[A-Z]+\d+:[A-Z]+(\d+)"', head)
        return int(m.group(1)) if m else None


class _Range(InputPartition):
    def __init__(self, first: int, end: int | None):
        self.first, self.end = first, end


class SheetSource(DataSource):
    """A sheet with a row of names. Options: path; sheet (its name or number, from 1; the first); rows (in a task); infer (rows that tell a column's type, 100).

    Columns whose first cells are all numbers are doubles, others text; a name that is missing or repeated gets its column's number. A cell of
    another type than its column is null. Rows without any cell are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def _book(self) -> Book:
        return Book(self.options["path"], self.options.get("sheet", "1"))

    def schema(self) -> StructType:
        with self._book() as book:
            rows = []
            for _, cells in book.rows():
                rows.append(cells)
                if len(rows) > int(self.options.get("infer", 100)):
                    break
        if not rows:
            raise ValueError("the sheet has no row of names")
        width = max(max(r) for r in rows) + 1
        fields, seen = [], set()
        for i in range(width):
            name = rows[0].get(i) or f"_{i}"
            name = f"{name}_{i}" if name in seen else name
            seen.add(name)
            values = [r[i] for r in rows[1:] if i in r and r[i].strip() not in _MISSING]
            fields.append(StructField(name, DoubleType() if values and all(_is_number(v) for v in values) else StringType()))
        return StructType(fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        return SheetReader(dict(self.options), schema)


def _is_number(x: str) -> bool:
    try:
        float(x)
    except ValueError:
        return False
    return True


class SheetReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.options, self.numbers = options, [isinstance(f.dataType, DoubleType) for f in schema]

    def partitions(self) -> list[InputPartition]:
        step = int(self.options.get("rows", ROWS_PER_TASK))
        with Book(self.options["path"], self.options.get("sheet", "1")) as book:
            last = book.last_row()
        starts = list(range(1, max(last or 1, 1) + 1, step))
        return [_Range(a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)]  # the last one goes on, whatever the dimension says

    def read(self, partition: _Range) -> Iterator[tuple]:
        with Book(self.options["path"], self.options.get("sheet", "1")) as book:
            names = next((number for number, _ in book.rows()), 1)
            for number, cells in book.rows(max(partition.first, names + 1), partition.end):
                yield tuple((float(v) if _is_number(v) else None) if n and v is not None else v for n, v in zip(self.numbers, (cells.get(i) for i in range(len(self.numbers))), strict=True))


# --- series matrices -----------------------------------------------------------------------------------------------


class SeriesMatrixSource(DataSource):
    """A series-matrix text, compressed or not. Options: path; part (``table``, the default: probe and a double for each sample; ``samples``: sample, position, attribute and value of the
    !Sample_ lines); bytes (of a plain file in a task; a compressed one is one task's)."""

    @classmethod
    def name(cls) -> str:
        return "series_matrix"

    def schema(self) -> StructType:
        if self.options.get("part", "table") == "samples":
            return StructType([StructField("sample", StringType()), StructField("position", IntegerType()), StructField("attribute", StringType()), StructField("value", StringType())])
        _, samples = _header(self.options["path"])
        return StructType([StructField("probe", StringType()), *[StructField(s, DoubleType()) for s in samples]])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SeriesMatrixReader(dict(self.options), len(schema) - 1)


def _unquoted(x: str) -> str:
    return x.strip().strip('"')


def _lines(path: str) -> Iterator[str]:
    with _open(path) as raw:
        stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        yield from io.TextIOWrapper(io.BufferedReader(stream) if not isinstance(stream, io.BufferedIOBase) else stream, "utf-8", errors="replace")


def _header(path: str) -> tuple[list[list[str]], list[str]]:
    """The cells of the !Sample_ lines and the samples of the table; reading stops at the table's first line."""
    about = []
    for line in _lines(path):
        if line.startswith("!Sample_"):
            about.append([_unquoted(x) for x in line.rstrip("\r\n").split("\t")])
        if line.lstrip('"').startswith("ID_REF"):
            return about, [_unquoted(x) for x in line.rstrip("\r\n").split("\t")[1:]]
    raise ValueError("no table in the series matrix")


class SeriesMatrixReader(DataSourceReader):
    def __init__(self, options: dict, width: int):
        self.options, self.width = options, width

    def partitions(self) -> list[InputPartition]:
        path = self.options["path"]
        if self.options.get("part", "table") == "samples" or path.endswith(".gz"):
            return [_Range(0, None)]
        with _open(path) as f:
            size = f.seek(0, 2) or f.tell()
        step = int(self.options.get("bytes", BYTES_PER_TASK))
        return [_Range(a, min(a + step, size)) for a in range(0, max(size, 1), step)]

    def _rows(self, part: _Range) -> Iterator[str]:
        """Lines that begin in a range of bytes."""
        path = self.options["path"]
        if part.end is None:
            yield from _lines(path)
            return
        with _open(path) as f:
            f.seek(max(part.first - 1, 0))
            if part.first:
                f.readline()  # the line that began before, or the rest of the byte before
            while f.tell() < part.end and (line := f.readline()):
                yield line.decode("utf-8", "replace")

    def read(self, partition: _Range) -> Iterator[tuple]:
        if self.options.get("part", "table") == "samples":
            about, samples = _header(self.options["path"])
            for cells in about:
                for i, (s, v) in enumerate(zip(samples, cells[1:])):
                    yield s, i, cells[0].removeprefix("!Sample_"), v
            return
        for line in self._rows(partition):
            line = line.rstrip("\r\n")
            if not line.strip() or line.startswith("!") or line.lstrip('"').startswith("ID_REF"):
                continue
            cells = line.split("\t")
            yield (_unquoted(cells[0]), *[_number(_unquoted(c)) for c in cells[1 : self.width + 1]], *[None] * (self.width + 1 - len(cells)))
