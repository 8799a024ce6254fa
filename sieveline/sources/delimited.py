"""Delimited text in byte ranges that many tasks read, though quoted fields may hold line feeds.

Whether a line feed ends a record depends on all quotes before it.  A first pass reads every range and says, for both cases of
its beginning (within a quoted field or not), how it ends and how many records end in it; a scan over these few numbers fixes each
range's beginning and the number of its first record.  A second pass, a partitioned data source, parses in each range the records
that begin there, with their numbers.

The rules are those of common readers: a quote opens a field only at its beginning, a doubled quote within is a quote, what
follows a closing quote belongs to the field, blank lines are no records, lines end with LF, CR LF or CR.  Empty cells are null, quoted or not.  A row
that is too short is filled with nulls, what is too much is dropped; text is UTF-8, other bytes become replacement characters.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

QUOTE, LF, CR = 34, 10, 13
BOM = b"\xef\xbb\xbf"
RANGE = 32 << 20  # bytes of a range; a task holds one in memory
MORE = 1 << 20  # read beyond a range at once, until its last record ends
INDEX = "__row_index__"


class File:
    """Byte ranges of a file that all executors reach."""

    def __init__(self, path: str):
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(path) if re.match(r"\w+://?", path) else (fs.LocalFileSystem(), path)
        self.source, self.size = store.open_input_file(name), store.get_file_info(name).size
        self.origin = len(BOM) if self.read(0, len(BOM)) == BOM else 0

    def read(self, low: int, high: int) -> bytes:
        high = min(high, self.size)
        if low >= high:
            return b""
        self.source.seek(low)
        return self.source.read(high - low)


class Marks:
    """What can end records in the bytes from low to high: quotes that change the state, and line ends."""

    def __init__(self, file: File, low: int, high: int, sep: int):
        high = min(high, file.size)
        begin, end = max(file.origin, low - 2), high + 1
        data = file.read(begin, end)
        while data[-1:] == b'"' and end < file.size:  # a run of quotes is judged whole
            data += file.read(end, end + 65_536)
            end += 65_536
        x = np.frombuffer(data, np.uint8)
        edge = LF if begin == file.origin else 0  # stands before the first byte
        before = lambda i: np.where(i > 0, x[i - 1], edge) if len(i) else i
        quotes = np.flatnonzero(x == QUOTE)
        first = quotes[np.diff(quotes, prepend=-2) != 1]
        length = np.diff(np.append(np.searchsorted(quotes, first), len(quotes)))
        mine = (length % 2 == 1) & (first + begin >= low) & (first + begin < high)  # an even run leaves the state as it is
        first = first[mine]
        lead = before(first)
        opens = (lead == sep) | (lead == LF) | (lead == CR)
        # An odd run at a field's beginning opens or closes; elsewhere it closes if anything.
        self.at, self.turns = first + begin, np.concatenate([[0], np.cumsum(opens)])
        closing = np.where(opens, -1, np.arange(len(first)))
        self.closed = np.maximum.accumulate(np.concatenate([[-1], closing])) if len(first) else np.array([-1])
        feeds, returns = np.flatnonzero(x == LF), np.flatnonzero(x == CR)
        returns = returns[(returns + 1 == len(x)) | (x[np.minimum(returns + 1, len(x) - 1)] != LF)]  # CR LF is one end
        ends = np.sort(np.concatenate([feeds, returns])) if len(returns) else feeds
        ends = ends[(ends + begin >= low) & (ends + begin < high)]
        lead = before(ends - ((x[ends] == LF) & (before(ends) == CR)))
        self.ends, self.blank = ends + begin, (lead == LF) | (lead == CR)

    def state(self, start: int, n: np.ndarray | int):
        """1 within a quoted field, else 0, after the first n changes."""
        closed = self.closed[n]
        return np.where(closed < 0, start + self.turns[n], self.turns[n] - self.turns[closed + 1]) % 2

    def last(self, start: int) -> int:
        return int(self.state(start, len(self.at)))

    def records(self, start: int) -> tuple[np.ndarray, np.ndarray]:
        """Where records end, and which of these are blank lines."""
        outside = self.state(start, np.searchsorted(self.at, self.ends)) == 0
        return self.ends[outside], self.blank[outside]


def ranges(size: int, each: int) -> list[tuple[int, int]]:
    return [(low, min(low + each, size)) for low in range(0, size, each)]


def plan(spark: SparkSession, paths: list[str], sep: str, each: int) -> list[tuple[int, int, int, int, int, int]]:
    """(low, high, state at low, records that end before low, file, rows of the files before) of all ranges: a row of numbers for each,
    the rest stays in tasks."""
    files = [File(path) for path in paths]
    parts = [(f, low, high) for f, file in enumerate(files) for low, high in ranges(file.size, each)]
    if not parts:
        return []

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                f, low, _ = parts[k]
                marks = Marks(File(paths[f]), low, low + each, ord(sep))
                row = [k]
                for start in (0, 1):
                    row += [marks.last(start), int((~marks.records(start)[1]).sum())]
                yield pa.RecordBatch.from_pydict({n: pa.array([v], pa.int64()) for n, v in zip(("k", "end0", "n0", "end1", "n1"), row, strict=True)})

    found = spark.range(0, len(parts), 1, len(parts)).mapInArrow(scan, "k long, end0 long, n0 long, end1 long, n1 long").collect()
    out, rows = [], 0
    for (f, low, high), r in zip(parts, sorted(found), strict=True):
        if low == 0:
            state, before = 0, 0
        out.append((low, high, state, before, f, rows))
        state, before = (r["end1"], before + r["n1"]) if state else (r["end0"], before + r["n0"])
        if high == files[f].size:  # the header is no row, a last record without an end is one
            rows += max(before + (state == 1 or files[f].read(high - 1, high) not in (b"\n", b"\r")) - 1, 0)
    return out


def block(file: File, low: int, high: int, state: int, before: int, sep: int) -> tuple[bytes, int]:
    """The bytes of the records that begin from low to high, and the number of the first."""
    marks = Marks(file, low, high, sep)
    ends, blank = marks.records(state)
    lead = file.read(max(low - 1, 0), low + 1)
    if low <= file.origin:
        first = file.origin
    elif not state and (lead[:1] == b"\n" or (lead[:1] == b"\r" and lead[1:] != b"\n")):
        first = low
    elif len(ends):
        first, before, ends = int(ends[0]) + 1, before + (not blank[0]), ends[1:]
    else:
        return b"", before
    if first >= high:
        return b"", before
    if len(ends) and ends[-1] == high - 1:
        return file.read(first, high), before
    data, state = [file.read(first, high)], marks.last(state)
    while high < file.size:  # the last record goes on
        marks = Marks(file, high, high + MORE, sep)
        found, _ = marks.records(state)
        upto = int(found[0]) + 1 if len(found) else high + MORE
        data.append(file.read(high, upto))
        if len(found):
            break
        high, state = high + MORE, marks.last(state)
    return b"".join(data), before


class Range(InputPartition):
    def __init__(self, low: int, high: int, state: int, before: int, path: str | None = None, rows: int = 0):
        self.low, self.high, self.state, self.before, self.path, self.rows = low, high, state, before, path, rows


class RangeReader(DataSourceReader):
    def __init__(self, path: str | list[str], sep: str, parts: list, names: list[str]):
        self.paths, self.sep, self.parts, self.names = [path] if isinstance(path, str) else path, sep, parts, names

    def partitions(self) -> list[Range]:
        return [Range(*p[:4], self.paths[p[4]], p[5]) for p in self.parts]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(1 << 30)
        data, number = block(File(partition.path or self.paths[0]), partition.low, partition.high, partition.state, partition.before, ord(self.sep))
        text = io.TextIOWrapper(io.BytesIO(data), encoding="utf-8", errors="replace", newline="")
        del data
        width, rows, at = len(self.names), [], number
        for row in csv.reader(text, delimiter=self.sep):
            if not row:
                continue
            if at:  # record 0 is the header
                rows.append(row if len(row) == width else (row + [None] * width)[:width])
            at += 1
            if len(rows) == 4096:
                yield self.batch(rows, at + partition.rows)
                rows = []
        if rows:
            yield self.batch(rows, at + partition.rows)

    def batch(self, rows: list, at: int) -> pa.RecordBatch:
        columns = [pa.array([x or None for x in c], pa.string()) for c in zip(*rows, strict=True)] + [pa.array(np.arange(at - 1 - len(rows), at - 1))]
        return pa.RecordBatch.from_arrays(columns, names=[*self.names, INDEX])


class Delimited(DataSource):
    """Options: sep, and files, ranges and columns (JSON), as ``read`` sets them."""

    @classmethod
    def name(cls) -> str:
        return "sieveline_delimited"

    def schema(self) -> str:
        return ", ".join(f"`{c.replace('`', '``')}` string" for c in json.loads(self.options["columns"])) + f", {INDEX} long"

    def reader(self, schema) -> RangeReader:
        return RangeReader(json.loads(self.options["files"]), self.options["sep"], json.loads(self.options["ranges"]), json.loads(self.options["columns"]))


def read(spark: SparkSession, path: str | list[str], sep: str, columns: list[str], each: int = RANGE) -> DataFrame:
    """The records after the header, as strings under the names given, with their numbers from 0; several files, each with a header,
    are read as one, in their order."""
    paths = [path] if isinstance(path, str) else path
    parts = plan(spark, paths, sep, each)
    spark.dataSource.register(Delimited)
    return spark.read.format(Delimited.name()).option("sep", sep).option("ranges", json.dumps(parts)).option("columns", json.dumps(columns)).option("files", json.dumps(paths)).load()


def opens(path: str) -> bool:
    """Whether byte ranges of the file can be read; where only Spark's own readers reach it they cannot."""
    try:
        File(path)
    except Exception:
        return False
    return True
