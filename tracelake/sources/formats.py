"""Evidence as Spark data sources: ``spark.read.format("eve" | "cef" | "flow_csv").load(path)``.

Files are read by byte ranges. A range has the lines that begin in it; ``seq`` is where a line begins, so it rises with
the position in a file and tells its lines apart.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructType

from tracelake.functions.scalars import snake_case
from tracelake.sources.pcap import CaptureSource
from tracelake.sources.streams import open_file, paths_of

#: Bytes of a range, and of a read within it.
RANGE, PIECE = 64 << 20, 1 << 20


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int


def lines_of(part: FileRange) -> Iterator[tuple[int, bytes]]:
    """Place and bytes, without their end, of the lines that begin in a range."""
    with open_file(part.path) as source:
        # a line that ends just before the range belongs to the one before
        at = max(part.start - 1, 0)
        source.seek(at)
        held, skip = b"", part.start > 0
        while True:
            piece = source.read(PIECE)
            held += piece
            *whole, rest = held.split(b"\n")
            if not piece and rest:
                whole, rest = [*whole, rest], b""
            for line in whole:
                if not skip:
                    if at >= part.end:
                        return
                    yield at, line.removesuffix(b"\r")
                skip, at = False, at + len(line) + 1
            held = rest
            if not piece or (not skip and at >= part.end):
                return


class _Reader(DataSourceReader):
    """Rows of (path, seq, *what ``parsed`` makes of a line) for the lines for which it makes anything."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.bytes, self.names = options["path"], int(options.get("rangebytes", RANGE)), schema.names

    def partitions(self) -> list[FileRange]:
        found = [FileRange(path, low, min(low + self.bytes, size)) for path, size in paths_of(self.path) for low in range(0, size, self.bytes)]
        if not found and not paths_of(self.path):
            raise FileNotFoundError(f"no file in {self.path}")
        return found

    def parser(self, path: str):  # noqa: ANN201
        """What makes values of a line of a file, or None of one that is no record."""
        return lambda at, text: (text,) if text.strip() else None

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        parsed, rows, size = self.parser(partition.path), [], 0
        for at, line in lines_of(partition):
            text = line.decode("utf-8", "replace")
            values = parsed(at, text.removeprefix("﻿") if at == 0 else text)
            if values is not None:
                rows.append((partition.path, at, *values))
                size += len(line)
            if size > PIECE:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64()] + [pa.string()] * (len(self.names) - 2)
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=self.names)


class _CsvReader(_Reader):
    def parser(self, path: str):  # noqa: ANN201
        own = header_of(path)
        places = [own.index(n) if n in own else None for n in self.names[2:]]

        def parsed(at: int, text: str) -> tuple | None:
            if at == 0 or not text.strip():
                return None
            values = next(csv.reader([text]))
            return tuple(values[p] if p is not None and p < len(values) and values[p] != "" else None for p in places)

        return parsed


def header_of(path: str) -> list[str]:
    """Names in a CSV's first line, in snake case."""
    first = next(iter(lines_of(FileRange(path, 0, 1))), (0, b""))[1].decode("utf-8", "replace").removeprefix("﻿")
    return [snake_case(n) for n in next(csv.reader(io.StringIO(first)), [])]


class _Lines(DataSource):
    column = "line"

    def schema(self) -> StructType:
        return StructType().add("path", StringType()).add("seq", LongType()).add(self.column, StringType())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()}, schema)


class EveSource(_Lines):
    """``eve``: path, seq and ``raw``, the JSON text of each line that is not blank."""

    column = "raw"

    @classmethod
    def name(cls) -> str:
        return "eve"


class CefSource(_Lines):
    """``cef``: path, seq and ``raw_line``, each line that is not blank."""

    column = "raw_line"

    @classmethod
    def name(cls) -> str:
        return "cef"


class FlowCsvSource(DataSource):
    """``flow_csv``: path, seq and the columns of all headers, as text; a file that lacks a column has nulls there."""

    @classmethod
    def name(cls) -> str:
        return "flow_csv"

    def schema(self) -> StructType:
        names = {n: None for path, _ in paths_of(self.options["path"]) for n in header_of(path)}
        out = StructType().add("path", StringType()).add("seq", LongType())
        for n in names:
            out = out.add(n, StringType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CsvReader({k.lower(): v for k, v in self.options.items()}, schema)


def register(spark: SparkSession) -> None:
    """Makes ``eve``, ``cef``, ``flow_csv`` and ``capture`` known to the session's readers."""
    for source in (EveSource, CefSource, FlowCsvSource, CaptureSource):
        spark.dataSource.register(source)
