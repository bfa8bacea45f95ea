"""Logs of JSON lines as a data source of Spark: planned byte ranges, pushed filters, a stream with offsets.

Files lie in a folder that all machines mount, in partitions ``key=value`` if wanted, as Spark's own writers lay them out. A
large file is cut into ranges of ``chunk`` bytes; a range owns the lines that begin in it. If asked for, filters are pushed: those on
partition keys choose files while the scan is planned, those on numbers and texts are applied to parsed lines before rows
are made, and by Spark again. Spark 4.1 keeps one reader for all scans of a DataFrame, so pushing is safe only where a plan
scans it once (``read`` sees to plans that follow each other); that is why it has to be asked for.

As a stream, the offset is a place in the sequence of all lines: a file and a byte in it. Files must be added in the order
of their paths, and only the last may grow; a line without its end yet is left for later. The checkpoint of a query
replaces a table of progress: what was read stays read over restarts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

CHUNK, ROWS, BAD, PLACE = 16 << 20, 2048, "_bad", "_range"
_KINDS = {StringType: str, LongType: int, IntegerType: int, DoubleType: (float, int), BooleanType: bool}


def files(path: str) -> list[tuple[str, int]]:
    """(path below the folder, bytes) of each file, in order; hidden ones and markers are left out."""
    found = []
    for d, below, names in os.walk(path):
        below[:] = [x for x in below if x[0] not in "._"]
        found += [(os.path.relpath(os.path.join(d, n), path), os.path.getsize(os.path.join(d, n))) for n in names if n[0] not in "._"]
    return sorted(found)


def keys(name: str) -> dict[str, str]:
    return dict(p.split("=", 1) for p in os.path.dirname(name).split(os.sep) if "=" in p)


@dataclass
class Range(InputPartition):
    """Lines of a file that begin at ``at`` or after, and before ``end``."""

    name: str
    at: int
    end: int


def ranges(name: str, at: int, end: int, chunk: int) -> list[Range]:
    return [Range(name, k, min(k + chunk, end)) for k in range(at, end, chunk)]


def lines(path: str, part: Range) -> Iterator[bytes]:
    with open(os.path.join(path, part.name), "rb") as f:
        if part.at:
            f.seek(part.at - 1)
            f.readline()  # ends the line that began before
        while f.tell() < part.end and (line := f.readline()):
            yield line


def _passes(f: Filter, value: object) -> bool:
    """Whether a value meets a filter, as in SQL: a null meets none. Values of another kind are left to Spark."""
    if value is None:
        return False
    if isinstance(f, IsNotNull):
        return True
    try:
        if isinstance(f, EqualTo):
            return value == f.value
        if isinstance(f, In):
            return value in f.value
        if isinstance(f, GreaterThan):
            return value > f.value
        if isinstance(f, GreaterThanOrEqual):
            return value >= f.value
        if isinstance(f, LessThan):
            return value < f.value
        return value <= f.value
    except TypeError:
        return True


_KNOWN = (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNotNull)


class _Lines:
    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        if any(type(f.dataType) not in _KINDS for f in schema):
            raise ValueError("columns must be texts, whole numbers, doubles or booleans")
        self.columns, self.path, self.chunk = schema, options["path"].removeprefix("file://"), int(options.get("chunk", CHUNK))
        self.push, self.filters = options.get("push", "false"), []

    def _typed(self, name: str, kind: type, value: object) -> object:
        """A partition key's text as the column's type."""
        if value is None or value == "__HIVE_DEFAULT_PARTITION__":
            return None
        return value == "true" if kind is BooleanType else value if kind is StringType else (float if kind is DoubleType else int)(value)

    def _held(self, name: str) -> dict[str, object]:
        own = keys(name)
        return {f.name: self._typed(f.name, type(f.dataType), own[f.name]) for f in self.columns if f.name in own}

    def _parsed(self, line: bytes, held: dict[str, object]) -> dict[str, object] | None:
        """The row of a line, or none where it is no object or a value is of another kind than its column."""
        try:
            row = json.loads(line)
        except ValueError:
            return None
        if not isinstance(row, dict):
            return None
        out = {}
        for f in self.columns:
            v = held[f.name] if f.name in held else row.get(f.name)
            kind = type(f.dataType)
            if v is not None and (not isinstance(v, _KINDS[kind]) or kind is not BooleanType and isinstance(v, bool)):
                return None
            out[f.name] = float(v) if kind is DoubleType and v is not None else v
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        schema, held, rows = to_arrow_schema(self.columns), self._held(part.name) | {PLACE: part.at}, []
        tells = BAD in self.columns.names
        for line in lines(self.path, part):
            if not line.strip():
                continue
            row = self._parsed(line, held)
            if row is None:
                if not tells:
                    continue
                # What can't be read is told in a column of its own, if there is one.
                row = {f.name: held.get(f.name) for f in self.columns} | {BAD: line.decode("utf-8", "replace").rstrip("\r\n")}
            elif not all(_passes(f, row[f.attribute[0]]) for f in self.filters):
                continue
            rows.append(row)
            if len(rows) == ROWS:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class LineReader(_Lines, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        if self.push != "true":
            yield from filters
            return
        names = {k for name, _ in files(self.path)[:1] for k in keys(name)}
        self.files_by: list[Filter] = []
        for f in filters:
            known = isinstance(f, _KNOWN) and len(f.attribute) == 1
            if known and f.attribute[0] in names:
                self.files_by.append(f)  # every file meets it or not: Spark need not look again
                continue
            # Bad lines have no values, so with a column for them nothing is dropped here.
            if known and BAD not in self.columns.names:
                self.filters.append(f)
            yield f

    def partitions(self) -> list[Range]:
        by = getattr(self, "files_by", [])
        kept = [(n, size) for n, size in files(self.path) if all(_passes(f, self._held(n).get(f.attribute[0])) for f in by)]
        return [r for n, size in kept for r in ranges(n, 0, size, self.chunk)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.name else iter(())


class LineStream(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"file": "", "at": 0}

    def latestOffset(self) -> dict:
        found = files(self.path)
        return {"file": found[-1][0], "at": self._complete(*found[-1])} if found else self.initialOffset()

    def _complete(self, name: str, size: int) -> int:
        """The byte after the last whole line."""
        with open(os.path.join(self.path, name), "rb") as f:
            at = size
            while at > 0:
                begin = max(0, at - 65536)
                f.seek(begin)
                if (k := f.read(at - begin).rfind(b"\n")) >= 0:
                    return begin + k + 1
                at = begin
        return 0

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for name, size in files(self.path):
            if start["file"] <= name <= end["file"]:
                out += ranges(name, start["at"] if name == start["file"] else 0, end["at"] if name == end["file"] else size, self.chunk)
        return out

    def commit(self, end: dict) -> None:
        """Nothing to do: files stay, the query's checkpoint knows the offset."""


class LineSource(DataSource):
    """``spark.read.format("line_ranges")`` with a schema, ``path`` and, if wanted, ``chunk``."""

    @classmethod
    def name(cls) -> str:
        return "line_ranges"

    def reader(self, schema: StructType) -> LineReader:
        return LineReader(schema, self.options)

    def streamReader(self, schema: StructType) -> LineStream:
        return LineStream(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LineSource)


def read(spark: SparkSession, path: str, schema: str, chunk: int = CHUNK, push: bool = False) -> DataFrame:
    """The lines below ``path``; a column ``_bad`` (text) in ``schema`` holds lines that can't be read, which are else left out.

    With ``push`` filters reach the source; such a DataFrame must not be scanned twice in one plan (a join with itself, a
    union of two of its parts): load it twice instead.
    """
    register(spark)
    rows = spark.read.format("line_ranges").option("path", path).option("chunk", chunk)
    if not push:
        return rows.schema(schema).load()
    # A filter that all rows meet: Spark hands on the filters of the plan before to one that has none.
    return rows.option("push", "true").schema(f"{schema}, {PLACE} long").load().filter(f"{PLACE} >= 0").drop(PLACE)


def stream(spark: SparkSession, path: str, schema: str, chunk: int = CHUNK) -> DataFrame:
    register(spark)
    return spark.readStream.format("line_ranges").schema(schema).option("path", path).option("chunk", chunk).load()
