"""Python over Arrow batches, a few rows at a time; integers with nulls stay integers."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Columns = dict[str, list]


def arrow_schema(schema: str | StructType) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(schema) if isinstance(schema, str) else schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int, most_bytes: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows and about ``most_bytes`` bytes (one row at least)."""
    for batch in batches:
        each = max(1, batch.nbytes // max(1, batch.num_rows))
        step = max(1, min(rows, most_bytes // each))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def small_batches(spark: SparkSession, most_bytes: int = 1 << 22) -> None:
    """Bound the session's Arrow batches, unless it has a lower bound.

    The JVM and Python both hold a batch, and Spark's own bound of 64 MB makes that a large part of an executor of several
    cores that also joins and sorts.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.match(r"-?\d+", spark.conf.get(key))[0]) not in range(1, most_bytes + 1):
        spark.conf.set(key, str(most_bytes))


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow``, after whose tasks a worker hands free memory back."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _hand_back()

    return df.mapInArrow(whole, schema)


def _hand_back() -> None:
    """Free memory goes back to the system: Python workers live on between stages, and their neighbours need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_columns(df: DataFrame, make: Callable[[], Callable[[Columns], Columns]], schema: str, rows: int = 256) -> DataFrame:
    """Rows by a function of columns (name -> list). ``make`` is called once in each task and gives that function."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for piece in slices(batches, rows):
            yield pa.RecordBatch.from_pydict(f(piece.to_pydict()), schema=out)

    return map_batches(df, run, schema)


def map_text(df: DataFrame, make: Callable[[], Callable[[list], list]], text_col: str, chars_col: str = "n_chars", rows: int = 256) -> DataFrame:
    """``df`` with new texts; every other column and row stays, but for ``chars_col``, which follows a changed text."""
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for piece in slices(batches, rows):
            at = piece.schema.get_field_index(text_col)
            old = piece.column(at).to_pylist()
            new = f(old)
            piece = piece.set_column(at, piece.schema.field(at), pa.array(new, piece.schema.field(at).type))
            if (n := piece.schema.get_field_index(chars_col)) >= 0:
                sizes = [len(b) if a != b and b is not None else x for a, b, x in zip(old, new, piece.column(n).to_pylist(), strict=True)]
                piece = piece.set_column(n, piece.schema.field(n), pa.array(sizes, piece.schema.field(n).type))
            yield piece

    return map_batches(df, run, schema)
