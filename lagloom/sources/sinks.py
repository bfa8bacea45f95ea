"""Writers: full and partial refresh, appends, small reports."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from lagloom.sources import buckets
from lagloom.sources.shared import discard, keep


def full_refresh(df: DataFrame, path: str) -> None:
    """Replace the whole table. ``df`` must not read ``path``."""
    df.write.mode("overwrite").parquet(path)


def partition_refresh(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def ranked_csv(cells: DataFrame, path: str) -> None:
    """Scan results, the largest |r| first, in one file (a grid of cells is small)."""
    cells.orderBy("abs_corr", ascending=False).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def views(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def markdown_table(df: DataFrame) -> str:
    """All rows as a table, fetched a partition at a time; meant for results of a size that is read."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in df.toLocalIterator()]
    return "\n".join(lines)


def audit_report(summary: DataFrame, convergence: DataFrame, path: str) -> None:
    """The audit's small tables as Markdown on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# Audit\n\n{markdown_table(summary)}\n\n## Repeated hypotheses\n\n{markdown_table(convergence)}\n")


def chart_data(frames: dict[str, DataFrame], path: str) -> None:
    """The datasets behind a report's charts as one JSON file: every row, written as it comes, a partition at a time."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("{")
        for i, (name, df) in enumerate(frames.items()):
            f.write(f"{', ' * (i > 0)}{json.dumps(name)}: [")
            for k, r in enumerate(df.toLocalIterator()):
                f.write(", " * (k > 0) + json.dumps(r.asDict(recursive=True), default=str, ensure_ascii=False))
            f.write("]")
        f.write("}")


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as one JSON object, for logs of lines and message queues."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def laid_out(df: DataFrame, path: str, by: list[str], within: list[str]) -> None:
    """A table partitioned by ``by`` and sorted ``within`` files, so that filters on either skip files and row groups.

    A partition's rows are dealt over several tasks by the sort columns: a hot partition is no single task's work.
    """
    dealt = df.repartitionByRange(*by, *within).sortWithinPartitions(*by, *within)
    dealt.write.mode("overwrite").partitionBy(*by).parquet(path)


def upsert_chunks(spark: SparkSession, path: str, chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None) -> list[int]:
    """Chunks (id, document, ...) into a table by id: new ones replace old ones of their id; gives the buckets rewritten.

    ``embed`` gives vectors for texts (any model behind a function; it runs in the tasks, a batch at a time, once a chunk);
    without it ``chunks`` brings its own column ``embedding``. The table lies in hash buckets of the id (``buckets``, which
    also reads it), of which only those that new chunks fall into are rewritten.
    """
    new = keep(embedded(chunks, embed), "embedded") if embed else chunks
    hit = buckets.upsert(spark, path, new, ["id"], [F.xxhash64("document")])
    if embed:
        discard(new)
    return hit


def embedded(chunks: DataFrame, embed: Callable[[list[str]], list[list[float]]], rows: int = 256) -> DataFrame:
    """``chunks`` with ``embedding`` of their ``document`` by a model behind a function."""
    schema = StructType([*chunks.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                vectors = embed(piece.column(piece.schema.get_field_index("document")).to_pylist())
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(vectors, out.field("embedding").type)], schema=out)

    return chunks.mapInArrow(run, schema)


def _letters(k: int) -> str:
    return chr(65 + k) if k < 26 else _letters(k // 26 - 1) + chr(65 + k % 26)


def spreadsheet(sheets: dict[str, list[list]], shared_strings: bool = True) -> bytes:
    """An Office Open XML file of sheets (name -> rows of numbers, texts and None), by the standard library."""
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    strings: dict[str, int] = {}

    def cell(row: int, k: int, v: object) -> str:
        at = f'r="{_letters(k)}{row + 1}"'
        if isinstance(v, (int, float)):
            return f"<c {at}><v>{v!r}</v></c>"
        if not shared_strings:
            return f'<c {at} t="inlineStr"><is><t>{escape(str(v))}</t></is></c>'
        return f'<c {at} t="s"><v>{strings.setdefault(str(v), len(strings))}</v></c>'

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        names = "".join(f'<sheet name={quoteattr(n)} sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        for i, rows in enumerate(sheets.values()):
            data = "".join(f'<row r="{n + 1}">{"".join(cell(n, k, v) for k, v in enumerate(row) if v is not None)}</row>' for n, row in enumerate(rows) if any(v is not None for v in row))
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", f'<worksheet xmlns="{main}"><sheetData>{data}</sheetData></worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">{"".join(f"<si><t>{escape(x)}</t></si>" for x in strings)}</sst>')
    return out.getvalue()


def archive(files: dict[str, bytes]) -> bytes:
    """A zip file of files."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(name, content)
    return out.getvalue()
