"""Readers for heterogeneous files, each giving a small long table.

Formats that Spark reads itself (CSV, JSON lines, Parquet, JDBC) go through its readers. Archives, spreadsheets and
PDF pages are read as binary files and parsed in the tasks, a file at a time; parsers of packages that are not
installed raise when they are used, not when this module is imported.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import functools
import io
import math
import re
import sqlite3
import zipfile
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom import schemas
from lagloom.functions import fixed
from lagloom.functions.text import chunks, local_number, percent_number
from lagloom.operators.tables import first_by_key


def binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def per_file(files: DataFrame, parse: Callable[[str, bytes], pd.DataFrame], schema: str) -> DataFrame:
    """Rows of each file by ``parse(path, content)``, in the tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                yield parse(path, content)

    return files.select("path", "content").mapInPandas(run, schema)


_INDEX = "ticker string, trade_date date, close double, open double, high double, low double, value double, volume double, currency string"


def zip_indices(spark: SparkSession, path: str) -> DataFrame:
    """Daily index files: a zipped cp1251 CSV whose header line begins with BOARDID, ';' between fields, decimal commas.

    The ticker is the file's name up to its first '_' or '.'; rows without a close drop; missing prices are null.
    """
    names = {"TRADEDATE": "trade_date", "CLOSE": "close", "OPEN": "open", "HIGH": "high", "LOW": "low", "VALUE": "value", "VOLUME": "volume", "CURRENCYID": "currency"}
    order = ["ticker", *names.values()]

    def parse(file: str, content: bytes) -> pd.DataFrame:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            lines = z.read(z.namelist()[0]).decode("cp1251").splitlines()
        at = next((i for i, x in enumerate(lines) if x.startswith("BOARDID")), None)
        if at is None:
            return pd.DataFrame({c: [] for c in order})
        t = pd.read_csv(io.StringIO("\n".join(lines[at:])), sep=";", decimal=",", float_precision="round_trip").rename(columns=names)
        t["ticker"] = re.split(r"[_.]", file.rsplit("/", 1)[-1])[0]
        t["trade_date"] = pd.to_datetime(t["trade_date"], dayfirst=True, errors="coerce").dt.date
        for c in order:
            t[c] = t[c] if c in t else None
        for c in order[2:-1]:
            t[c] = pd.to_numeric(t[c], errors="coerce")
        return t.dropna(subset=["close", "trade_date"])[order]

    return per_file(binary(spark, path, "*.zip"), parse, _INDEX).select(*[f.name for f in schemas.INDICES])


def local_quotes(spark: SparkSession, path: str, files: dict[str, str] | None = None) -> DataFrame:
    """Quote files with local numbers ('1.234,5') and day-first dates; the file's name gives the instrument.

    In the last column, a percentage, a dot is no thousands mark ('0,5%' and '0.5%' are one half).
    """
    rows = spark.read.option("header", "true").option("encoding", "utf-8").csv(path).withColumn("_file", F.url_decode(F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1)))
    names = rows.columns
    pairs = [x for k, v in (files or fixed.INSTRUMENT_FILES).items() for x in (F.lit(k), F.lit(v))]
    num = lambda i: local_number(F.col(f"`{names[i]}`"))
    out = rows.select(
        F.try_to_timestamp(F.col(f"`{names[0]}`"), F.lit("dd.MM.yyyy")).cast("date").alias("trade_date"),
        F.try_element_at(F.create_map(*pairs), F.col("_file")).alias("instrument"),
        num(1).alias("close"), num(2).alias("open"), num(3).alias("high"), num(4).alias("low"), percent_number(F.col(f"`{names[-2]}`")).alias("change_pct"),
    )
    return out.dropna(subset=["trade_date", "instrument", "close"])


def _cell(text: str, kind: str, strings: list[str]) -> object:
    if kind == "s":
        return strings[int(text)]
    if kind in ("str", "inlineStr", "e"):
        return text
    if kind == "b":
        return text == "1"
    number = float(text)
    return int(number) if number.is_integer() and "." not in text else number


def _xlsx(content: bytes) -> dict[str, list[list]]:
    """The sheets of an Office Open XML file, by the standard library: rows of cells, None where a cell is empty."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        strings = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        targets = {r.get("Id"): r.get("Target", "").removeprefix("/xl/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = {}
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{main}sheet"):
            rows: list[list] = []
            for row in ElementTree.fromstring(z.read(f"xl/{targets[sheet.get(rel)]}")).iter(f"{main}row"):
                at = int(row.get("r", len(rows) + 1)) - 1
                rows.extend([] for _ in range(at + 1 - len(rows)))
                for cell in row.iter(f"{main}c"):
                    letters = re.match(r"[A-Z]*", cell.get("r", ""))[0]
                    column = functools.reduce(lambda n, x: 26 * n + ord(x) - 64, letters, 0) - 1 if letters else len(rows[at])
                    rows[at].extend([None] * (column + 1 - len(rows[at])))
                    value = cell.find(f"{main}v")
                    inline = "".join(t.text or "" for t in cell.iter(f"{main}t"))
                    if value is not None and value.text is not None:
                        rows[at][column] = _cell(value.text, cell.get("t", "n"), strings)
                    elif inline:
                        rows[at][column] = inline
            out[sheet.get("name")] = rows
        return out


def sheets(content: bytes) -> dict[str, list[list]]:
    """All sheets of a spreadsheet as rows of cells. Files of the older binary format need pandas' engine for them."""
    if content[:2] == b"PK":
        return _xlsx(content)
    read = pd.read_excel(io.BytesIO(content), sheet_name=None, header=None)
    return {str(name): [[None if pd.isna(x) else x for x in row] for row in t.itertuples(index=False)] for name, t in read.items()}


def number(cell: object) -> float | None:
    """A cell as a number: blanks and no-break spaces go, a comma is a point; null for '-', blanks and text."""
    if cell is None or isinstance(cell, bool):
        return None
    plain = re.sub(r"\s", "", str(cell)).replace(",", ".")
    try:
        out = float(plain)
    except ValueError:
        return None
    return out if math.isfinite(out) else None


def day(cell: object) -> dt.date | None:
    """A cell as a date: a date, days since 1899-12-30, or text of the forms dd.mm.yyyy and yyyy-mm-dd."""
    if isinstance(cell, dt.datetime):
        return cell.date()
    if isinstance(cell, dt.date):
        return cell
    if isinstance(cell, (int, float)) and not isinstance(cell, bool):
        return dt.date(1899, 12, 30) + dt.timedelta(days=int(cell)) if 0 < cell < 200_000 else None
    for form in ("%d.%m.%Y", "%Y-%m-%d"):
        try:
            return dt.datetime.strptime(str(cell or "").strip()[:10], form).date()
        except ValueError:
            continue
    return None


def _at(row: list, k: int) -> object:
    return row[k] if k < len(row) else None


def excel(spark: SparkSession, path: str, schema: str, rows_of: Callable[[str, dict[str, list[list]]], list[tuple]], glob: str = "*.xls*") -> DataFrame:
    """Spreadsheets, a file a task: ``rows_of(file name, sheets)`` gives the rows. A file that is none raises."""

    def parse(file: str, content: bytes) -> pd.DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        return pd.DataFrame(rows_of(unquote(file.rsplit("/", 1)[-1]), sheets(content)), columns=names)

    return per_file(binary(spark, path, glob), parse, schema)


def exchange_rates(spark: SparkSession, path: str, names: dict[str, str] | None = None) -> DataFrame:
    """FX files (RC_F*.xlsx): under a header the columns nominal, date, rate and the currency's name, by position.

    Rows without a rate or a date drop; names become ISO codes by ``names``, unknown ones stay; of several rows of a
    day and currency one stays.
    """
    codes = fixed.CURRENCIES if names is None else names

    def rows(_: str, own: dict[str, list[list]]) -> list[tuple]:
        out = []
        for row in next(iter(own.values()), [])[1:]:
            nominal, at, rate, name = number(_at(row, 0)), day(_at(row, 1)), number(_at(row, 2)), _at(row, 3)
            if at and rate is not None:
                out.append((at, codes.get(name, name), rate, None if nominal is None else int(nominal)))
        return out

    read = excel(spark, path, "trade_date date, currency string, rate double, nominal int", rows, "RC_F*.xlsx")
    return first_by_key(read, ["trade_date", "currency"], [F.col("rate"), F.col("nominal")])


def key_rates(spark: SparkSession, path: str, glob: str = "*.xlsx") -> DataFrame:
    """Key-rate files: under a header the columns period ('M.YYYY'), rate, inflation, days to the next meeting.

    Rows without a rate drop; days that are no number are null. A period that a sheet holds as the number 3.2026 is read
    as it is written.
    """

    def rows(_: str, own: dict[str, list[list]]) -> list[tuple]:
        out = []
        for row in next(iter(own.values()), [])[1:]:
            rate, days = number(_at(row, 1)), number(_at(row, 3))
            if rate is not None:
                out.append((None if _at(row, 0) is None else str(_at(row, 0)).strip(), rate, number(_at(row, 2)), None if days is None else int(days)))
        return out

    return excel(spark, path, "period string, rate_pct double, inflation double, days_to_meeting int", rows, glob)


_MACRO = "period string, indicator string, region string, value double, unit string, source_file string"
_MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def _macro(spark: SparkSession, path: str, glob: str, cells: Callable[[dict[str, list[list]]], Iterator[tuple]], unit: str = "RUB") -> DataFrame:
    """Macro rows of the whole country; ``cells`` yields (period, indicator, value) or (…, value, unit), nulls drop."""

    def rows(file: str, own: dict[str, list[list]]) -> list[tuple]:
        return [(period, indicator, "RF", value, *(rest or [unit]), file) for period, indicator, value, *rest in cells(own) if value is not None]

    return excel(spark, path, _MACRO, rows, glob)


def wages(spark: SparkSession, path: str, glob: str = "tab1-zpl*.xlsx") -> DataFrame:
    """Mean wages: from the 8th row on the year, then the year's mean, the year before, four quarters, twelve months.

    Periods are 'YYYY' and 'YYYY-Mon'; rows of years before 1990 drop.
    """

    def cells(own: dict[str, list[list]]) -> Iterator[tuple]:
        for row in next(iter(own.values()), [])[7:]:
            year = number(_at(row, 0))
            if year is not None and year >= 1990:
                yield str(int(year)), "avg_wage_rub", number(_at(row, 1))
                for k, month in enumerate(_MONTHS):
                    yield f"{int(year)}-{month}", "avg_wage_rub", number(_at(row, 7 + k))

    return _macro(spark, path, glob, cells)


def year_of(cell: object) -> int | None:
    """A year after 1990 in a header's cell; footnote marks after ')' are cut off ('2017)1' and '2017 1)' alike)."""
    value = number(re.split(r"\s+\d\)", str(cell))[0].split(")")[0])
    return int(value) if value is not None and value > 1990 else None


def by_year(rows: list[list], head: int) -> Iterator[tuple[str, str, float | None]]:
    """(name, year, value) of a table with years in the row ``head``; rows without a name and footnotes drop."""
    years = [year_of(c) for c in rows[head]] if head < len(rows) else []
    for row in rows[head + 1 :]:
        name = str(_at(row, 0) or "").strip()
        if name and not re.match(r"nan$|None$|1\)", name):
            for k, year in enumerate(years):
                if year is not None:
                    yield name, str(year), number(_at(row, k))


def header_row(rows: list[list], among: int = 6, least: int = 3) -> int:
    """The first of the first rows with at least three years; the second row if none has."""
    return next((i for i in range(min(among, len(rows))) if sum(year_of(c) is not None for c in rows[i]) >= least), 1)


def sector_wages(spark: SparkSession, path: str, glob: str = "tab4-zpl*.xlsx", names: tuple[str, ...] = ("2000-2017", "с 2018")) -> DataFrame:
    """Mean wages by sector and year: the named sheets, years in the second row; sheets that are missing are passed over."""

    def cells(own: dict[str, list[list]]) -> Iterator[tuple]:
        for sheet in names:
            for name, year, value in by_year(own.get(sheet, []), 1):
                yield year, f"avg_wage_{name[:60]}", value

    return _macro(spark, path, glob, cells)


def real_wages(spark: SparkSession, path: str, glob: str = "tab5-zpl*.xlsx") -> DataFrame:
    """Real-wage indices (% of the year before) by sector: the first two sheets, years in the row ``header_row`` finds."""

    def cells(own: dict[str, list[list]]) -> Iterator[tuple]:
        for rows in list(own.values())[:2]:
            for name, year, value in by_year(rows, header_row(rows)):
                yield year, f"real_wage_idx_{name[:55]}", value

    return _macro(spark, path, glob, cells, "%_prev_year")


def urbanisation(spark: SparkSession, path: str, glob: str = "demo32*.xlsx") -> DataFrame:
    """Urban population by year, from the 4th row on: number and rate per 1000; rows of years before 1900 drop."""

    def cells(own: dict[str, list[list]]) -> Iterator[tuple]:
        for row in next(iter(own.values()), [])[3:]:
            year = number(_at(row, 0))
            if year is not None and year >= 1900:
                yield str(int(year)), "urban_pop_count", number(_at(row, 1)), "persons"
                yield str(int(year)), "urban_pop_rate_per1000", number(_at(row, 2)), "per_1000"

    return _macro(spark, path, glob, cells)


def housing(spark: SparkSession, path: str, glob: str = "Jil_fond*.xls*") -> DataFrame:
    """Housing stock: sheets named 'YYYY.N', from the 10th row on an indicator and its total, urban and rural values."""

    def cells(own: dict[str, list[list]]) -> Iterator[tuple]:
        for sheet, rows in own.items():
            if re.fullmatch(r"\d+\.[^.]*", sheet.strip()):
                for row in rows[9:]:
                    name = str(_at(row, 0) or "").strip()
                    if len(name) >= 3 and name not in ("nan", "None"):
                        for k, part in enumerate(("total", "urban", "rural")):
                            yield sheet.strip(), f"housing_{part}_{name[:55]}", number(_at(row, k + 1))

    return _macro(spark, path, glob, cells, "sqm_thousands")


def macro(spark: SparkSession, path: str) -> DataFrame:
    """All macro readers over one folder; a format without files there gives no rows."""
    return functools.reduce(DataFrame.unionByName, [read(spark, path) for read in (wages, sector_wages, real_wages, urbanisation, housing)])


def wide_years(table: pd.DataFrame, indicator: str, unit: str, source: str) -> pd.DataFrame:
    """A sheet with years in a header row to (period, indicator, region, value, unit, source_file), rows' names as regions."""
    rows = [[None if pd.isna(x) else x for x in row] for row in table.itertuples(index=False)]
    columns = ["period", "indicator", "region", "value", "unit", "source_file"]
    if not any(sum(year_of(c) is not None for c in r) >= 3 for r in rows[:6]):
        return pd.DataFrame(columns=columns)
    own = [(year, indicator, name, value, unit, source) for name, year, value in by_year(rows, header_row(rows)) if value is not None]
    return pd.DataFrame(own, columns=columns)


def pdf_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """(filename, page from 1, text) for each PDF; ``extract`` gives the pages' texts (pypdf by default)."""

    def parse(file: str, content: bytes) -> pd.DataFrame:
        texts = (extract or _pdf_texts)(content)
        return pd.DataFrame({"filename": file.rsplit("/", 1)[-1], "page": range(1, len(texts) + 1), "text": texts})

    return per_file(binary(spark, path, "*.pdf"), parse, "filename string, page int, text string")


def year_in(name: str) -> int:
    """The first 20xx in a file's name, else 0."""
    m = re.search(r"(?<!\d)(20\d{2})(?!\d)", name)
    return int(m[1]) if m else 0


def _rar(content: bytes) -> list[tuple[str, bytes]]:
    import rarfile

    with rarfile.RarFile(io.BytesIO(content)) as r:
        return [(n, r.read(n)) for n in r.namelist()]


def archive_members(spark: SparkSession, path: str, suffix: str = ".pdf", open_rar: Callable[[bytes], list[tuple[str, bytes]]] = _rar) -> DataFrame:
    """(archive, year, filename, content) of the members of zip and RAR files; the year is that in the archive's name.

    RAR files go through ``open_rar`` (member names and contents; by default the package rarfile, where it is there).
    """

    def parse(file: str, content: bytes) -> pd.DataFrame:
        name = unquote(file.rsplit("/", 1)[-1])
        if content[:4] == b"Rar!":
            members = open_rar(content)
        else:
            members = _zip(content)
        own = [(name, year_in(name), n, c) for n, c in members if n.lower().endswith(suffix)]
        return pd.DataFrame(own, columns=["archive", "year", "filename", "content"])

    return per_file(binary(spark, path, "*.{zip,rar}"), parse, "archive string, year int, filename string, content binary")


def report_chunks(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]] | None = None, open_rar: Callable[[bytes], list[tuple[str, bytes]]] = _rar) -> DataFrame:
    """Annual reports under ``path``/company/: (id, company, year, source, filename, page, chunk, document).

    Loose PDFs and those in archives; an archive whose company and year is there as a loose PDF is passed over. Pages
    from 1, chunks from 0 after short ones are gone; the id is the md5 of company, file, page and chunk.
    """
    company = F.url_decode(F.element_at(F.split("path", "/"), -2))
    name = F.url_decode(F.element_at(F.split("path", "/"), -1))
    year = F.coalesce(F.regexp_extract(name, r"(?<!\d)(20\d{2})(?!\d)", 1).try_cast("int"), F.lit(0))
    files = binary(spark, path, "*.{pdf,zip,rar}").withColumns({"company": company, "name": name, "year": year})
    loose = files.filter(F.lower("name").endswith(".pdf"))
    packed = without_loaded_years(files.filter(~F.lower("name").endswith(".pdf")), loose.select("company", "year"))

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, when, content in zip(batch["company"], batch["year"], batch["content"], strict=True):
                inside = open_rar(content) if content[:4] == b"Rar!" else _zip(content)
                for n, c in inside:
                    if n.lower().endswith(".pdf"):
                        yield pd.DataFrame([(own, when, n.rsplit("/", 1)[-1], c)], columns=["company", "year", "filename", "content"])

    schema = "company string, year int, filename string, content binary"
    pdfs = loose.select("company", "year", F.col("name").alias("filename"), "content").unionByName(packed.mapInPandas(members, schema))

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, when, n, c in batch.itertuples(index=False):
                texts = (extract or _pdf_texts)(c)
                yield pd.DataFrame({"company": own, "year": when, "filename": n, "page": range(1, len(texts) + 1), "text": texts})

    read = pdfs.mapInPandas(pages, "company string, year int, filename string, page int, text string")
    rows = read.select("company", "year", F.lit("annual_report").alias("source"), "filename", "page", F.posexplode(chunks(F.col("text"))).alias("chunk", "document"))
    return rows.withColumn("id", F.md5(F.concat_ws("_", "company", "filename", "page", "chunk").cast("binary")))


def _zip(content: bytes) -> list[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [(n, z.read(n)) for n in z.namelist()]


def _pdf_texts(content: bytes) -> list[str]:
    from pypdf import PdfReader

    return [p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages]


def without_loaded_years(archives: DataFrame, loaded: DataFrame) -> DataFrame:
    """Archives whose (company, year) is not there as loose files; year 0 is unknown and never skipped."""
    return archives.join(loaded.filter("year <> 0").select("company", "year").distinct(), ["company", "year"], "left_anti")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Append-only logs; bad lines are skipped, a missing file is an empty log."""
    try:
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def sqlite(spark: SparkSession, path: str, table: str, schema: str, key: str = "rowid", pieces: int = 8) -> DataFrame:
    """A table of a SQLite file that every executor can reach by ``path``, read-only, without a driver's jar.

    The rows are dealt by ranges of ``key``, a whole-numbered column, over ``pieces`` tasks; each opens the file itself.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    uri = f"file:{quote(path)}?mode=ro"
    with contextlib.closing(sqlite3.connect(uri, uri=True)) as c:
        low, high = c.execute(f'SELECT min("{key}"), max("{key}") FROM "{table}"').fetchone()
    if low is None:
        return spark.createDataFrame([], schema)
    step = (high - low) // pieces + 1
    ranges = spark.createDataFrame([(low + k * step, low + (k + 1) * step) for k in range(pieces)], "low bigint, high bigint").repartition(pieces)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ", ".join(f'"{n}"' for n in names)
        with contextlib.closing(sqlite3.connect(uri, uri=True)) as c:
            for batch in batches:
                for first, last in batch.itertuples(index=False):
                    rows = c.execute(f'SELECT {columns} FROM "{table}" WHERE "{key}" >= ? AND "{key}" < ?', (int(first), int(last)))
                    while some := rows.fetchmany(4096):
                        yield pd.DataFrame(some, columns=names)

    return ranges.mapInPandas(read, schema)


def html_articles(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, title, text: pages with a title and more than ``least`` characters of paragraphs, by built-ins."""
    clean = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    title = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    paragraphs = F.expr(r"regexp_extract_all(clean, '(?is)<p[^>]*>(.*?)</p>', 1)")
    text = F.array_join(F.transform(paragraphs, lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, "<[^>]*>", " "), r"\s+", " "))), "\n")
    out = pages.withColumn("clean", clean).select("page_id", "url", title.alias("title"), text.alias("text"))
    return out.filter((F.col("title") != "") & (F.length("text") > least))


def report_arrays(text: str, name: str) -> list[int]:
    """The numbers of a JavaScript array in a report."""
    m = re.search(rf"{re.escape(name)}\s*[:=]\s*\[([^\]]*)\]", text)
    return [int(x) for x in re.findall(r"-?\d+", m[1])] if m else []
