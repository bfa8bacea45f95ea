"""Sources and sinks as queries: stand-in tables go out in a source's own format and come back through its reader.

Spreadsheets and quotes are made from daily and yearly aggregates, a few thousand rows whatever the tables' size; reports and
archives, which grow with the tables, are written by the tasks.
"""

from __future__ import annotations

import gzip
import json
import os
import uuid
from collections import defaultdict
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.operators import tables, texts
from lagloom.plans import stand_ins as T
from lagloom.plans.registry import query
from lagloom.sources import buckets, files, sinks, web
from lagloom.sources.shared import new_path, put
from lagloom.streaming import rollup


def _folder(spark: SparkSession, name: str, own: dict[str, bytes]) -> str:
    path = new_path(spark, name)
    for file, content in own.items():
        put(spark, f"{path}/{file}", content)
    return path


def _grouped(df: DataFrame, key: str) -> dict[str, list]:
    out = defaultdict(list)
    for r in df.toLocalIterator():
        out[r[key]].append(r)
    return out


@query(f"WITH {T.INDICES} SELECT ticker, trade_date, close, volume, CAST(NULL AS DOUBLE) AS high, 'RUB' AS currency FROM indices")
def read_zip_indices(spark, d):
    def file(rows):
        lines = ["Итоги торгов", "BOARDID;TRADEDATE;CLOSE;VOLUME;CURRENCYID"]
        lines += [f"X;{r['trade_date']:%d.%m.%Y};{repr(r['close']).replace('.', ',')};{repr(r['volume']).replace('.', ',')};RUB" for r in rows]
        return sinks.archive({"day.csv": "\n".join([*lines, "X;01.01.2000;;1;RUB"]).encode("cp1251")})

    path = _folder(spark, "zips", {f"{k}_2024.zip": file(v) for k, v in _grouped(T.indices(spark, d), "ticker").items()})
    return files.zip_indices(spark, path).select("ticker", "trade_date", "close", "volume", "high", "currency")


@query(f"WITH {T.MARKET} SELECT trade_date, instrument, floor(close * 4) / 4 AS close, CAST(datepart('day', trade_date) AS DOUBLE) / 4 AS change_pct FROM market")
def read_local_quotes(spark, d):
    def local(x: float) -> str:
        return f"{x:,.2f}".translate(str.maketrans(",.", ".,"))

    market = T.market(spark, d).withColumn("close", F.floor(F.col("close") * 4) / 4)
    own = {}
    for k, rows in _grouped(market, "instrument").items():
        lines = ['"Дата","Цена","Откр.","Макс.","Мин.","Объём","Изм. %"']
        lines += [f'"{r["trade_date"]:%d.%m.%Y}","{local(r["close"])}","1","1","1","1,5K","{str(r["trade_date"].day / 4).replace(".", ",")}%"' for r in rows]
        own[f"{k}.csv"] = "\n".join(lines).encode()
    return files.local_quotes(spark, _folder(spark, "quotes", own), {k: k[:-4] for k in own}).select("trade_date", "instrument", "close", "change_pct")


@query(f"WITH {T.FOREX} SELECT trade_date, CASE currency WHEN 'F' THEN 'USD' WHEN 'O' THEN 'EUR' ELSE currency END AS currency, rate, 1 AS nominal FROM forex")
def read_exchange_rates(spark, d):
    names, own = {"F": "Доллар США", "O": "Евро"}, {}
    for k, rows in _grouped(T.forex(spark, d), "currency").items():
        table = [["nominal", "data", "curs", "cdx"], *[[1, f"{r['trade_date']:%d.%m.%Y}", r["rate"], names.get(k, k)] for r in rows], [1, None, 2.0, k], [1, "01.01.2000", None, k]]
        own[f"RC_F{k}.xlsx"] = sinks.spreadsheet({"RC": table})
    return files.exchange_rates(spark, _folder(spark, "rates", own))


@query(f"WITH {T.KEY_RATE} SELECT period, rate_pct, inflation, CASE WHEN period LIKE '1.%' THEN 7 END AS days_to_meeting FROM key_rate")
def read_key_rates(spark, d):
    table = [["Дата", "Ставка", "Инфляция", "Дней"]]
    table += [[r["period"], r["rate_pct"], r["inflation"], "7" if r["period"].startswith("1.") else "-"] for r in T.key_rate(spark, d).toLocalIterator()]
    return files.key_rates(spark, _folder(spark, "keys", {"rate.xlsx": sinks.spreadsheet({"s": [*table, ["13.2000", None, 1, 1]]})}))


_MONTHLY = "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY 1, 2"
_NAMES = "['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec']"


@query(f"WITH m AS ({_MONTHLY}) SELECT CAST(year AS VARCHAR) AS period, 'avg_wage_rub' AS indicator, 'RF' AS region, CAST(sum(n) AS DOUBLE) AS value, 'RUB' AS unit FROM m GROUP BY year UNION ALL SELECT year || '-' || {_NAMES}[month], 'avg_wage_rub', 'RF', CAST(n AS DOUBLE), 'RUB' FROM m")
def read_wages(spark, d):
    o = T.table(spark, d, "orders")
    years: dict[int, dict[int, int]] = defaultdict(dict)
    for r in o.groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).count().toLocalIterator():
        years[r["y"]][r["m"]] = r["count"]
    body = [[y, sum(own.values()), None, 1, 2, 3, 4, *[own.get(m) for m in range(1, 13)]] for y, own in years.items()]
    sheet = [*[[f"line {i}"] for i in range(7)], *body, ["note 1)", 5]]
    return files.wages(spark, _folder(spark, "wages", {"tab1-zpl_01.xlsx": sinks.spreadsheet({"a": sheet})})).drop("source_file")


_YEARLY = "SELECT CAST(year(l_shipdate) AS VARCHAR) AS period, l_returnflag AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2"


def _by_flag(spark: SparkSession, d: str) -> tuple[list[int], dict[str, dict[int, int]]]:
    flags: dict[str, dict[int, int]] = defaultdict(dict)
    for r in T.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("y"), "l_returnflag").count().toLocalIterator():
        flags[r["l_returnflag"]][r["y"]] = r["count"]
    return sorted({y for own in flags.values() for y in own}), flags


@query(f"WITH y AS ({_YEARLY}) SELECT period, 'avg_wage_' || flag AS indicator, CAST(n AS DOUBLE) AS value, 'RUB' AS unit FROM y")
def read_sector_wages(spark, d):
    years, flags = _by_flag(spark, d)
    half = len(years) // 2
    sheet = lambda ys: [["title"], [None, *[f"{y})1" for y in ys]], *[[k, *[own.get(y) for y in ys]] for k, own in flags.items()], ["1) note", 7]]
    path = _folder(spark, "sectors", {"tab4-zpl_2025.xlsx": sinks.spreadsheet({"2000-2017": sheet(years[:half]), "с 2018": sheet(years[half:])})})
    return files.sector_wages(spark, path).select("period", "indicator", "value", "unit")


@query(f"WITH y AS ({_YEARLY}) SELECT period, 'real_wage_idx_' || flag AS indicator, CAST(n AS DOUBLE) AS value, '%_prev_year' AS unit FROM y")
def read_real_wages(spark, d):
    years, flags = _by_flag(spark, d)
    sheet = [["title"], ["of 1899", 1], [None], [None, *years], *[[k, *[own.get(y) for y in years]] for k, own in flags.items()]]
    return files.real_wages(spark, _folder(spark, "real", {"tab5-zpl_2025.xlsx": sinks.spreadsheet({"a": sheet, "b": [["none"]]})})).select("period", "indicator", "value", "unit")


@query("WITH y AS (SELECT CAST(year(o_orderdate) AS VARCHAR) AS period, count(*) AS n, count(DISTINCT o_custkey) AS c FROM orders GROUP BY 1) SELECT period, 'urban_pop_count' AS indicator, CAST(n AS DOUBLE) AS value, 'persons' AS unit FROM y UNION ALL SELECT period, 'urban_pop_rate_per1000', CAST(c AS DOUBLE), 'per_1000' FROM y")
def read_urbanisation(spark, d):
    y = T.table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("c"))
    sheet = [["t"], ["h"], ["h"], *[[r["y"], f"{r['n']:,}".replace(",", " "), r["c"]] for r in y.toLocalIterator()], ["text", 1, 1]]
    return files.urbanisation(spark, _folder(spark, "urban", {"demo32_2023.xlsx": sinks.spreadsheet({"a": sheet})})).select("period", "indicator", "value", "unit")


@query("WITH q AS (SELECT year(o_orderdate) || '.' || quarter(o_orderdate) AS period, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2) SELECT period, 'housing_total_stock ' || s AS indicator, CAST(n AS DOUBLE) AS value FROM q UNION ALL SELECT period, 'housing_urban_stock ' || s, CAST(n AS DOUBLE) / 2 FROM q")
def read_housing(spark, d):
    q = T.table(spark, d, "orders").groupBy(F.concat_ws(".", F.year("o_orderdate"), F.quarter("o_orderdate")).alias("p"), "o_orderstatus").count()
    own = {k: [*[["head"]] * 9, *[[f"stock {r['o_orderstatus']}", r["count"], r["count"] / 2, "-"] for r in v]] for k, v in _grouped(q, "p").items()}
    return files.housing(spark, _folder(spark, "stock", {"Jil_fond_2025.xlsx": sinks.spreadsheet({"Notes": [["x"]]} | own)})).select("period", "indicator", "value")


_COMPANIES = "SELECT 'company ' || (item_id % 5) AS company, 2015 + CAST(item_id % 7 AS INTEGER) AS year, 'r' || item_id || '.pdf' AS filename, text FROM benchmark"
_PIECES = r"list_filter(list_transform(CASE WHEN length(text) > 0 THEN range(0, length(text), 700) ELSE [] END, lambda s: regexp_replace(text[s + 1 : s + 900], '^\s+|\s+$', '', 'g')), lambda c: length(c) > 50)"


@query(f"WITH f AS ({_COMPANIES}), c AS (SELECT company, year, filename, {_PIECES} AS cs FROM f) SELECT company, year, filename, 1 AS page, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS chunk, unnest(cs) AS document, md5(company || '_' || filename || '_1_' || (generate_subscripts(cs, 1) - 1)) AS id FROM c")
def read_report_chunks(spark, d):
    """Reports as loose files and in archives; an archive of a company and year that is there already is passed over.

    The files are written by the tasks into the shared folder, one or two for each row of the table.
    """
    path = new_path(spark, "reports")
    root, zipped = path.removeprefix("file://"), sinks.archive
    item = F.col("item_id")
    rows = T.table(spark, d, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("company "), (item % 5).cast("string")).alias("company"), (2015 + item % 7).cast("int").alias("year"))
    # Whether a company and year have loose files of odd items.
    loose = rows.groupBy("company", "year").agg(F.max(item % 2).alias("loose"))

    def write(batches):
        for batch in batches:
            for r in batch.itertuples(index=False):
                folder, name, text = f"{root}/{r.company}", f"r{r.item_id}.pdf", r.text.encode()
                own = {}
                if r.item_id % 2 or r.loose:
                    own[f"{r.year} {name}"] = text
                if r.item_id % 2 == 0:
                    member = {"in/again.pdf": b"x" * 99} if r.loose else {f"in/{name}": text}
                    own[f"{r.year} {r.item_id}.zip"] = zipped(member | {"in/readme.txt": b"no"})
                os.makedirs(folder, exist_ok=True)
                for file, content in own.items():
                    with open(f"{folder}/{file}", "wb") as f:
                        f.write(content)
            yield pd.DataFrame({"n": [len(batch)]})

    rows.join(loose, ["company", "year"]).mapInPandas(write, "n int").agg(F.sum("n")).collect()
    got = files.report_chunks(spark, path, lambda b: [b.decode()])
    # Loose files carry the year in their names; ids are those of the names without it.
    name = F.regexp_extract("filename", r"(r\d+\.pdf)$", 1)
    return got.select("company", "year", name.alias("filename"), "page", "chunk", "document", F.md5(F.concat_ws("_", "company", name, "page", "chunk").cast("binary")).alias("id"))


@query(f"WITH {T.ARTICLES} SELECT CAST(id AS VARCHAR) AS id, CAST(date AS VARCHAR) AS date, text FROM articles WHERE date >= DATE '1996-01-01'")
def stream_load(spark, d):
    """Twice over the same files: the second run finds nothing new."""
    src, out, progress = (new_path(spark, n) for n in ("articles", "loaded", "progress"))
    T.articles(spark, d).select(F.col("id").cast("string").alias("id"), F.col("date").cast("string").alias("date"), "text").write.parquet(src)
    for _ in range(2):
        rollup.load(spark, src, "id string, date string, text string", out, progress, "1996-01-01").awaitTermination()
    return spark.read.schema("id string, date string, text string").parquet(out)


_WORDS = ["heit", "ción", "SHABLE"]


@query(f"WITH {T.ARTICLES} SELECT id AS doc, md5(text[1:1000][1:200]) AS id, text[1:1000] AS document FROM articles WHERE length(text[1:1000]) >= 50 AND (" + " OR ".join(f"contains(lower(text), '{w.lower()}')" for w in _WORDS) + ")")
def keyword_stream(spark, d):
    rows = T.articles(spark, d).withColumnRenamed("id", "doc")
    return texts.keyword_stream(rows, _WORDS).select("doc", "id", "document")


@query("SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, event_type, value FROM events WHERE event_type = 'error'")
def read_json_lines(spark, d):
    e, path = T.table(spark, d, "events").select("event_id", "event_type", "value"), new_path(spark, "log")
    sinks.append_json(e, path)
    sinks.append_json(e.filter("event_type = 'error'"), path)
    spark.createDataFrame([("no json",), ("{broken",)], "value string").coalesce(1).write.mode("append").text(path)
    return files.json_lines(spark, path, "event_id bigint, event_type string, value double").filter("event_id is not null")


@query("SELECT 'site' || (page_id % 8) || '.org' AS domain, url, trim(coalesce(html, ''), E' \\n\\r\\t') AS html FROM pages")
def web_records(spark, d):
    """Pages as archives of gzipped records, and their index, both behind a fetcher.

    Each task writes an archive of its pages into the shared folder, and the index lines of its records; the fetcher reads an
    index a page of lines at a time and an archive by ranges.
    """
    root, index = new_path(spark, "archives").removeprefix("file://"), new_path(spark, "index")
    lines_of = index.removeprefix("file://")

    def write(batches):
        os.makedirs(root, exist_ok=True)
        for batch in batches:
            name, at, lines = f"{uuid.uuid4().hex}.warc.gz", 0, []
            with open(f"{root}/{name}", "wb") as f:
                for r in batch.itertuples(index=False):
                    record = gzip.compress(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" + (r.html or "").encode() + b"\r\n\r\n")
                    f.write(record)
                    lines.append(json.dumps({"timestamp": "20240101", "url": r.url, "filename": name, "offset": at, "length": len(record), "status": "200"}))
                    at += len(record)
            yield pd.DataFrame({"domain": batch["domain"], "value": lines})

    def fetch(url, headers):
        from urllib.parse import parse_qs, urlparse

        if "Range" in headers:
            first, last = map(int, headers["Range"].removeprefix("bytes=").split("-"))
            with open(root + urlparse(url).path, "rb") as f:
                f.seek(first)
                return 206, f.read(last + 1 - first)
        q = parse_qs(urlparse(url).query)
        folder, at, n = f"{lines_of}/domain={q['url'][0].split('/')[0].removeprefix('*.')}", int(q["offset"][0]), int(q["limit"][0])
        parts = sorted(x for x in os.listdir(folder) if x.startswith("part-")) if os.path.isdir(folder) else []
        each = (line for x in parts for line in open(f"{folder}/{x}", "rb"))
        return 200, b"".join(islice(each, at, at + n))

    pages = T.table(spark, d, "pages").select(F.concat(F.lit("site"), (F.col("page_id") % 8).cast("string"), F.lit(".org")).alias("domain"), "url", "html")
    # Whole pages go to Python a few megabytes at a time, not 10,000 rows.
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "4m")
    try:
        pages.mapInPandas(write, "domain string, value string").write.partitionBy("domain").text(index)
    finally:
        spark.conf.set(limit, before)
    found = web.index_pages(spark, [f"site{i}.org" for i in range(8)], fetch, "http://index", "2022", "2026", limit=100)
    return web.records(found, fetch, "http://data").select("domain", "url", "html")


@query("SELECT n_nationkey, n_name, CASE WHEN n_regionkey = 2 THEN n_regionkey ELSE n_regionkey + 100 END AS n_regionkey FROM nation")
def partition_refresh(spark, d):
    """All partitions are written, and all but one replaced."""
    n, path = T.table(spark, d, "nation").withColumn("part", F.col("n_regionkey")), new_path(spark, "nation")
    sinks.partition_refresh(n, path, "part")
    sinks.partition_refresh(n.filter("part <> 2").withColumn("n_regionkey", F.col("n_regionkey") + 100), path, "part")
    return spark.read.parquet(path).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 1000 AND 5000")
def layout_filter(spark, d):
    """A table by segment, sorted by balance: the filter reads one partition and skips row groups."""
    path = new_path(spark, "layout")
    sinks.laid_out(T.table(spark, d, "customer"), path, ["c_mktsegment"], ["c_acctbal"])
    return spark.read.parquet(path).filter("c_mktsegment = 'BUILDING' AND c_acctbal BETWEEN 1000 AND 5000").select("c_custkey", "c_name")


@query("SELECT r_regionkey + 1 AS r_regionkey, r_name FROM region")
def full_refresh(spark, d):
    path, r = new_path(spark, "region"), T.table(spark, d, "region")
    sinks.full_refresh(r, path)
    sinks.full_refresh(r.withColumn("r_regionkey", F.col("r_regionkey") + 1), path)
    sinks.views(spark, {"refreshed_region": spark.read.parquet(path)})
    return spark.sql("SELECT r_regionkey, r_name FROM refreshed_region")


@query(f"WITH {T.ARTICLES} SELECT md5(CAST(id AS VARCHAR)) AS id, CASE WHEN lang = 'en' THEN coalesce(text, '') ELSE lang END AS document, [CAST(length(CASE WHEN lang = 'en' THEN coalesce(text, '') ELSE lang END) AS FLOAT)] AS embedding FROM articles")
def chunk_upsert(spark, d):
    """Chunks with vectors by an injected model, then new texts for some of their ids."""
    path = new_path(spark, "chunks")
    a = T.articles(spark, d).select(F.md5(F.col("id").cast("string").cast("binary")).alias("id"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    model = lambda texts: [[float(len(t))] for t in texts]
    sinks.upsert_chunks(spark, path, a.select("id", F.col("lang").alias("document")), model)
    sinks.upsert_chunks(spark, path, a.filter("lang = 'en'").select("id", F.col("text").alias("document")), model)
    return buckets.read(spark, path)


@query("""WITH one AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 6000), two AS (SELECT c_custkey, c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_acctbal >= 2000),
three AS (SELECT c_custkey, c_name || '*' AS c_name, c_acctbal FROM customer WHERE c_acctbal < 0)
SELECT * FROM three UNION ALL SELECT * FROM two UNION ALL SELECT * FROM one WHERE c_acctbal BETWEEN 0 AND 1999.9999""")
def bucket_upserts(spark, d):
    """Three upserts into a table in hash buckets, and an insert that finds all its keys there."""
    path, order = new_path(spark, "customers"), [F.col("c_name")]
    c = T.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    for rows in (c.filter("c_acctbal < 6000"), c.filter("c_acctbal >= 2000").withColumn("c_acctbal", F.col("c_acctbal") + 1), c.filter("c_acctbal < 0").withColumn("c_name", F.concat("c_name", F.lit("*")))):
        buckets.upsert(spark, path, rows, ["c_custkey"], order, 16)
    buckets.insert(spark, path, c, ["c_custkey"], order)
    return buckets.read(spark, path)


_REGIONS = {"ASIA": "Asia and Oceania", "EUROPE": "Europe"}


@query("SELECT CASE r_name WHEN 'ASIA' THEN 'Asia and Oceania' WHEN 'EUROPE' THEN 'Europe' ELSE r_name END AS region, n_name FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'AFRICA'")
def region_names(spark, d):
    n = T.table(spark, d, "nation").join(T.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return texts.regions(n.select(F.concat(F.lit(" "), F.col("r_name"), F.lit("  ")).alias("region"), "n_name"), _REGIONS, ["AFRICA"])


@query(f"WITH {T.ARTICLES} SELECT source, first(date ORDER BY date, id) AS first, first(id ORDER BY date, id) AS id FROM articles GROUP BY source")
def first_articles(spark, d):
    """A stream without repeated keys: one row of each source."""
    src, out, progress = (new_path(spark, n) for n in ("dated", "firsts", "progress"))
    a = T.articles(spark, d).select("source", "date", "id")
    tables.first_by_key(a, ["source"], [F.col("date"), F.col("id")]).unionByName(tables.first_by_key(a, ["source"], [F.col("date"), F.col("id")])).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.parquet(src)
    stream = spark.readStream.schema("source string, date date, id bigint, ts timestamp").parquet(src)
    rollup.first_articles(stream, "source").writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("source string, date date, id bigint").parquet(out)
    return got.groupBy("source").agg(F.min("date").alias("first"), F.min_by("id", "date").alias("id"))
