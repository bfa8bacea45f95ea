import datetime as dt
import gzip
import json
import sqlite3
import zipfile
from urllib.parse import parse_qs, urlparse

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lagloom import schemas
from lagloom.operators import audit, experiments
from lagloom.sources import buckets, files, shared, sinks, web


def xlsx(path, sheets, shared_strings=True):
    path.write_bytes(sinks.spreadsheet(sheets, shared_strings))


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_exchange_rates(spark, tmp_path):
    day = (dt.date(2024, 1, 9) - dt.date(1899, 12, 30)).days
    table = [["nominal", "data", "curs", "cdx"], [1, day, 89.5, "Доллар США"], [100, "10.01.2024", "61,25", "Японская иена"], [1, None, 5, "Евро"], [1, day, None, "Евро"], [10, "2024-01-10", 7, "Крона"], [1, day, 89.5, "Доллар США"], [1, "soon", 3, "Евро"]]
    xlsx(tmp_path / "RC_F01.xlsx", {"RC": table})
    xlsx(tmp_path / "other.xlsx", {"x": table})
    got = rows(files.exchange_rates(spark, str(tmp_path)), "trade_date", "currency", "rate", "nominal")
    assert got == sorted([(dt.date(2024, 1, 9), "USD", 89.5, 1), (dt.date(2024, 1, 10), "JPY", 61.25, 100), (dt.date(2024, 1, 10), "Крона", 7.0, 10)], key=str)


def test_key_rates(spark, tmp_path):
    table = [["Дата", "Ставка", "Инфляция", "Дней"], ["3.2026", 15.5, 6.1, "4"], [2.2026, "16,00", None, "-"], ["1.2026", None, 6.0, 3], ["12.2025", 16]]
    xlsx(tmp_path / "rate.xlsx", {"s": table}, shared_strings=False)
    got = rows(files.key_rates(spark, str(tmp_path)), "period", "rate_pct", "inflation", "days_to_meeting")
    assert got == [("12.2025", 16.0, None, None), ("2.2026", 16.0, None, None), ("3.2026", 15.5, 6.1, 4)]


def test_wages_by_month(spark, tmp_path):
    head = [[f"line {i}"] for i in range(7)]
    full = [2024, 80_000, 70_000, 1, 2, 3, 4, *range(101, 113)]
    xlsx(tmp_path / "tab1-zpl_01-2026.xlsx", {"a": [*head, full, ["2025", "90 000,5", None, None, None, None, None, "95 000", "-"], [1989, 1], ["note"]]})
    got = rows(files.wages(spark, str(tmp_path)), "period", "value", "indicator", "region", "unit", "source_file")
    rest = ("avg_wage_rub", "RF", "RUB", "tab1-zpl_01-2026.xlsx")
    want = [("2024", 80_000.0, *rest), ("2025", 90_000.5, *rest), ("2025-Jan", 95_000.0, *rest)]
    want += [(f"2024-{m}", 101.0 + k, *rest) for k, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())]
    assert got == sorted(want, key=str)


def test_sector_wages_and_real_wages(spark, tmp_path):
    early = [["title"], [None, "2000", "2001 1)", 2017], ["Mining", 1, "2,5", "x"], [None, 9], ["1) note", 3]]
    late = [["title"], [None, 2018, "2019)2"], ["Mining", 7, 8], ["X" * 70, 1, None]]
    xlsx(tmp_path / "tab4-zpl_2025.xlsx", {"2000-2017": early, "notes": [["no"]], "с 2018": late})
    got = rows(files.sector_wages(spark, str(tmp_path)), "period", "indicator", "value")
    assert got == sorted([("2000", "avg_wage_Mining", 1.0), ("2001", "avg_wage_Mining", 2.5), ("2018", "avg_wage_Mining", 7.0), ("2019", "avg_wage_Mining", 8.0), ("2018", "avg_wage_" + "X" * 60, 1.0)], key=str)
    shifted = [["t"], [None], [None, 1999], [None, 2000, 2001, 2002], ["All", 101.5, None, 99]]
    xlsx(tmp_path / "tab5-zpl_2025.xlsx", {"a": shifted, "b": [["t"], [None, 2003], ["All", 98]], "notes": shifted})
    got = rows(files.real_wages(spark, str(tmp_path)), "period", "indicator", "value", "unit")
    assert got == [("2000", "real_wage_idx_All", 101.5, "%_prev_year"), ("2002", "real_wage_idx_All", 99.0, "%_prev_year"), ("2003", "real_wage_idx_All", 98.0, "%_prev_year")]


def test_urbanisation_and_housing(spark, tmp_path):
    xlsx(tmp_path / "demo32_2023.xlsx", {"a": [["t"], [], ["h"], [1926, "26 314 114", 179], [2023, None, 749], ["text"], [1897, 1, 1]]})
    got = rows(files.urbanisation(spark, str(tmp_path)), "period", "indicator", "value", "unit")
    assert got == [("1926", "urban_pop_count", 26_314_114.0, "persons"), ("1926", "urban_pop_rate_per1000", 179.0, "per_1000"), ("2023", "urban_pop_rate_per1000", 749.0, "per_1000")]
    body = [[f"l{i}"] for i in range(9)]
    xlsx(tmp_path / "Jil_fond_2019-2025.xlsx", {"2025.1": [*body, ["Stock", 3, 2, 1], ["ab", 1], [None, 5]], "2024.4": [*body, ["Stock", 9]], "Notes": body, "x.1": [*body, ["Stock", 1]]})
    got = rows(files.housing(spark, str(tmp_path)), "period", "indicator", "value")
    assert got == [("2024.4", "housing_total_Stock", 9.0), ("2025.1", "housing_rural_Stock", 1.0), ("2025.1", "housing_total_Stock", 3.0), ("2025.1", "housing_urban_Stock", 2.0)]
    assert files.macro(spark, str(tmp_path)).count() == 7


def test_wide_cells_and_gaps():
    assert files.number("1 234,5") == files.number("1\xa0234.5") == 1234.5
    assert [files.number(x) for x in (None, "-", "", "x", float("nan"), True)] == [None] * 6
    assert files.day(dt.datetime(2024, 5, 6, 7)) == dt.date(2024, 5, 6) and files.day("x") is files.day(None) is files.day(-3) is None


def test_reports_from_pdfs_and_archives(spark, tmp_path):
    long = "word " * 20
    own = tmp_path / "Acme Ltd"
    own.mkdir()
    (own / "annual 2021.pdf").write_bytes(f"{long}|short".encode())
    for name in ("a_2021.zip", "b_2022.zip", "c.zip"):
        with zipfile.ZipFile(own / name, "w") as z:
            z.writestr(f"in/{name}.PDF", f"{name} {long}".encode())
            z.writestr("in/readme.txt", b"no")
    (own / "d_2023.rar").write_bytes(b"Rar!....")
    got = files.report_chunks(spark, str(tmp_path), lambda b: b.decode().split("|"), lambda b: [("d.pdf", f"rar {long}".encode()), ("x.doc", b"")])
    found = rows(got, "company", "year", "filename", "page", "chunk")
    assert found == sorted([("Acme Ltd", 2021, "annual 2021.pdf", 1, 0), ("Acme Ltd", 2022, "b_2022.zip.PDF", 1, 0), ("Acme Ltd", 0, "c.zip.PDF", 1, 0), ("Acme Ltd", 2023, "d.pdf", 1, 0)], key=str)
    import hashlib

    assert {r["id"] for r in got.collect()} >= {hashlib.md5(b"Acme Ltd_annual 2021.pdf_1_0").hexdigest()}
    assert {r["archive"] for r in files.archive_members(spark, str(own), open_rar=lambda b: [("d.pdf", b"x")]).collect()} == {"a_2021.zip", "b_2022.zip", "c.zip", "d_2023.rar"}


def test_chunks_are_upserted_with_vectors(spark, tmp_path):
    path = str(tmp_path / "chunks")
    embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert not buckets.exists(spark, path)
    sinks.upsert_chunks(spark, path, spark.createDataFrame([("a", "one"), ("b", "two")], "id string, document string"), embed)
    sinks.upsert_chunks(spark, path, spark.createDataFrame([("b", "three"), ("c", "four"), ("c", "four")], "id string, document string"), embed)
    got = rows(buckets.read(spark, path), "id", "document", "embedding")
    assert got == [("a", "one", [3.0, 1.0]), ("b", "three", [5.0, 1.0]), ("c", "four", [4.0, 1.0])]


def test_layout_prunes_files_and_row_groups(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.laid_out(spark.range(1000).selectExpr("id % 3 AS k", "id AS v"), path, ["k"], ["v"])
    read = spark.read.parquet(path).filter("k = 1 AND v > 990")
    plan = read._jdf.queryExecution().toString()
    assert read.count() == 3 and "PartitionFilters" in plan and "GreaterThan(v,990)" in plan
    assert spark.read.parquet(path).count() == 1000


def test_reports_hold_every_row(spark, tmp_path):
    sinks.chart_data({"long": spark.range(6000), "none": spark.range(0), "two": spark.createDataFrame([(1, "ü", None)], "a int, b string, c date")}, str(tmp_path / "c.json"))
    got = json.loads((tmp_path / "c.json").read_text(encoding="utf-8"))
    assert [r["id"] for r in got["long"]] == list(range(6000)) and got["none"] == [] and got["two"] == [{"a": 1, "b": "ü", "c": None}]
    assert sinks.markdown_table(spark.range(300)).count("\n") == 301


def test_sqlite_by_ranges(spark, tmp_path):
    path = str(tmp_path / "news ü.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE articles (id INTEGER PRIMARY KEY, text TEXT, n REAL)")
        c.executemany("INSERT INTO articles VALUES (?, ?, ?)", [(i * 7, f"t{i}" if i else None, i / 2) for i in range(50)])
        c.execute("CREATE TABLE empty (id INTEGER)")
    got = files.sqlite(spark, path, "articles", "id bigint, text string, n double", "id", 4)
    assert rows(got, "id", "text", "n") == sorted([(i * 7, f"t{i}" if i else None, i / 2) for i in range(50)], key=str)
    assert files.sqlite(spark, path, "empty", "id bigint").count() == 0


def test_web_archive_over_a_fetcher(spark, tmp_path):
    """Pages of the index until one is short, a busy server asked again, ranges cut out of the archive's files."""
    page = lambda k: f"<html><title>T{k}</title><p>{'text ' * 30}</p></html>"
    archive, index = b"", []
    for k in range(5):
        head = b"WARC/1.0\r\nWARC-Type: " + (b"request" if k == 3 else b"response") + b"\r\n\r\n"
        record = head + b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + page(k).encode() + b"\r\n\r\n"
        record = gzip.compress(record) if k % 2 else record
        index.append({"timestamp": f"2024010{k}", "url": f"http://a.ru/{k}", "filename": "w/1.warc", "offset": str(len(archive)), "length": str(len(record)), "status": "200"})
        archive += record
    (tmp_path / "archive").write_bytes(archive)
    (tmp_path / "index").write_text("\n".join(map(json.dumps, index)))
    folder, busy = str(tmp_path), str(tmp_path / "asked")

    def fetch(url, headers):
        import os

        if url.startswith("http://index"):
            q = {k: v[0] for k, v in parse_qs(urlparse(url).query).items()}
            if q["url"] != "*.a.ru/*":
                return 404, b""
            if not os.path.exists(busy):
                open(busy, "w").close()
                return 503, b""
            lines = open(f"{folder}/index").read().splitlines()[int(q["offset"]) : int(q["offset"]) + int(q["limit"])]
            return 200, "\n".join(lines).encode()
        first, last = map(int, headers["Range"].removeprefix("bytes=").split("-"))
        return 206, open(f"{folder}/archive", "rb").read()[first : last + 1]

    found = web.index_pages(spark, ["a.ru", "b.ru"], fetch, "http://index/cdx", "2022", "2026", limit=2, wait=0)
    assert rows(found, "url", "length") == [(r["url"], int(r["length"])) for r in index]
    got = web.records(found.unionByName(found), fetch, "http://data", wait=0)
    assert rows(got, "url", "html") == [(f"http://a.ru/{k}", page(k)) for k in (0, 1, 2, 4)]
    articles = files.html_articles(got.withColumn("page_id", F.lit(1)))
    assert rows(articles, "title") == [("T0",), ("T1",), ("T2",), ("T4",)]
    with pytest.raises(OSError, match="after 2 attempts"):
        web.tried(lambda u, h: (503, b""), "http://x", {}, attempts=2, sleep=lambda s: None)


class Elsewhere:
    """A session of a cluster, as far as ``shared_dir`` looks at it."""

    def __init__(self, master, named="", checkpoint=None):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": named}, self
        self.master, self._checkpoint = master, checkpoint

    def getCheckpointDir(self):
        return self._checkpoint


def test_no_local_folder_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_dir(Elsewhere(master))
    assert shared.shared_dir(Elsewhere("yarn", "hdfs://n/shared/")) == "hdfs://n/shared"
    assert shared.shared_dir(Elsewhere("yarn", checkpoint="hdfs://n/ck")) == "hdfs://n/ck"
    assert shared.shared_dir(Elsewhere("local[4]")).startswith("file:///")


def test_kept_tables_are_cleared(spark):
    import os

    df = shared.keep(spark.range(3), "t")
    path = next(iter(df.inputFiles()))
    assert os.path.exists(path.removeprefix("file://"))
    shared.clear(spark)
    assert not os.path.exists(path.removeprefix("file://"))


def test_percent_column_keeps_its_point(spark, tmp_path):
    (tmp_path / "q.csv").write_text("d,p,o,h,l,v,c\n05.01.2024,\"1.234,5\",1,1,1,1K,0.25%\n", encoding="utf-8")
    assert [r["change_pct"] for r in files.local_quotes(spark, str(tmp_path), {"q.csv": "Q"}).collect()] == [0.25]


def test_stored_logs_feed_the_analytics(spark):
    """Experiments and telemetry in their stored form, through audit, statistics and summaries."""
    blank = dict.fromkeys(schemas.EXPERIMENTS.fieldNames())
    own = [blank | {"id": i, "session_id": "s", "iteration": i, "hypothesis": "h", "sql_final": "SELECT usd_rub AS dxy", "confirmed": c, "signal_score": 80, "lag_days": 0, "sql_attempts": 2, "sql_success": 1, "sql_v1_error": "Binder Error", "sql_v1_error_type": "binder"} for i, c in ((1, 1), (2, 0), (3, None))]
    log = schemas.log_of(spark.createDataFrame([tuple(r[n] for n in blank) for r in own], schemas.EXPERIMENTS))
    rates = audit.run(log).rates.first()
    assert (rates["total"], rates["confirmed_raw"], rates["clean_confirmed"], rates["aliasing"]) == (3, 1, 0, 1)
    assert [tuple(r) for r in experiments.error_types(log, ["error_type_1", "error_type_2", "error_type_3"]).collect()] == [("binder", 3)]
    m = experiments.session_metrics(log).first()
    assert (m["confirmed"], m["rejected"], m["partial"], m["avg_score"], m["sql_error_rate"], m["max_chain"]) == (1, 1, 1, 80.0, 0.0, 1)
    t = dict.fromkeys(schemas.TELEMETRY.fieldNames(), None) | {"session_id": "s", "iteration": 1, "lag_days": 7, "t_total_ms": 1500, "tok_session_total": 11, "t_rag_ms": 3, "sql_attempts": 2}
    s = experiments.session_summary(schemas.times_of(spark.createDataFrame([tuple(t.values()), tuple((t | {"t_total_ms": 500, "sql_attempts": 1}).values())], schemas.TELEMETRY)), {"avg_rag_ms": "ms_rag"}).first()
    assert (s["iterations"], s["total_wall_s"], s["avg_iter_s"], s["total_tokens"], s["avg_rag_ms"], s["lag_distribution"], s["sql_repair_rate"]) == (2, 2.0, 1.0, 22, 3.0, "7:2", 50.0)


def test_refreshes_appends_and_views(spark, tmp_path):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2, None)], "n int, s string")
    sinks.full_refresh(a, str(tmp_path / "t"))
    sinks.full_refresh(b, str(tmp_path / "t"))
    assert rows(spark.read.parquet(str(tmp_path / "t")), "n", "s") == [(2, None)]
    for df in (a, b):
        sinks.append_json(df, str(tmp_path / "j"))
    assert rows(files.json_lines(spark, str(tmp_path / "j"), "n int, s string"), "n", "s") == [(1, "x"), (2, None)]
    assert [json.loads(r[0]) for r in sinks.json_rows(b).collect()] == [{"n": 2, "s": None}]
    sinks.views(spark, {"one_a": a, "one_b": b})
    assert spark.sql("SELECT count(*) FROM one_a JOIN one_b ON true").first()[0] == 1


def test_runs_are_inserted_once(spark, tmp_path):
    runs = spark.sql("SELECT 's' AS session, 1 AS iteration, array(named_struct('sql', 'a', 'error', 'e', 'error_type', 't')) AS attempts UNION ALL SELECT 's', 2, null")
    for _ in range(2):
        experiments.insert(runs, str(tmp_path / "e"))
    assert rows(spark.read.parquet(str(tmp_path / "e")), "iteration", "sql_attempts", "error_type_1") == [(1, 1, "t"), (2, 0, None)]


def test_a_task_inserts_a_bounded_number_of_runs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(experiments, "ROWS", 100, raising=False)
    runs = spark.range(4000).selectExpr("concat('s', id % 2) AS session", "CAST(id AS INT) AS iteration", "array(named_struct('sql', 'a', 'error', CAST(null AS STRING), 'error_type', CAST(null AS STRING))) AS attempts")
    for _ in range(2):
        experiments.insert(runs, str(tmp_path / "e"))
    got = spark.read.parquet(str(tmp_path / "e"))
    assert got.count() == got.select("iteration").distinct().count() == 4000
    assert max(len(pd.read_parquet(f)) for f in (tmp_path / "e").glob("*.parquet")) < 200


def test_pages_of_a_batch_are_handed_over_in_pieces(spark, monkeypatch):
    record = b"WARC-Type: response\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" + b"x" * (1 << 20)
    index = spark.createDataFrame([("a", "1", "u", "f", 0, len(record), "200")], web.INDEX)
    taken = []
    monkeypatch.setattr(type(index), "mapInPandas", lambda self, read, schema: taken.append(read) or self)
    web.records(index, lambda url, headers: (206, record), "http://data")
    lines = pd.DataFrame([("a", "1", f"u{i}", "f", i, len(record)) for i in range(10)], columns=["domain", "timestamp", "url", "filename", "offset", "length"])
    pieces = list(taken[0](iter([lines])))
    assert [u for p in pieces for u in p["url"]] == [f"u{i}" for i in range(10)]
    assert max(p["html"].str.len().sum() for p in pieces) <= web.PIECE
