import io
import json
import os
import sqlite3  # noqa: F401
import zipfile

import pandas as pd

from lagloom.sources import files, shared, sinks
from lagloom.streaming import rollup


def test_zip_indices(spark, tmp_path):
    text = "junk\nBOARDID;TRADEDATE;CLOSE;OPEN;VALUE;CURRENCYID\nX;02.01.2024;1,5;1,25;10;RUB\nX;03.01.2024;;1;1;RUB\n"
    with zipfile.ZipFile(tmp_path / "IMX_2024.zip", "w") as z:
        z.writestr("a.csv", text.encode("cp1251"))
    rows = files.zip_indices(spark, str(tmp_path)).collect()
    assert [(r["ticker"], str(r["trade_date"]), r["close"], r["high"], r["currency"]) for r in rows] == [("IMX", "2024-01-02", 1.5, None, "RUB")]


def test_local_quotes(spark, tmp_path):
    (tmp_path / "q ü.csv").write_text('"Дата","Цена","Откр.","Макс.","Мин.","Объём","Изм. %"\n"05.01.2024","1.234,50","1,0","2,0","0,5","1K","0,25%"\n"bad","1","1","1","1","1","1"\n', encoding="utf-8")
    rows = files.local_quotes(spark, str(tmp_path), {"q ü.csv": "Q"}).collect()
    assert [(r["instrument"], str(r["trade_date"]), r["close"], r["change_pct"]) for r in rows] == [("Q", "2024-01-05", 1234.5, 0.25)]


def test_wide_years_finds_the_header():
    t = pd.DataFrame([["title", None, None, None], [None, "1999", "2000 1)", "2001"], ["RF", "1 000,5", "x", "3"]])
    got = files.wide_years(t, "wage", "rub", "f")
    assert got[["period", "value"]].values.tolist() == [["1999", 1000.5], ["2001", 3.0]]


def test_archives_skip_loaded_years(spark, tmp_path):
    for name in ("acme_2020.zip", "acme.zip"):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            z.writestr("r.pdf", b"%PDF")
            z.writestr("r.txt", b"no")
    got = files.archive_members(spark, str(tmp_path))
    assert {(r["archive"], r["year"], r["filename"]) for r in got.collect()} == {("acme_2020.zip", 2020, "r.pdf"), ("acme.zip", 0, "r.pdf")}
    from pyspark.sql import functions as F

    loaded = spark.createDataFrame([("acme", 2020), ("acme", 0)], "company string, year int")
    left = files.without_loaded_years(got.withColumn("company", F.lit("acme")), loaded)
    assert [r["year"] for r in left.collect()] == [0]


def test_pdf_pages_take_an_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two")
    rows = files.pdf_pages(spark, str(tmp_path), lambda b: b.decode().split("|")).orderBy("page").collect()
    assert [(r["page"], r["text"]) for r in rows] == [(1, "one"), (2, "two")]


def test_json_lines_skip_bad_and_missing(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"n": 1}) + "\nbad\n")
    assert [r["n"] for r in files.json_lines(spark, str(tmp_path / "a.jsonl"), "n int").collect()] == [1]
    assert files.json_lines(spark, str(tmp_path / "no.jsonl"), "n int").count() == 0


def test_report_arrays():
    assert files.report_arrays("const data = {a: [1, 2,-3], b: [4]}", "b") == [4]


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "t")
    sinks.partition_refresh(spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int"), out, "k")
    sinks.partition_refresh(spark.createDataFrame([("a", 2)], "k string, v int"), out, "k")
    assert {(r["k"], r["v"]) for r in spark.read.parquet(out).collect()} == {("a", 2), ("b", 1)}
    cells = spark.createDataFrame([("s", 0.1), ("t", 0.9)], "source string, abs_corr double")
    sinks.ranked_csv(cells, str(tmp_path / "c"))
    assert [r["source"] for r in spark.read.option("header", True).csv(str(tmp_path / "c")).collect()] == ["t", "s"]
    sinks.audit_report(cells, cells, str(tmp_path / "r.md"))
    assert "| s | 0.1 |" in (tmp_path / "r.md").read_text()


def test_stream_loads_each_file_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in "sok")
    schema = "date string, text string"
    spark.createDataFrame([("2020-12-31", "old"), ("2021-01-01T10", "new"), (None, "none")], schema).write.parquet(src)
    rollup.load(spark, src, schema, out, ck).awaitTermination()
    rollup.load(spark, src, schema, out, ck).awaitTermination()
    assert [r["text"] for r in spark.read.parquet(out).collect()] == ["new"]


def test_stream_topics(spark, tmp_path):
    src = str(tmp_path / "a")
    spark.sql("SELECT timestamp'2024-01-01 10:00:00' AS ts, 'oil' AS text, 'u' AS url UNION ALL SELECT timestamp'2024-01-01 11:00:00', 'gold', 'u'").write.parquet(src)
    s = spark.readStream.schema("ts timestamp, text string, url string").parquet(src)
    q = rollup.topic_stream(s).writeStream.format("memory").queryName("topics_t").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("topics_t").first()
    assert (str(r["news_date"]), r["oil"], r["gold"]) == ("2024-01-01", 1, 1)
    q = rollup.first_articles(s).writeStream.format("memory").queryName("first_t").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first_t").count() == 1


def test_kept_tables_are_whole(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert sorted(map(tuple, shared.keep(df, "t").collect()), key=str) == [(1, None), (2, "x")]
    assert io and os
