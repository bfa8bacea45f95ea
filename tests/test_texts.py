import hashlib

from pyspark.sql import functions as F

from lagloom.functions import text as X
from lagloom.operators import texts


def test_chunks_by_length(spark):
    want = {0: 0, 50: 0, 51: 1, 700: 1, 701: 1, 900: 2, 1000: 2}
    df = spark.createDataFrame([(n, "x" * n) for n in want] + [(-1, None)], "n int, text string")
    got = {r["n"]: r["k"] for r in df.select("n", F.size(X.chunks(F.col("text"))).alias("k")).collect()}
    assert {n: got[n] for n in want} == want


def test_chunk_ids_are_numbered_after_the_drop(spark):
    df = spark.createDataFrame([("f", " " * 900 + "y" * 700)], "file string, text string")
    rows = texts.chunk_rows(df, ["file"]).orderBy("chunk").collect()
    assert [r["chunk"] for r in rows] == [0, 1]
    assert rows[0]["id"] == hashlib.md5(b"f_0").hexdigest()


def test_fingerprint_hides_numbers(spark):
    df = spark.createDataFrame([("Lag 7 of oil",), ("Lag 14 of oil",)], "h string")
    assert df.select(X.hypothesis_fingerprint(F.col("h")).alias("f")).distinct().count() == 1


def test_dirty_values(spark):
    df = spark.createDataFrame([("3.2026", "1.234,5", "1,5K"), ("13.2026", "-0,25%", "2M"), ("2026", "x", "x"), ("x.y", None, None), ("10.202", "7\xa0000", "3B")], "p string, n string, v string")
    rows = df.select(X.month_period(F.col("p")).cast("string").alias("p"), X.local_number(F.col("n")).alias("n"), X.volume_number(F.col("v")).alias("v")).collect()
    assert [r["p"] for r in rows] == ["2026-03-01", None, None, None, None]
    assert [r["n"] for r in rows] == [1234.5, -0.25, None, None, 7000.0]
    assert [r["v"] for r in rows] == [1500.0, 2e6, None, None, 3e9]


def test_first_error_class_wins(spark):
    df = spark.createDataFrame([("Binder Error: Referenced column x",), ("binder error: y",), ("disk full",)], "m string")
    assert [r["c"] for r in df.select(X.error_class(F.col("m")).alias("c")).collect()] == ["schema_column", "binder", "unknown"]


def test_context_keeps_one_hit_a_page_and_drops_far_ones(spark):
    rows = [(1, 0, "acme", 2020, "f", 1, [1.0, 0.0]), (2, 0, "acme", 2020, "f", 1, [0.9, 0.1]), (3, 1, "acme", 2020, "g", 2, [0.15, 1.0]), (4, 1, "acme", 2020, "g", 3, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, collection int, company string, year int, filename string, page int, embedding array<double>")
    got = texts.context(df, [1.0, 0.0]).collect()
    assert [(r["id"], r["label"]) for r in got] == [(1, "[Acme 2020, p.1]")]


def test_topics_and_keywords(spark):
    df = spark.createDataFrame([("2024-01-01", "Brent oil"), ("2024-01-01", "OIL"), ("2024-01-02", None)], "date string, text string")
    got = {str(r["news_date"]): (r["oil"], r["gold"]) for r in texts.topic_counts(df).collect()}
    assert got == {"2024-01-01": (1, 0), "2024-01-02": (0, 0)}
    assert [r["matched_kw"] for r in texts.keyword_articles(df, ["oil", "BRENT"]).orderBy("text").collect()] == ["oil, BRENT", "oil"]
    assert texts.search_terms("Рост нефти и рубля") == ["oil", "Brent", "ruble", "RUB"]
    assert texts.search_terms("none") == ["Russia", "financial market", "economy"]


def test_keyword_stream_and_regions(spark):
    df = spark.createDataFrame([("OIL " + "x" * 60,), ("oil",), ("gold " * 20,)], "text string")
    assert [r["document"][:3] for r in texts.keyword_stream(df, ["oil"]).collect()] == ["OIL"]
    m = spark.createDataFrame([(" A  b", 1), ("Total", 2), ("c", 3)], "region string, v int")
    assert sorted(map(tuple, texts.regions(m, {"A b": "AB"}, ["Total"]).collect())) == [("AB", 1), ("c", 3)]
