"""Quality, table, text and retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from lagloom.functions import text as X
from lagloom.functions.stats import r4
from lagloom.operators import quality, tables, texts, vectors
from lagloom.plans import stand_ins as T
from lagloom.plans.registry import query
from lagloom.sources import files
from lagloom.sources.shared import new_path


@query("""SELECT "column", n_null, (SELECT count(*) FROM documents) AS n_rows FROM (
  SELECT 'text' AS "column", count(*) FILTER (text IS NULL) AS n_null FROM documents UNION ALL
  SELECT 'lang', count(*) FILTER (lang IS NULL) FROM documents UNION ALL SELECT 'source', count(*) FILTER (source IS NULL) FROM documents)""")
def null_profile(spark, d):
    return quality.null_profile(T.table(spark, d, "documents"), ["text", "lang", "source"])


@query(f"WITH {T.INDICES} SELECT ticker, count(*) AS n, min(trade_date) AS first, max(trade_date) AS last FROM indices GROUP BY ticker")
def group_profile(spark, d):
    return quality.group_profile(T.indices(spark, d), "ticker", "trade_date")


@query("SELECT l_orderkey, l_linenumber, count(*) AS c FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return quality.duplicate_keys(T.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT k AS o_orderpriority FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('9-NEVER')) t(k) WHERE k NOT IN (SELECT o_orderpriority FROM orders)")
def missing_keys(spark, d):
    return tables.missing_keys(T.table(spark, d, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "9-NEVER"])


@query("SELECT count(*) FILTER (l_quantity <= 0) AS not_positive, count(*) FILTER (l_discount < 0 OR l_discount > 0.05) AS out_of_range, count(*) FILTER (abs(l_tax - 0.04) < 0.001) AS at_value FROM lineitem")
def range_violations(spark, d):
    li = T.table(spark, d, "lineitem")
    return li.agg(F.count_if(F.col("l_quantity") <= 0).alias("not_positive"), F.count_if((F.col("l_discount") < 0) | (F.col("l_discount") > 0.05)).alias("out_of_range"), F.count_if(F.abs(F.col("l_tax") - 0.04) < 0.001).alias("at_value"))


@query(f"""WITH {T.MARKET}, per AS (SELECT instrument, count(*) AS n FROM market GROUP BY 1)
SELECT 'market' AS "table", "check", CAST(bad AS BIGINT) AS bad FROM (
  SELECT 'null close' AS "check", count(*) FILTER (close IS NULL) AS bad FROM market UNION ALL
  SELECT 'close <= 0', count(*) FILTER (close <= 0) FROM market UNION ALL
  SELECT 'before 1990', count(*) FILTER (trade_date < DATE '1990-01-01') FROM market UNION ALL
  SELECT 'rows >= 1000', CASE WHEN count(*) < 1000 THEN 1 ELSE 0 END FROM market UNION ALL
  SELECT 'unique trade_date, instrument', count(*) FROM (SELECT trade_date, instrument FROM market GROUP BY ALL HAVING count(*) > 1) UNION ALL
  SELECT 'expected instrument', 3 - count(*) FROM per WHERE instrument IN ('1-URGENT', '2-HIGH', '9-NEVER') UNION ALL
  SELECT 'rows per instrument', count(*) FILTER (n < 100) FROM per)""")
def quality_report(spark, d):
    checks = quality.Checks(
        "market", ["close"], {"close <= 0": F.col("close") <= 0, "before 1990": F.col("trade_date") < F.lit("1990-01-01").cast("date")},
        ["trade_date", "instrument"], 1000, ("instrument", ["1-URGENT", "2-HIGH", "9-NEVER"]), ("instrument", 100),
    )
    return quality.run_checks(T.market(spark, d), checks)


_SUITE = {
    "indices": [("null close", "close IS NULL"), ("close < 0", "close < 0")],
    "key_rate": [("null rate_pct", "rate_pct IS NULL"), ("null inflation", "inflation IS NULL"), ("rate out of 0 to 100", "rate_pct < 0 OR rate_pct > 100")],
    "forex": [("null rate", "rate IS NULL"), ("rate <= 0", "rate <= 0")],
    "market": [("null close", "close IS NULL"), ("close <= 0", "close <= 0")],
}
_SUITE_SQL = " UNION ALL ".join(
    [f"SELECT '{t}' AS \"table\", '{k}' AS \"check\", count(*) FILTER ({c}) AS bad FROM {t}" for t, cs in _SUITE.items() for k, c in cs]
    + [f"SELECT '{t}', 'rows >= {n}', CASE WHEN count(*) < {n} THEN 1 ELSE 0 END FROM {t}" for t, n in (("indices", 1), ("key_rate", 101), ("forex", 501), ("market", 1001))]
    + [f"SELECT '{t}', 'unique {', '.join(ks)}', count(*) FROM (SELECT {', '.join(ks)} FROM {t} GROUP BY ALL HAVING count(*) > 1)" for t, ks in (("indices", ["ticker", "trade_date"]), ("forex", ["trade_date", "currency"]), ("market", ["trade_date", "instrument"]))]
    + [f"SELECT '{t}', 'expected {k}', {len(v)} - count(DISTINCT {k}) FROM {t} WHERE {k} IN ({', '.join(repr(x) for x in v)})" for t, (k, v) in T.EXPECTED.items()]
    + ["SELECT 'market', 'rows per instrument', count(*) FILTER (n < 100) FROM (SELECT instrument, count(*) AS n FROM market GROUP BY 1)"]
    + ["SELECT 'indices', 'first trade_date', CASE WHEN min(trade_date) >= DATE '2010-01-01' THEN 0 ELSE 1 END FROM indices", "SELECT 'indices', 'last trade_date', CASE WHEN max(trade_date) >= DATE '2020-01-01' THEN 0 ELSE 1 END FROM indices"]
)


@query(f"WITH {T.MARKET}, {T.INDICES}, {T.KEY_RATE}, {T.FOREX} {_SUITE_SQL}")
def quality_suite(spark, d):
    lines = T.lines(spark, d)
    return quality.suite({"indices": T.indices_of(lines), "key_rate": T.key_rate_of(lines), "forex": T.forex(spark, d), "market": T.market(spark, d)}, T.EXPECTED)


_ROW = "l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"
_PK = ["l_orderkey", "l_linenumber"]


def _order():
    return [F.col(c.strip()) for c in _ROW.split(",")]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {_ROW}) = 1")
def insert_or_ignore_dedupe(spark, d):
    return tables.first_by_key(T.table(spark, d, "lineitem"), _PK, _order()).select(*_PK, "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c.strip() + ' DESC' for c in _ROW.split(','))}) = 1")
def upsert_latest(spark, d):
    return tables.last_by_key(T.table(spark, d, "lineitem"), _PK, _order()).select(*_PK, "l_partkey", "l_suppkey", "l_extendedprice")


@query("""WITH old AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 6000), new AS (SELECT c_custkey, c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_acctbal >= 2000)
SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new) UNION ALL SELECT * FROM new""")
def merge_upsert(spark, d):
    c = T.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return tables.upsert(c.filter("c_acctbal < 6000"), c.filter("c_acctbal >= 2000").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"], [F.col("c_name")])


@query("""WITH old AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 6000), new AS (SELECT c_custkey, c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_acctbal >= 2000)
SELECT * FROM old UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)""")
def merge_insert_or_ignore(spark, d):
    c = T.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    return tables.insert_or_ignore(c.filter("c_acctbal < 6000"), c.filter("c_acctbal >= 2000").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"], [F.col("c_name")])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def left_anti_skip(spark, d):
    progress = T.table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "done").alias("status"))
    return tables.skip_done(T.table(spark, d, "documents").select("doc_id", "source"), progress, "doc_id")


@query("""WITH w AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS quantity, CAST(count(*) AS DOUBLE) AS "lines", max(l_extendedprice) AS top FROM lineitem GROUP BY 1)
UNPIVOT w ON quantity, "lines", top INTO NAME indicator VALUE value""")
def unpivot_indicators(spark, d):
    w = T.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("quantity"), F.count("*").cast("double").alias("lines"), F.max("l_extendedprice").alias("top"))
    return tables.unpivot(w, ["year"], ["quantity", "lines", "top"], "indicator", "value")


@query("SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'EUR' WHEN 'GERMANY' THEN 'EUR' WHEN 'JAPAN' THEN 'JPY' ELSE n_name END AS currency FROM nation")
def currency_map_lookup(spark, d):
    return T.table(spark, d, "nation").select("n_nationkey", tables.map_names(T.table(spark, d, "nation"), "n_name", {"FRANCE": "EUR", "GERMANY": "EUR", "JAPAN": "JPY"}).alias("currency"))


@query("""SELECT o_orderkey, o_totalprice AS value, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey AS DOUBLE) END AS share, CASE o_orderkey % 4 WHEN 1 THEN 1500.0 WHEN 2 THEN 2500000.0 WHEN 3 THEN 3e9 ELSE 7.0 END AS volume FROM orders""")
def dirty_number_parse(spark, d):
    """Local number forms are written from clean values and read back."""
    o = T.table(spark, d, "orders")
    local = F.translate(F.format_number("o_totalprice", 2), ",.", ".,")
    share = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit(",0%")))
    volume = F.element_at(F.array(F.lit("7"), F.lit("1,5K"), F.lit("2,5M"), F.lit("3B")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", X.local_number(local).alias("value"), X.local_number(share).alias("share"), X.volume_number(volume).alias("volume"))


@query("""SELECT p, CASE WHEN p LIKE '%.____' AND TRY_CAST(split_part(p, '.', 1) AS INTEGER) BETWEEN 1 AND 12 AND TRY_CAST(split_part(p, '.', 2) AS INTEGER) > 1990
  THEN make_date(TRY_CAST(split_part(p, '.', 2) AS INTEGER), TRY_CAST(split_part(p, '.', 1) AS INTEGER), 1) END AS day
FROM (SELECT DISTINCT CASE o_orderkey % 5 WHEN 0 THEN month(o_orderdate) || '.' || year(o_orderdate) WHEN 1 THEN '13.' || year(o_orderdate) WHEN 2 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 3 THEN 'x.y' ELSE '10.202' END AS p FROM orders)""")
def period_parse(spark, d):
    o = T.table(spark, d, "orders")
    y, m, k = F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"), F.col("o_orderkey") % 5
    p = F.when(k == 0, F.concat_ws(".", m, y)).when(k == 1, F.concat(F.lit("13."), y)).when(k == 2, y).when(k == 3, "x.y").otherwise("10.202")
    return o.select(p.alias("p")).distinct().withColumn("day", X.month_period(F.col("p")))


_TOPICS = ", ".join("CAST(count(CASE WHEN " + " OR ".join(f"contains(text, '{w}')" for w in ws) + f" THEN 1 END) AS INTEGER) AS \"{k}\"" for k, ws in T.TOPIC_WORDS.items())


@query(f"WITH {T.ARTICLES} SELECT date AS news_date, {_TOPICS} FROM articles GROUP BY date")
def topic_daily_counts(spark, d):
    return texts.topic_counts(T.articles(spark, d), T.TOPIC_WORDS)


@query(f"WITH {T.ARTICLES}, daily AS (SELECT date AS news_date, {_TOPICS} FROM articles GROUP BY date) SELECT count(*) AS days, min(news_date) AS first, max(news_date) AS last, " + ", ".join(f'CAST(sum("{k}") AS BIGINT) AS "{k}"' for k in T.TOPIC_WORDS) + " FROM daily")
def topic_totals(spark, d):
    daily = texts.topic_counts(T.articles(spark, d), T.TOPIC_WORDS)
    return daily.agg(F.count("*").alias("days"), F.min("news_date").alias("first"), F.max("news_date").alias("last"), *[F.sum(k).alias(k) for k in T.TOPIC_WORDS])


_WORDS = ["Zukeit", "shable", "menttre", "ciónra", "THEREAOU"]
_LISTED = ", ".join(f"'{w}'" for w in _WORDS)


@query(f"WITH {T.ARTICLES} SELECT id, array_to_string(list_filter([{_LISTED}], lambda k: contains(lower(text), lower(k))), ', ') AS matched_kw FROM articles WHERE len(list_filter([{_LISTED}], lambda k: contains(lower(text), lower(k)))) > 0")
def keyword_match(spark, d):
    return texts.keyword_articles(T.articles(spark, d), _WORDS).select("id", "matched_kw")


_TERMS = ["shable", "menttre", "ble", "heit", "ción"]
_SCORE = " + ".join(f"CAST(contains(lower(text), '{k}') AS INTEGER)" for k in _TERMS)


@query(f"WITH {T.ARTICLES} SELECT id, date, {_SCORE} AS score, trim(replace(text[1:280], chr(10), ' ')) AS excerpt FROM articles WHERE " + " OR ".join(f"contains(lower(text), '{k}')" for k in _TERMS[:3]) + " ORDER BY score DESC, date, id LIMIT 5")
def keyword_rerank_topk(spark, d):
    return texts.rerank(T.articles(spark, d), _TERMS)


_FOUND = list(dict.fromkeys(t for stem, words in T.STEMS.items() if stem in T.HYPOTHESIS.lower() for t in words))[:6]
_FOUND_SCORE = " + ".join(f"CAST(contains(lower(text), '{k.lower()}') AS INTEGER)" for k in _FOUND)


@query(f"WITH {T.ARTICLES} SELECT id, date, {_FOUND_SCORE} AS score, '[' || strftime(date, '%Y-%m-%d') || '] ' || trim(replace(text[1:280], chr(10), ' ')) || '…' AS block FROM articles WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-06-30' AND (" + " OR ".join(f"contains(lower(text), '{k.lower()}')" for k in _FOUND[:3]) + ") ORDER BY score DESC, date, id LIMIT 5")
def news_context(spark, d):
    return texts.news_context(T.articles(spark, d), T.HYPOTHESIS, "1996-01-01", "1998-06-30", stems=T.STEMS)


_CUT = r"list_filter(list_transform(CASE WHEN length(text) > 0 THEN range(0, length(text), 700) ELSE [] END, lambda s: regexp_replace(text[s + 1 : s + 900], '^\s+|\s+$', '', 'g')), lambda c: length(c) > 50)"


@query(f"WITH c AS (SELECT doc_id, {_CUT} AS cs FROM documents) SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS chunk, md5(unnest(cs)) AS document FROM c")
def chunk_text(spark, d):
    return texts.chunk_rows(T.table(spark, d, "documents"), ["doc_id"]).select("doc_id", "chunk", F.md5(F.col("document").cast("binary")).alias("document"))


@query(f"WITH c AS (SELECT doc_id, source, {_CUT} AS cs FROM documents), e AS (SELECT doc_id, source, generate_subscripts(cs, 1) - 1 AS chunk FROM c) SELECT source, doc_id, CAST(chunk AS INTEGER) AS chunk, md5(source || '_' || doc_id || '_' || chunk) AS id FROM e")
def chunk_ids(spark, d):
    return texts.chunk_rows(T.table(spark, d, "documents"), ["source", "doc_id"]).select("source", "doc_id", "chunk", "id")


@query("""WITH a AS (SELECT doc_id, text[1:1000] AS document FROM documents WHERE length(text[1:1000]) >= 50)
SELECT md5(document[1:200]) AS id, max(doc_id) AS doc_id, count(*) AS n FROM a GROUP BY 1""")
def article_dedupe(spark, d):
    rows = texts.article_ids(T.table(spark, d, "documents").select("doc_id", "text"))
    return rows.groupBy("id").agg(F.max("doc_id").alias("doc_id"), F.count("*").alias("n"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text[1:300]), 'heit') OR contains(lower(text[1:300]), 'keit') THEN 'german' WHEN contains(lower(text[1:300]), 'ción') THEN 'spanish' ELSE 'general' END AS section FROM documents""")
def section_detection(spark, d):
    return T.table(spark, d, "documents").select("doc_id", texts.section(F.col("text"), {"german": ["heit", "keit"], "spanish": ["ción"]}).alias("section"))


@query(r"""WITH c AS (SELECT page_id, url, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS clean FROM pages),
t AS (SELECT page_id, url, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title,
  array_to_string(list_transform(regexp_extract_all(clean, '(?is)<p[^>]*>(.*?)</p>', 1), lambda p: trim(regexp_replace(regexp_replace(p, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))), chr(10)) AS text FROM c)
SELECT page_id, url, title, length(text) AS n_chars, md5(text) AS text_md5 FROM t WHERE title <> '' AND length(text) > 100""")
def html_articles(spark, d):
    a = files.html_articles(T.table(spark, d, "pages"))
    return a.select("page_id", "url", "title", F.length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


_DIST = "1 - list_inner_product(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) / (sqrt(list_inner_product(CAST(c.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))"
_NEAR = f"WITH {T.CHUNKS}, h AS (SELECT c.*, {_DIST} AS distance FROM chunks c, chunks q WHERE q.id = 0)"


@query(f"{_NEAR} SELECT id, company, round(distance, 6) + 0.0 AS distance FROM h ORDER BY h.distance, id LIMIT 10")
def vector_topk(spark, d):
    return texts.nearest(T.chunks(spark, d), T.query_vector(spark, d), 10).select("id", "company", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query(f"{_NEAR} SELECT id, company, year, round(distance, 6) + 0.0 AS distance FROM h WHERE year BETWEEN 2017 AND 2019 AND company = 'company3' ORDER BY h.distance, id LIMIT 5")
def vector_topk_filtered(spark, d):
    where = F.col("year").between(2017, 2019) & (F.lower("company") == "company3")
    return texts.nearest(T.chunks(spark, d), T.query_vector(spark, d), 5, where).select("id", "company", "year", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


def _index(spark, d):
    return vectors.build(T.chunks(spark, d), new_path(spark, "index"), ["collection", "year"])


_ASKED = f"WITH {T.CHUNKS}, h AS (SELECT q.id AS query_id, c.id, c.company, c.year, {_DIST} AS distance FROM chunks c, (SELECT * FROM chunks WHERE id % 20 = 0) q)"


@query(f"{_ASKED} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, round(distance, 6) + 0.0 AS distance FROM h QUALIFY rank <= 10")
def vector_index_topk(spark, d):
    """An index of all chunks, and the nearest ten of every twentieth, exact: lists are read until no other can hold a nearer one."""
    queries = T.chunks(spark, d).filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    return _index(spark, d).search(queries, 10, exact=True).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query(f"{_ASKED} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank, id, round(distance, 6) + 0.0 AS distance FROM h WHERE year BETWEEN 2017 AND 2019 AND company = 'company3' QUALIFY rank <= 5")
def vector_index_filtered(spark, d):
    """The same under a filter on the metadata: years are partitions, of which others are not read."""
    queries = T.chunks(spark, d).filter("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    where = F.col("year").between(2017, 2019) & (F.lower("company") == "company3")
    return _index(spark, d).search(queries, 5, where, exact=True).withColumn("distance", F.round("distance", 6) + F.lit(0.0))


@query(f"""{_NEAR}, k AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY collection ORDER BY distance, id) <= 4),
p AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY collection, company, filename, page ORDER BY distance, id) = 1),
t AS (SELECT * FROM p ORDER BY distance, id LIMIT 8)
SELECT id, '[' || upper(company[1]) || company[2:] || ' ' || year || ', p.' || page || ']' AS label, round(distance, 6) + 0.0 AS distance FROM t WHERE t.distance < 0.8""")
def rag_context(spark, d):
    return texts.context(T.chunks(spark, d), T.query_vector(spark, d)).select("id", "label", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k_sum, count(*) AS n, round(avg(CAST(json_extract_string(props, '$.k') AS INTEGER)), 4) + 0.0 AS k_mean FROM events GROUP BY 1")
def json_props_stats(spark, d):
    e = T.table(spark, d, "events").withColumn("k", F.from_json("props", "k int").getField("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k_sum"), F.count("*").alias("n"), r4(F.avg("k")).alias("k_mean"))


@query(f"""WITH {T.ARTICLES}, e AS (SELECT unnest(string_split(array_to_string(list_filter([{_LISTED}], lambda k: contains(lower(text), lower(k))), ', '), ', ')) AS keyword FROM articles) SELECT keyword, count(*) AS n FROM e WHERE keyword <> '' GROUP BY 1""")
def keyword_value_counts(spark, d):
    rows = texts.keyword_articles(T.articles(spark, d), _WORDS)
    return rows.select(F.explode(F.split("matched_kw", ", ")).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))
