"""The engine's input tables, made from the test tables, once as DataFrames and once as SQL.

market: daily mean order price by priority. indices: daily mean line price and quantity by flags. key_rate: monthly
discounts. articles: documents with a day. log: events as iterations of a user's session. chunks: embeddings.
Means of prices are summed in integer cents, so they do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.functions.stats import exact_avg
from lagloom.sources.shared import keep

TICKERS = {"AF": "af", "AO": "ao", "NF": "nf", "NO": "no", "RF": "rf", "RO": "ro"}
#: Milliseconds of the steps of an iteration, and characters of context, as remainders of the event's id.
STEPS = {"ms_rag": 101, "ms_news": 53, "ms_sql": 41, "ms_generate": 8009, "ms_evaluate": 5003, "context_news": 2003}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
LAGS6 = [0, 7, 14, 30, 60, 90]
#: Names that the quality suite expects; one of each is missing here and there.
EXPECTED = {"indices": ("ticker", ["AF", "NO", "XX"]), "forex": ("currency", ["F", "O"]), "market": ("instrument", ["1-URGENT", "2-HIGH", "9-NEVER"])}
#: Stems in a hypothesis and the terms that stand for them in the texts.
STEMS = {"oil": ["tion", "Ing "], "rate": ["heit", "shable"], "gold": ["ción"], "bank": ["menttre", "ble", "tion"]}
HYPOTHESIS = "Banking news lead the rate by 14 days"
TOPIC_WORDS = {"the": ["the", "The"], "tion": ["tion"], "ung": ["ung", "heit"], "que": ["que"], "cion": ["ción"], "ing": ["ing "], "eau": ["eau"]}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def market(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_orderpriority").alias("instrument"), "o_totalprice")
    return o.groupBy("trade_date", "instrument").agg(exact_avg("o_totalprice").alias("close"))


MARKET = """market AS (
  SELECT CAST(o_orderdate AS DATE) AS trade_date, o_orderpriority AS instrument,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(o_totalprice) AS DOUBLE) / 100.0 AS close
  FROM orders GROUP BY ALL)"""


def indices(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.col("l_shipdate").cast("date").alias("trade_date"), "l_extendedprice", "l_quantity")
    return li.groupBy("ticker", "trade_date").agg(exact_avg("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume"))


INDICES = """indices AS (
  SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS trade_date,
    CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(l_extendedprice) AS DOUBLE) / 100.0 AS close,
    sum(l_quantity) AS volume
  FROM lineitem GROUP BY ALL)"""


def lines(spark: SparkSession, d: str) -> DataFrame:
    """The sums by ticker and day from which ``indices`` and ``key_rate`` both follow: lineitem is read once for both."""
    li = table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.col("l_shipdate").cast("date").alias("trade_date"), "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    sums = [x for c in ("l_extendedprice", "l_discount", "l_tax") for x in (F.sum(F.round(F.col(c) * 100).cast("bigint")).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))]
    return keep(li.groupBy("ticker", "trade_date").agg(*sums, F.sum("l_quantity").alias("volume")), "lines")


def _mean(c: str, whole: bool = False) -> Column:
    total, n = (F.sum(f"sum_{c}"), F.sum(f"n_{c}")) if whole else (F.col(f"sum_{c}"), F.col(f"n_{c}"))
    return total.cast("double") / n.cast("double") / F.lit(100.0)


def indices_of(lines: DataFrame) -> DataFrame:
    return lines.select("ticker", "trade_date", _mean("l_extendedprice").alias("close"), "volume")


def key_rate_of(lines: DataFrame) -> DataFrame:
    months = lines.groupBy(F.trunc("trade_date", "month").alias("month")).agg(F.min("trade_date").alias("day"), (_mean("l_discount", True) * 100).alias("rate_pct"), (_mean("l_tax", True) * 100).alias("inflation"))
    return months.select(_period("day"), "rate_pct", "inflation")


def key_rate(spark: SparkSession, d: str) -> DataFrame:
    months = table(spark, d, "lineitem").groupBy(F.trunc("l_shipdate", "month").alias("month")).agg(F.min("l_shipdate").alias("day"), (exact_avg("l_discount") * 100).alias("rate_pct"), (exact_avg("l_tax") * 100).alias("inflation"))
    return months.select(_period("day"), "rate_pct", "inflation")


def _period(day: str) -> Column:
    """'M.YYYY', of a day that is an aggregate: what filters on the text say is not pushed below the grouping by month,
    where every line would be formatted and parsed."""
    return F.concat(F.month(day).cast("string"), F.lit("."), F.year(day).cast("string")).alias("period")


KEY_RATE = """key_rate AS (
  SELECT CAST(month(l_shipdate) AS VARCHAR) || '.' || CAST(year(l_shipdate) AS VARCHAR) AS period,
    CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS DOUBLE) / CAST(count(l_discount) AS DOUBLE) / 100.0 * 100 AS rate_pct,
    CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS DOUBLE) / CAST(count(l_tax) AS DOUBLE) / 100.0 * 100 AS inflation
  FROM lineitem GROUP BY ALL)"""

RATES = (
    KEY_RATE
    + """, rates AS (
  SELECT make_date(TRY_CAST(split_part(period, '.', 2) AS INTEGER), TRY_CAST(split_part(period, '.', 1) AS INTEGER), 1) AS period_date, rate_pct, inflation
  FROM key_rate WHERE period LIKE '%.____' AND TRY_CAST(split_part(period, '.', 1) AS INTEGER) BETWEEN 1 AND 12
    AND TRY_CAST(split_part(period, '.', 2) AS INTEGER) > 1990)"""
)


def forex(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("trade_date"), F.col("o_orderstatus").alias("currency"), "o_totalprice")
    return o.groupBy("trade_date", "currency").agg(exact_avg("o_totalprice").alias("rate"), F.lit(1).alias("nominal"))


FOREX = """forex AS (
  SELECT CAST(o_orderdate AS DATE) AS trade_date, o_orderstatus AS currency,
    CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(o_totalprice) AS DOUBLE) / 100.0 AS rate, 1 AS nominal
  FROM orders GROUP BY 1, 2)"""


def articles(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("doc_id") % 2399).cast("int"))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), day.alias("date"), "text", "source", "lang")


ARTICLES = """articles AS (
  SELECT doc_id AS id, DATE '1995-01-01' + CAST(doc_id % 2399 AS INTEGER) AS date, text, source, lang FROM documents)"""


def log(spark: SparkSession, d: str) -> DataFrame:
    """Iterations: confirmed by type of event, score by value, lag and attempts by a property, statements as text."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select("event_id", F.col("user_id").alias("session"), "event_type", "value", F.coalesce(k, F.lit(0)).alias("k"))
    order = Window.partitionBy("session").orderBy("event_id")
    lag = F.element_at(F.array(*map(F.lit, LAGS6)), (F.col("k") % 6 + 1).cast("int"))
    t = F.col("event_type")
    e = e.select(
        "event_id", "session", "event_type", "k",
        F.row_number().over(order).cast("int").alias("iteration"),
        (F.floor("value") % 101).cast("int").alias("score"),
        F.when(t.isin("purchase", "signup"), True).when(t == "error", False).alias("confirmed"),
        lag.alias("lag"), (F.col("k") % 3 + 1).cast("int").alias("attempts"),
        (F.col("k") * 100 + 7).cast("bigint").alias("tokens"), (F.col("k") * 90).cast("bigint").alias("tokens_in"), (F.col("k") * 10 + 7).cast("bigint").alias("tokens_out"),
        (F.col("event_id") % 977).cast("int").alias("ms"), (F.col("event_id") % 4001).cast("int").alias("context"),
        *[(F.col("event_id") % n).cast("int").alias(name) for name, n in STEPS.items()],
    )
    column = F.element_at(F.array(*map(F.lit, ["usd_rub", "eur_rub", "brent_usd", "close"])), (F.col("k") % 4 + 1).cast("int"))
    target = F.element_at(F.array(*map(F.lit, ["dxy", "silver", "price"])), (F.col("k") % 3 + 1).cast("int"))
    where = F.element_at(F.array(F.lit(""), F.lit(" WHERE key_rate_pct < 15"), F.lit(" WHERE key_rate_pct < 15 OR key_rate_pct > 20"), F.lit(" WHERE eur_rub > 80"), F.lit(" AND rugold IS NOT NULL")), (F.col("k") % 5 + 1).cast("int"))
    hypothesis = F.concat(F.lit("Lag "), F.col("lag").cast("string"), F.lit(" from "), F.col("event_type"), F.lit(" to sector "), (F.col("k") % 7).cast("string"))
    errors = ["", "Binder Error: Referenced column x", "Conversion Error: a", "Parser Error: near b", "Catalog Error: c", "WHERE clause cannot contain window functions!", "Binder Error: d", "disk full"]
    message = lambda shift: F.element_at(F.array(*map(F.lit, errors)), ((F.col("k") + shift) % 8 + 1).cast("int"))
    return e.withColumns({"hypothesis": hypothesis, "sql": F.concat(F.lit("SELECT "), column, F.lit(" AS "), target, F.lit(" FROM ctx"), where), "error_1": F.when(F.col("attempts") > 1, message(0)), "error_2": F.when(F.col("attempts") > 2, message(3)), "error_3": F.when((F.col("attempts") > 2) & (F.col("k") % 5 == 0), message(5))})


LOG = """log0 AS (
  SELECT event_id, user_id AS session, event_type, value, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER), 0) AS k FROM events
), log1 AS (
  SELECT event_id, session, event_type, k, CAST(row_number() OVER (PARTITION BY session ORDER BY event_id) AS INTEGER) AS iteration,
    CAST(CAST(floor(value) AS BIGINT) % 101 AS INTEGER) AS score,
    CASE WHEN event_type IN ('purchase', 'signup') THEN true WHEN event_type = 'error' THEN false END AS confirmed,
    [0, 7, 14, 30, 60, 90][k % 6 + 1] AS lag, k % 3 + 1 AS attempts,
    CAST(k * 100 + 7 AS BIGINT) AS tokens, CAST(k * 90 AS BIGINT) AS tokens_in, CAST(k * 10 + 7 AS BIGINT) AS tokens_out,
    CAST(event_id % 977 AS INTEGER) AS ms, CAST(event_id % 4001 AS INTEGER) AS context,
    """ + ", ".join(f"CAST(event_id % {n} AS INTEGER) AS {name}" for name, n in STEPS.items()) + """
  FROM log0
), log AS (
  SELECT *, 'Lag ' || lag || ' from ' || event_type || ' to sector ' || (k % 7) AS hypothesis,
    'SELECT ' || ['usd_rub', 'eur_rub', 'brent_usd', 'close'][k % 4 + 1] || ' AS ' || ['dxy', 'silver', 'price'][k % 3 + 1] || ' FROM ctx' ||
      ['', ' WHERE key_rate_pct < 15', ' WHERE key_rate_pct < 15 OR key_rate_pct > 20', ' WHERE eur_rub > 80', ' AND rugold IS NOT NULL'][k % 5 + 1] AS sql,
    CASE WHEN attempts > 1 THEN ['', 'Binder Error: Referenced column x', 'Conversion Error: a', 'Parser Error: near b', 'Catalog Error: c', 'WHERE clause cannot contain window functions!', 'Binder Error: d', 'disk full'][k % 8 + 1] END AS error_1,
    CASE WHEN attempts > 2 THEN ['', 'Binder Error: Referenced column x', 'Conversion Error: a', 'Parser Error: near b', 'Catalog Error: c', 'WHERE clause cannot contain window functions!', 'Binder Error: d', 'disk full'][(k + 3) % 8 + 1] END AS error_2,
    CASE WHEN attempts > 2 AND k % 5 = 0 THEN ['', 'Binder Error: Referenced column x', 'Conversion Error: a', 'Parser Error: near b', 'Catalog Error: c', 'WHERE clause cannot contain window functions!', 'Binder Error: d', 'disk full'][(k + 5) % 8 + 1] END AS error_3
  FROM log1)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings")
    return v.select(
        F.col("vec_id").alias("id"), (F.col("vec_id") % 2).alias("collection"), F.concat(F.lit("company"), F.col("label").cast("string")).alias("company"),
        (F.lit(2015) + F.col("vec_id") % 10).cast("int").alias("year"), F.concat(F.lit("f"), (F.col("vec_id") % 3).cast("string")).alias("filename"), (F.col("vec_id") % 7).cast("int").alias("page"), "embedding",
    )


CHUNKS = """chunks AS (
  SELECT vec_id AS id, vec_id % 2 AS collection, 'company' || label AS company, CAST(2015 + vec_id % 10 AS INTEGER) AS year,
    'f' || (vec_id % 3) AS filename, CAST(vec_id % 7 AS INTEGER) AS page, embedding FROM embeddings)"""


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector asked for, one row."""
    row = table(spark, d, "embeddings").filter("vec_id = 0").select("embedding").first()
    return list(row["embedding"]) if row else [0.0]
