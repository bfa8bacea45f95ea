"""Signal and view queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.operators import signals as S
from lagloom.operators import selection, texts, views
from lagloom.plans import stand_ins as T
from lagloom.plans.registry import query
from lagloom.sources.shared import keep

_SRC = "src AS (SELECT trade_date AS day, close AS x FROM market WHERE instrument = '1-URGENT')"
_TGT = "tgt AS (SELECT trade_date AS day, close AS y FROM indices WHERE ticker = 'NO')"
_BASE = f"WITH {T.MARKET}, {T.INDICES}, {_SRC}, {_TGT}"
_CORR = "CASE WHEN isnan(corr(x, y)) THEN NULL ELSE round(corr(x, y), 4) + 0.0 END"


def lags_sql(lags: list[int]) -> str:
    return "(VALUES " + ", ".join(f"({n})" for n in lags) + ") AS l(lag_days)"


def _source(spark: SparkSession, d: str) -> DataFrame:
    return T.market(spark, d).filter("instrument = '1-URGENT'").select(F.col("trade_date").alias("day"), F.col("close").alias("x"))


def _target(spark: SparkSession, d: str) -> DataFrame:
    return T.indices(spark, d).filter("ticker = 'NO'").select(F.col("trade_date").alias("day"), F.col("close").alias("y"))


@query(f"{_BASE} SELECT 14 AS lag_days, {_CORR} AS correlation, count(*) AS n FROM src JOIN tgt ON tgt.day = src.day + 14")
def lag_correlation(spark, d):
    return S.lag_correlation(_source(spark, d), _target(spark, d), [14])


@query(f"{_BASE} SELECT lag_days, {_CORR} AS correlation, count(*) AS n FROM src CROSS JOIN {lags_sql(T.LAGS6)} JOIN tgt ON tgt.day = src.day + lag_days GROUP BY lag_days")
def lag_sweep_correlation(spark, d):
    return S.lag_correlation(_source(spark, d), _target(spark, d), T.LAGS6)


_DRIVER = "drv AS (SELECT trade_date AS day, close AS z FROM market WHERE instrument = '2-HIGH')"
_RATE_LABEL = "CASE WHEN rate_pct > 5 THEN 'high_rate' ELSE 'low_rate' END"
_Z_LABEL = "CASE WHEN z > 150000 THEN 'above' ELSE 'below' END"


def _driven(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The source's days with the day's driver and the month's rate, and the target; each table is read once."""
    both = views.wide(T.market(spark, d), {"x": "1-URGENT", "z": "2-HIGH"}).filter("has_x").withColumnRenamed("trade_date", "day")
    lines = T.lines(spark, d)
    rates = views.key_rate_daily(T.key_rate_of(lines)).select(F.col("period_date").alias("month"), "rate_pct")
    driven = both.join(rates, F.trunc("day", "month") == F.col("month"), "left").select("day", "x", S.regime(F.col("z"), 150000, "above", "below").alias("regime"), S.regime(F.col("rate_pct"), 5, "high_rate", "low_rate").alias("rate_regime"))
    return driven, T.indices_of(lines).filter("ticker = 'NO'").select(F.col("trade_date").alias("day"), F.col("close").alias("y"))


_DRIVEN = f"{_BASE}, {T.RATES}, {_DRIVER}, driven AS (SELECT src.day, x, {_Z_LABEL} AS regime, {_RATE_LABEL} AS rate_regime FROM src LEFT JOIN drv USING (day) LEFT JOIN rates ON date_trunc('month', src.day) = period_date)"


@query(f"{_DRIVEN} SELECT 14 AS lag_days, regime, {_CORR} AS correlation, count(*) AS n FROM driven JOIN tgt ON tgt.day = driven.day + 14 GROUP BY regime")
def regime_correlation(spark, d):
    return S.lag_correlation(*_driven(spark, d), [14], ("regime",))


@query(f"{_DRIVEN} SELECT lag_days, regime, {_CORR} AS correlation, count(*) AS n FROM driven CROSS JOIN {lags_sql([0, 14, 30])} JOIN tgt ON tgt.day = driven.day + lag_days GROUP BY lag_days, regime")
def lag_regime_correlation(spark, d):
    return S.lag_correlation(*_driven(spark, d), [0, 14, 30], ("regime",))


@query(f"{_DRIVEN} SELECT 0 AS lag_days, regime, rate_regime, {_CORR} AS correlation, count(*) AS n FROM driven JOIN tgt USING (day) GROUP BY regime, rate_regime")
def regime_matrix(spark, d):
    return S.lag_correlation(*_driven(spark, d), [0], ("regime", "rate_regime"))


@query(f"{_BASE} SELECT 7 AS lag_days, CAST(year(src.day) AS INTEGER) AS year, {_CORR} AS correlation, count(*) AS n FROM src JOIN tgt ON tgt.day = src.day + 7 GROUP BY year(src.day)")
def yearly_stability(spark, d):
    return S.lag_correlation(_source(spark, d), _target(spark, d), [7], (F.year("day").alias("year"),))


@query(f"{_BASE} SELECT 7 AS lag_days, CAST(date_trunc('quarter', src.day) AS DATE) AS quarter, {_CORR} AS correlation, count(*) AS n FROM src JOIN tgt ON tgt.day = src.day + 7 GROUP BY 2")
def quarterly_stability(spark, d):
    return S.lag_correlation(_source(spark, d), _target(spark, d), [7], (F.trunc("day", "quarter").alias("quarter"),))


def _grid(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Market series, daily topic counts and the months' rates on market days as sources, tickers as targets, all long."""
    market = T.market(spark, d).select(F.col("instrument").alias("source"), F.col("trade_date").alias("day"), F.col("close").alias("x"))
    topics = texts.topic_counts(T.articles(spark, d), T.TOPIC_WORDS)
    news = topics.unpivot("news_date", list(T.TOPIC_WORDS), "source", "x").select(F.concat(F.lit("news_"), "source").alias("source"), F.col("news_date").alias("day"), F.col("x").cast("double").alias("x"))
    lines = T.lines(spark, d)
    context = views.market_context(T.market(spark, d), {"urgent": "1-URGENT"}, {}, views.key_rate_daily(T.key_rate_of(lines)))
    macro = context.unpivot("trade_date", ["rate_pct", "inflation"], "source", "x").select(F.concat(F.lit("macro_"), "source").alias("source"), F.col("trade_date").alias("day"), "x")
    targets = T.indices_of(lines).select(F.col("ticker").alias("target"), F.col("trade_date").alias("day"), F.col("close").alias("y"))
    return market.unionByName(news).unionByName(macro), targets


#: The window of ``signal_strength_bands``, on both sides; the scan itself takes all days.
SINCE, UNTIL = "1995-03-01", "2000-12-31"


def _cells(spark: SparkSession, d: str, since: str | None = None, until: str | None = None) -> DataFrame:
    sources, targets = _grid(spark, d)
    # News against the same day tells nothing of lead and lag; one pair is a tautology by design.
    out = (F.col("source").startswith("news_") & (F.col("lag_days") == 0)) | ((F.col("source") == "1-URGENT") & (F.col("target") == "AF") & (F.col("lag_days") == 0))
    return S.scan(sources, targets, T.LAGS6, 150, out, since, until)


_TOPICS = ", ".join("CAST(count(CASE WHEN " + " OR ".join(f"contains(text, '{w}')" for w in ws) + f" THEN 1 END) AS INTEGER) AS \"{k}\"" for k, ws in T.TOPIC_WORDS.items())
_NEWS = f"{T.ARTICLES}, daily AS (SELECT date AS news_date, {_TOPICS} FROM articles GROUP BY date)"
_LONG = " UNION ALL ".join(f"SELECT 'news_{k}' AS source, news_date AS day, CAST(\"{k}\" AS DOUBLE) AS x FROM daily" for k in T.TOPIC_WORDS)
_MACRO = " UNION ALL ".join(f"SELECT 'macro_{k}' AS source, trade_date AS day, {k} AS x FROM context" for k in ("rate_pct", "inflation"))
_WINDOW = f"day BETWEEN '{SINCE}' AND '{UNTIL}' AND trade_date BETWEEN '{SINCE}' AND '{UNTIL}' AND "
_CELLS = f"""WITH {T.MARKET}, {T.INDICES}, {T.RATES}, {_NEWS}, context AS (SELECT trade_date, rate_pct, inflation FROM market LEFT JOIN rates ON period_date = date_trunc('month', trade_date) WHERE instrument = '1-URGENT'),
sources AS (SELECT instrument AS source, trade_date AS day, close AS x FROM market UNION ALL {_LONG} UNION ALL {_MACRO}),
pairs AS (SELECT source, ticker AS target, lag_days AS lag, x, close AS y FROM sources CROSS JOIN {lags_sql(T.LAGS6)} JOIN indices ON trade_date = day + lag_days
  WHERE NOT (source LIKE 'news_%' AND lag_days = 0) AND NOT (source = '1-URGENT' AND ticker = 'AF' AND lag_days = 0)),
cells AS (SELECT source, target, lag, {_CORR} AS corr, count(*) AS n FROM pairs GROUP BY ALL HAVING count(*) >= 150 AND NOT isnan(corr(x, y))),
best AS (SELECT *, abs(corr) AS abs_corr FROM cells QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY abs(corr) DESC, lag) = 1)"""
_BOUNDED = _CELLS.replace("WHERE NOT (source LIKE", f"WHERE {_WINDOW}NOT (source LIKE")


@query(f"{_CELLS} SELECT *, abs(corr) AS abs_corr FROM cells")
def signal_scan(spark, d):
    return _cells(spark, d)


@query(f"{_CELLS} SELECT * FROM best")
def best_lag_per_pair(spark, d):
    return S.best_lags(_cells(spark, d))


@query(f"{_BOUNDED} SELECT CASE WHEN abs_corr >= 0.6 THEN 'strong' WHEN abs_corr >= 0.35 THEN 'medium' WHEN abs_corr >= 0.2 THEN 'weak' ELSE 'none' END AS strength, count(*) AS n FROM best GROUP BY 1")
def signal_strength_bands(spark, d):
    return S.bands(S.best_lags(_cells(spark, d, SINCE, UNTIL))).groupBy("strength").agg(F.count("*").alias("n"))


@query(f"""{_CELLS}, r0 AS (SELECT source, target, corr AS r0 FROM cells WHERE lag = 0)
SELECT cells.*, abs(corr) AS abs_corr, r0, CASE WHEN abs(abs(corr) - abs(r0)) < 0.08 THEN 'STRUCTURAL' WHEN abs(corr) < 0.3 THEN 'WEAK_R' END AS issue
FROM cells LEFT JOIN r0 USING (source, target) WHERE lag > 0""")
def structural_rerun(spark, d):
    from lagloom.operators.audit import rerun_issues

    return rerun_issues(_cells(spark, d))


@query(f"""{_BASE} , p AS (SELECT lag_days, x, y, CASE WHEN src.day <= DATE '1997-12-31' THEN 'discovery' WHEN src.day <= DATE '1999-12-31' THEN 'validation' ELSE 'live' END AS period
  FROM src CROSS JOIN {lags_sql(T.LAGS6)} JOIN tgt ON tgt.day = src.day + lag_days)
, w AS (SELECT lag_days, {", ".join(f"(SELECT CASE WHEN isnan(corr(x, y)) THEN NULL ELSE round(corr(x, y), 4) + 0.0 END FROM p q WHERE q.lag_days = p.lag_days AND period = '{k}') AS r_{k}" for k in ("discovery", "validation", "live"))} FROM p GROUP BY lag_days)
SELECT *, coalesce(abs(r_discovery) > 0.02 AND abs(r_validation) > 0.02, false) AS passes FROM w""")
def period_split_validation(spark, d):
    return S.period_split(_source(spark, d), _target(spark, d), T.LAGS6, [("discovery", "1997-12-31"), ("validation", "1999-12-31"), ("live", "9999-12-31")], 0.02)


_TWO = "two AS (SELECT i.ticker, i.trade_date AS day, m.close AS x, i.close AS y FROM indices i JOIN market m ON m.trade_date = i.trade_date AND m.instrument = '1-URGENT')"


@query(f"WITH {T.MARKET}, {T.INDICES}, {_TWO}, l AS (SELECT *, lag(x) OVER (PARTITION BY ticker ORDER BY day) AS x1 FROM two) SELECT ticker, {_CORR} AS r_lag0, {_CORR.replace('x,', 'x1,')} AS r_lag1, count(*) AS n FROM l GROUP BY ticker")
def row_lag_correlation(spark, d):
    m = T.market(spark, d).filter("instrument = '1-URGENT'").select("trade_date", F.col("close").alias("x"))
    two = T.indices(spark, d).join(m, "trade_date").select("ticker", F.col("trade_date").alias("day"), "x", F.col("close").alias("y"))
    return S.row_lag_correlation(two, "ticker")


@query(f"WITH {T.MARKET}, {T.INDICES}, {_TWO}, l AS (SELECT *, lead(y) OVER w AS ahead, lead(day) OVER w AS due FROM two WINDOW w AS (PARTITION BY ticker ORDER BY day)) SELECT ticker, {_CORR.replace('y)', 'ahead)')} AS r_lead, count(*) AS n FROM l WHERE due IS NOT NULL GROUP BY ticker")
def row_lead_correlation(spark, d):
    m = T.market(spark, d).filter("instrument = '1-URGENT'").select("trade_date", F.col("close").alias("x"))
    two = T.indices(spark, d).join(m, "trade_date").select("ticker", F.col("trade_date").alias("day"), "x", F.col("close").alias("y"))
    return S.row_lead_correlation(two, "ticker")


@query(f"WITH {T.MARKET} SELECT instrument, count(*) AS n, min(close) AS low, max(close) AS high FROM market WHERE trade_date BETWEEN DATE '1996-03-01' AND DATE '1996-09-30' AND instrument IN ('1-URGENT', '5-LOW') GROUP BY instrument")
def bound_parameters(spark, d):
    sql = "SELECT instrument, count(*) AS n, min(close) AS low, max(close) AS high FROM {market} WHERE trade_date BETWEEN :since AND :until AND array_contains(:names, instrument) GROUP BY instrument"
    return spark.sql(sql, args={"since": date(1996, 3, 1), "until": date(1996, 9, 30), "names": F.array(F.lit("1-URGENT"), F.lit("5-LOW"))}, market=T.market(spark, d))


@query(f"WITH {T.RATES}, r AS (SELECT period_date, rate_pct FROM rates WHERE abs(rate_pct - 5.02) < 0.05 ORDER BY period_date LIMIT 1) SELECT coalesce((SELECT period_date FROM r), DATE '1995-01-01') AS period_date, coalesce((SELECT rate_pct FROM r), 5.0) AS rate_pct")
def lookup_with_default(spark, d):
    return views.first_near(views.key_rate_daily(T.key_rate(spark, d)), "rate_pct", 5.02, 0.05, "period_date", {"period_date": F.lit("1995-01-01").cast("date"), "rate_pct": F.lit(5.0)})


@query(f"WITH {T.MARKET}, l AS (SELECT trade_date AS day, instrument, close, lag(close) OVER (PARTITION BY instrument ORDER BY trade_date) AS prev FROM market) SELECT *, round((close - prev) / prev * 100, 4) + 0.0 AS pct FROM l WHERE prev IS NOT NULL")
def pct_change(spark, d):
    return S.pct_change(T.market(spark, d).withColumnRenamed("trade_date", "day"), "instrument", "close").select("day", "instrument", "close", "prev", "pct")


_PIVOT = ", ".join(f"max(CASE WHEN ticker = '{t}' THEN close END) AS \"{n}\"" for t, n in T.TICKERS.items())


@query(f"WITH {T.INDICES} SELECT trade_date, {_PIVOT} FROM indices GROUP BY trade_date")
def sector_pivot(spark, d):
    return views.pivot_tickers(T.indices(spark, d), T.TICKERS)


@query(f"WITH {T.RATES} SELECT * FROM rates")
def key_rate_monthly(spark, d):
    return views.key_rate_daily(T.key_rate(spark, d))


_INSTR = {"high": "2-HIGH", "medium": "3-MEDIUM", "low": "5-LOW"}


@query(f"""WITH {T.MARKET}, {T.INDICES}, {T.RATES}
SELECT u.trade_date, u.close AS urgent, i.close AS "index", {", ".join(f"{k}.close AS {k}" for k in _INSTR)}, rate_pct, inflation
FROM market u LEFT JOIN indices i ON i.trade_date = u.trade_date AND i.ticker = 'NO' {" ".join(f"LEFT JOIN market {k} ON {k}.trade_date = u.trade_date AND {k}.instrument = '{v}'" for k, v in _INSTR.items())}
LEFT JOIN rates ON period_date = date_trunc('month', u.trade_date) WHERE u.instrument = '1-URGENT'""")
def market_context(spark, d):
    lines = T.lines(spark, d)
    index = T.indices_of(lines).filter("ticker = 'NO'")
    return views.market_context(T.market(spark, d), {"urgent": "1-URGENT"} | _INSTR, {"index": index}, views.key_rate_daily(T.key_rate_of(lines)))


@query(f"""WITH {T.MARKET}, {T.RATES}, quarterly AS (SELECT * FROM rates WHERE month(period_date) IN (2, 5, 8, 11))
SELECT trade_date, close, rate_pct FROM (SELECT trade_date, close FROM market WHERE instrument = '1-URGENT') m ASOF LEFT JOIN quarterly ON period_date <= trade_date""")
def asof_rate(spark, d):
    days = T.market(spark, d).filter("instrument = '1-URGENT'").select("trade_date", "close")
    rates = views.key_rate_daily(T.key_rate(spark, d)).filter(F.month("period_date").isin(2, 5, 8, 11)).select("period_date", "rate_pct")
    return views.asof(days, rates, "trade_date", "period_date", ["rate_pct"])


_EAV = """eav AS (
  SELECT CAST(year(o_orderdate) AS VARCHAR) AS period, 'total_' || o_orderstatus AS indicator, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS value FROM orders GROUP BY ALL
  UNION ALL SELECT year(o_orderdate) || '-' || month(o_orderdate), 'count_all', CAST(count(*) AS DOUBLE) FROM orders GROUP BY ALL)"""


def _eav(spark: SparkSession, d: str) -> DataFrame:
    o = T.table(spark, d, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    a = o.groupBy(F.year("o_orderdate").cast("string").alias("period"), F.concat(F.lit("total_"), "o_orderstatus").alias("indicator")).agg((F.sum(cents).cast("double") / 100.0).alias("value"))
    b = o.groupBy(F.concat_ws("-", F.year("o_orderdate"), F.month("o_orderdate")).alias("period"), F.lit("count_all").alias("indicator")).agg(F.count("*").cast("double").alias("value"))
    return a.unionByName(b)


@query(f"""WITH {_EAV} SELECT TRY_CAST(period AS INTEGER) AS year, round(avg(CASE WHEN indicator = 'total_F' THEN value END), 4) + 0.0 AS finished, round(avg(CASE WHEN indicator = 'total_O' THEN value END), 4) + 0.0 AS open
FROM eav WHERE TRY_CAST(period AS INTEGER) BETWEEN 1990 AND 2030 GROUP BY 1""")
def wage_dynamics(spark, d):
    return views.wage_dynamics(_eav(spark, d), {"total_F": "finished", "total_O": "open"}, 1990, 2030)


@query(f"WITH {T.MARKET} SELECT CAST(date_trunc('month', trade_date) AS DATE) AS month, instrument, CAST(sum(CAST(round(close * 1000000) AS BIGINT)) AS DOUBLE) / CAST(count(close) AS DOUBLE) / 1000000.0 AS mean, count(*) AS n FROM market GROUP BY 1, 2")
def monthly_means(spark, d):
    return views.monthly(T.market(spark, d), "instrument", "close")


@query(f"WITH {T.MARKET} SELECT CAST(date_trunc('month', trade_date) AS DATE) AS month, instrument, CAST(sum(CAST(round(close * 1000000) AS BIGINT)) AS DOUBLE) / CAST(count(close) AS DOUBLE) / 1000000.0 AS mean, min(close) AS low, max(close) AS high, round(stddev(close) / avg(close) * 100, 4) + 0.0 AS volatility_pct FROM market GROUP BY 1, 2")
def monthly_volatility(spark, d):
    return views.monthly_volatility(T.market(spark, d), "instrument", "close")


@query(f"WITH {T.MARKET}, y AS (SELECT CAST(year(trade_date) AS INTEGER) AS year, instrument, first(close ORDER BY trade_date) AS open, last(close ORDER BY trade_date) AS close, count(*) AS n FROM market GROUP BY 1, 2) SELECT *, round((close - open) / open * 100, 4) + 0.0 AS return_pct FROM y")
def annual_return(spark, d):
    return views.annual_return(T.market(spark, d), "instrument", "close")


@query(f"""WITH {T.MARKET}, m AS (SELECT instrument, datediff('day', DATE '1995-01-01', trade_date) AS t, close FROM market)
SELECT instrument, round(regr_slope(close, t), 4) + 0.0 AS slope, round(regr_intercept(close, t), 2) AS intercept, CAST(first(t ORDER BY close DESC, t) AS INTEGER) AS argmax FROM m GROUP BY 1""")
def trend_line(spark, d):
    m = T.market(spark, d).withColumn("t", F.datediff("trade_date", F.lit("1995-01-01").cast("date")))
    return views.trend(m, "instrument", "t", "close")


@query(f"WITH {T.MARKET}, {_NEWS} SELECT lag_days, {_CORR.replace('x, y', 'tion, close')} AS correlation, count(*) AS n FROM daily CROSS JOIN {lags_sql([7, 14, 30])} JOIN market ON trade_date = news_date + lag_days AND instrument = '1-URGENT' GROUP BY lag_days")
def topic_market_lag(spark, d):
    news = texts.topic_counts(T.articles(spark, d), T.TOPIC_WORDS).select(F.col("news_date").alias("day"), F.col("tion").alias("x"))
    return S.lag_correlation(news, _source(spark, d).withColumnRenamed("x", "y"), [7, 14, 30])


@query(f"WITH {T.MARKET} SELECT instrument, quantile_disc(close, 0.5) AS median, quantile_disc(close, 0.9) AS p90 FROM market GROUP BY 1")
def spread_approximate(spark, d):
    """Percentiles by a sketch: exact where a group has fewer than 10,000 distinct values, within a ten-thousandth of the ranks beyond."""
    found = T.market(spark, d).groupBy("instrument").agg(F.percentile_approx("close", [0.5, 0.9], 10_000).alias("p"))
    return found.select("instrument", F.col("p")[0].alias("median"), F.col("p")[1].alias("p90"))


@query(f"WITH {T.MARKET} SELECT instrument, round(stddev(close), 2) AS sd, round(quantile_cont(close, 0.5), 4) AS median, round(quantile_cont(close, 0.9), 4) AS p90 FROM market GROUP BY 1")
def spread_statistics(spark, d):
    """Exact percentiles by narrowing ranges: no task holds a group's values."""
    m = keep(T.market(spark, d).select("instrument", "close"), "market")
    sd = m.groupBy("instrument").agg(F.round(F.stddev("close"), 2).alias("sd"))
    found = selection.percentiles(m, ["instrument"], "close", {"median": 0.5, "p90": 0.9})
    return sd.join(found, "instrument").select("instrument", "sd", F.round("median", 4).alias("median"), F.round("p90", 4).alias("p90"))
