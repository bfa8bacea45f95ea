"""Analytical views: pivots, date-aligned contexts, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.stats import exact_avg, r4
from lagloom.functions.text import month_period


def pivot_tickers(indices: DataFrame, tickers: dict[str, str]) -> DataFrame:
    """One row per day, one column per ticker (ticker -> column name)."""
    return indices.groupBy("trade_date").agg(*[F.max(F.when(F.col("ticker") == t, F.col("close"))).alias(name) for t, name in tickers.items()])


def key_rate_daily(key_rate: DataFrame) -> DataFrame:
    """Monthly rates with 'M.YYYY' as a date; rows of other forms drop."""
    return key_rate.withColumn("period_date", month_period(F.col("period"))).filter("period_date is not null").select("period_date", "rate_pct", "inflation")


def wide(series: DataFrame, names: dict[str, str], key: str = "instrument") -> DataFrame:
    """Days as rows and series as columns (name -> key), in one aggregation of ``series``, and with ``has_<name>``
    whether that day has a row of the series at all (its value may be null)."""
    of = lambda k: F.col(key) == k
    picked = series.filter(F.col(key).isin(list(names.values())))
    cells = [c for name, k in names.items() for c in (F.max(F.when(of(k), F.col("close"))).alias(name), (F.count_if(of(k)) > 0).alias(f"has_{name}"))]
    return picked.groupBy("trade_date").agg(*cells)


def market_context(market: DataFrame, names: dict[str, str], others: dict[str, DataFrame], rates: DataFrame) -> DataFrame:
    """The days of the first of ``names`` (column -> instrument) with the others' values, those of further series
    (trade_date, close), and the month's rate by equality, null in a missing month. ``market`` is read once."""
    first = next(iter(names))
    out = wide(market, names).filter(f"has_{first}").select("trade_date", *names)
    for name, series in others.items():
        out = out.join(series.select("trade_date", F.col("close").alias(name)), "trade_date", "left")
    month = rates.select(F.col("period_date").alias("_month"), "rate_pct", "inflation")
    return out.join(month, F.trunc("trade_date", "month") == F.col("_month"), "left").drop("_month")


def asof(days: DataFrame, rates: DataFrame, on: str, at: str, values: list[str], carry: int = 36_525) -> DataFrame:
    """For each row of ``days`` the last known ``values`` at or before its date.

    The rates, the small side, become a calendar: each holds on every date up to the next, the last for ``carry`` days
    (a century). The as-of join is then one by equality, in which no task sorts or ranks days; the calendar has a row a
    date, whatever the days. Of rates of one date the largest counts; a null rate is known as null.
    """
    one = rates.filter(F.col(at).isNotNull()).groupBy(at).agg(F.max(F.struct(*values)).alias("_state"))
    until = F.coalesce(F.date_sub(F.lead(at).over(Window.orderBy(at)), 1), F.date_add(at, carry))
    calendar = one.withColumn("_until", until).select(F.explode(F.sequence(at, "_until")).alias("_on"), "_state")
    return days.join(calendar, F.col(on) == F.col("_on"), "left").select(*days.columns, *[F.col(f"_state.{v}").alias(v) for v in values])


def first_near(rows: DataFrame, value: str, at: float, within: float, order: str, default: dict[str, Column]) -> DataFrame:
    """One row: the first in ``order`` whose ``value`` lies nearer than ``within`` to ``at``, else ``default``."""
    near = rows.filter(F.abs(F.col(value) - at) < within).agg(F.min_by(F.struct(*default), order).alias("_first"))
    return near.select(*[F.coalesce(F.col(f"_first.{c}"), v).alias(c) for c, v in default.items()])


def wage_dynamics(eav: DataFrame, indicators: dict[str, str], first: int, last: int) -> DataFrame:
    """Indicators of an entity-attribute-value table by year; periods that are no year drop."""
    year = F.col("period").try_cast("int")
    picked = eav.withColumn("year", year).filter(F.col("year").between(first, last))
    return picked.groupBy("year").agg(*[r4(F.avg(F.when(F.col("indicator") == k, F.col("value")))).alias(name) for k, name in indicators.items()])


def monthly(series: DataFrame, key: str, value: str) -> DataFrame:
    return series.groupBy(F.trunc("trade_date", "month").alias("month"), key).agg(exact_avg(value, 6).alias("mean"), F.count("*").alias("n"))


def monthly_volatility(series: DataFrame, key: str, value: str) -> DataFrame:
    g = series.groupBy(F.trunc("trade_date", "month").alias("month"), key)
    return g.agg(exact_avg(value, 6).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), r4(F.try_divide(F.stddev(value), F.avg(value)) * 100).alias("volatility_pct"))


def annual_return(series: DataFrame, key: str, value: str) -> DataFrame:
    g = series.groupBy(F.year("trade_date").alias("year"), key).agg(F.min_by(value, "trade_date").alias("open"), F.max_by(value, "trade_date").alias("close"), F.count("*").alias("n"))
    return g.withColumn("return_pct", r4((F.col("close") - F.col("open")) / F.col("open") * 100))


def trend(series: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Least-squares line of degree 1 for each key."""
    return series.groupBy(key).agg(r4(F.regr_slope(y, x)).alias("slope"), F.round(F.regr_intercept(y, x), 2).alias("intercept"), F.max_by(x, F.struct(F.col(y), -F.col(x))).alias("argmax"))

