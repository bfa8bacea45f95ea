"""Lead-lag signals between daily series.

A lag is a column, and ``date_add(day, lag)`` an ordinary join key: all lags of a pair are one equi-join and one
aggregation with map-side combine. A whole grid of sources, targets and lags is a matter of matrix products (``gram``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions.stats import r4, safe_corr, strength
from lagloom.operators import gram


def lag_pairs(source: DataFrame, target: DataFrame, lags: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """(…, lag_days, day, x, y): source (day, x) met by target (day, y) exactly ``lag_days`` later; other days drop."""
    src = source.withColumn("lag_days", F.explode(F.array(*map(F.lit, lags)))).withColumn("due", F.date_add("day", F.col("lag_days")))
    tgt = target.withColumnRenamed("day", "due")
    return src.join(tgt, ["due", *keys]).drop("due")


def lag_correlation(source: DataFrame, target: DataFrame, lags: list[int], by: tuple[str | Column, ...] = ()) -> DataFrame:
    """Correlation and rows for each lag (and each of ``by``). n counts rows; pairs with a null side do not enter r."""
    return lag_pairs(source, target, lags).groupBy("lag_days", *by).agg(r4(safe_corr("x", "y")).alias("correlation"), F.count("*").alias("n"))


def regime(driver: Column, threshold: float, above: str, below: str) -> Column:
    """A null driver counts as below, as in a searched CASE with ELSE."""
    return F.when(driver > threshold, above).otherwise(below)


def scan(sources: DataFrame, targets: DataFrame, lags: list[int], min_n: int, exclude: Column | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """All cells of sources (source, day, x) by targets (target, day, y) by lags with n >= min_n and a correlation.

    ``exclude`` names cells by source, target and lag_days. Both sides are limited to the days from ``since`` to ``until``,
    bounds that reach the scans of either side. Cells are matrix products (``gram``), not a join on the day.
    """
    for bound, compare in ((since, F.col("day") >= F.lit(since).cast("date")), (until, F.col("day") <= F.lit(until).cast("date"))):
        if bound is not None:
            sources, targets = sources.filter(compare), targets.filter(compare)
    cells = gram.correlations(sources, targets, lags).withColumn("lag_days", F.col("lag"))
    if exclude is not None:
        cells = cells.filter(~exclude)
    cells = cells.select("source", "target", "lag", r4(F.col("r")).alias("corr"), "n")
    return cells.filter((F.col("n") >= min_n) & F.col("corr").isNotNull()).withColumn("abs_corr", F.abs("corr"))


def best_lags(cells: DataFrame) -> DataFrame:
    """The lag of the largest |r| for each pair; ties go to the smaller lag."""
    order = Window.partitionBy("source", "target").orderBy(F.desc("abs_corr"), "lag")
    return cells.withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def bands(best: DataFrame) -> DataFrame:
    return best.withColumn("strength", strength("corr"))


def row_lag_correlation(series: DataFrame, key: str) -> DataFrame:
    """r of y with x on the same row and with x of the row before, within each key."""
    w = Window.partitionBy(key).orderBy("day")
    lagged = series.withColumn("x1", F.lag("x").over(w))
    return lagged.groupBy(key).agg(r4(safe_corr("x", "y")).alias("r_lag0"), r4(safe_corr("x1", "y")).alias("r_lag1"), F.count("*").alias("n"))


def row_lead_correlation(series: DataFrame, key: str, steps: int = 1) -> DataFrame:
    """r of x with y ``steps`` rows later within each key, and the rows that have such a later one."""
    w = Window.partitionBy(key).orderBy("day")
    led = series.withColumn("ahead", F.lead("y", steps).over(w)).withColumn("due", F.lead("day", steps).over(w))
    return led.filter("due is not null").groupBy(key).agg(r4(safe_corr("x", "ahead")).alias("r_lead"), F.count("*").alias("n"))


def pct_change(series: DataFrame, key: str, value: str) -> DataFrame:
    prev = F.lag(value).over(Window.partitionBy(key).orderBy("day"))
    return series.withColumn("prev", prev).filter("prev is not null").withColumn("pct", F.round((F.col(value) - F.col("prev")) / F.col("prev") * 100, 4) + F.lit(0.0))


def period_split(source: DataFrame, target: DataFrame, lags: list[int], cuts: list[tuple[str, str]], gate: float) -> DataFrame:
    """r by period side by side: ``cuts`` are (name, last day); the gate asks for |r| in the first two."""
    label = None
    for name, last in cuts:
        label = F.when(F.col("day") <= F.lit(last).cast("date"), name) if label is None else label.when(F.col("day") <= F.lit(last).cast("date"), name)
    pairs = lag_pairs(source, target, lags).withColumn("period", label).filter("period is not null")
    names = [n for n, _ in cuts]
    wide = pairs.groupBy("lag_days").agg(*[r4(safe_corr(F.when(F.col("period") == n, F.col("x")), F.col("y"))).alias(f"r_{n}") for n in names])
    return wide.withColumn("passes", F.coalesce(*[(F.abs(F.col(f"r_{names[0]}")) > gate) & (F.abs(F.col(f"r_{names[1]}")) > gate), F.lit(False)]))
