"""Aggregates with the edge cases that correlation scans meet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson's r over pairs without nulls; null (never an error or NaN) for fewer than 2 pairs or a constant side."""
    x, y = (F.col(c).cast("double") if isinstance(c, str) else c.cast("double") for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def r4(c: Column) -> Column:
    """Rounded to 4 places, without a negative zero."""
    return F.round(c, 4) + F.lit(0.0)


def n_pairs(x: str, y: str) -> Column:
    return F.count_if(F.col(x).isNotNull() & F.col(y).isNotNull())


def exact_avg(x: str, places: int = 2) -> Column:
    """Mean of a column of fixed decimals, summed as integers: the same for any order of rows."""
    scale = 10**places
    whole = F.round(F.col(x) * scale).cast("bigint")
    return F.sum(whole).cast("double") / F.count(x).cast("double") / F.lit(float(scale))


def strength(r: str | Column) -> Column:
    a = F.abs(F.col(r) if isinstance(r, str) else r)
    return F.when(a >= 0.60, "strong").when(a >= 0.35, "medium").when(a >= 0.20, "weak").otherwise("none")
