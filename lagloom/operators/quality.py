"""Data quality: profiles and checks, one pass over each table."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def null_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n_null, n_rows): one aggregation, then rows."""
    counted = df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return counted.unpivot(["n_rows"], columns, "column", "n_null").select("column", "n_null", "n_rows")


def group_profile(df: DataFrame, key: str, at: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("c")).filter("c > 1")


@dataclass
class Checks:
    """What a table must satisfy. Each check has a name and counts bad rows; zero is good."""

    table: str
    not_null: list[str] = field(default_factory=list)
    bad: dict[str, Column] = field(default_factory=dict)
    key: list[str] = field(default_factory=list)
    least_rows: int = 0
    expected: tuple[str, list[str]] | None = None
    least_per_key: tuple[str, int] | None = None
    #: column -> (earliest that its first value, earliest that its last value may be)
    since: dict[str, tuple[str, str]] = field(default_factory=dict)


def run_checks(df: DataFrame, c: Checks) -> DataFrame:
    """(table, check, bad) rows."""
    exprs = {f"null {x}": F.count_if(F.col(x).isNull()) for x in c.not_null} | {k: F.count_if(v) for k, v in c.bad.items()}
    for x, (first, last) in c.since.items():
        late = lambda v, least: F.when(F.coalesce(v >= F.lit(least).cast("date"), F.lit(False)), 0).otherwise(1).cast("bigint")
        exprs |= {f"first {x}": late(F.min(x), first), f"last {x}": late(F.max(x), last)}
    exprs |= {f"rows >= {c.least_rows}": F.when(F.count("*") < c.least_rows, 1).otherwise(0).cast("bigint")}
    out = [df.agg(*[e.alias(k) for k, e in exprs.items()]).unpivot([], list(exprs), "check", "bad")]
    if c.key:
        out.append(duplicate_keys(df, c.key).agg(F.count("*").alias("bad")).select(F.lit(f"unique {', '.join(c.key)}").alias("check"), "bad"))
    if c.expected or c.least_per_key:
        name = (c.expected or c.least_per_key)[0]
        per = df.groupBy(name).agg(F.count("*").alias("n"))
        if c.expected:
            there = per.filter(F.col(name).isin(c.expected[1])).agg((F.lit(len(c.expected[1])) - F.count("*")).alias("bad"))
            out.append(there.select(F.lit(f"expected {name}").alias("check"), "bad"))
        if c.least_per_key:
            out.append(per.agg(F.count_if(F.col("n") < c.least_per_key[1]).alias("bad")).select(F.lit(f"rows per {name}").alias("check"), "bad"))
    return reduce(DataFrame.unionByName, out).select(F.lit(c.table).alias("table"), "check", F.col("bad").cast("bigint").alias("bad"))


def suite(tables: dict[str, DataFrame], expected: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """(table, check, bad) of what must hold for the tables indices, key_rate, forex and market; ``expected`` names the
    values that a table's column must have."""
    c = F.col
    checks = [
        Checks("indices", ["close"], {"close < 0": c("close") < 0}, ["ticker", "trade_date"], 1, expected.get("indices"), None, {"trade_date": ("2010-01-01", "2020-01-01")}),
        Checks("key_rate", ["rate_pct", "inflation"], {"rate out of 0 to 100": (c("rate_pct") < 0) | (c("rate_pct") > 100)}, [], 101),
        Checks("forex", ["rate"], {"rate <= 0": c("rate") <= 0}, ["trade_date", "currency"], 501, expected.get("forex")),
        Checks("market", ["close"], {"close <= 0": c("close") <= 0}, ["trade_date", "instrument"], 1001, expected.get("market"), ("instrument", 100)),
    ]
    return reduce(DataFrame.unionByName, [run_checks(tables[x.table], x) for x in checks])
