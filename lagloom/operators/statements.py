"""Statements of the lag-join shape, measured again: all of them in one grid, not a job for each.

A statement is taken apart by column expressions, so a log of any length is parsed in the tasks:

    SELECT CORR(s.<value>, t.<value>) … FROM <table> s JOIN <table> t ON t.<day> = s.<day> [+ INTERVAL n DAYS]
    WHERE s.<key> = 'name' AND t.<key> = 'name' [AND s.<day> BETWEEN DATE 'a' AND DATE 'b'] [AND s.regime = 'label']

White space and case of keywords are free; anything else is not parsed, and gets no r.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.functions.stats import r4
from lagloom.operators import gram
from lagloom.sources.shared import keep

_DAY = r"DATE '(\d{4}-\d{2}-\d{2})'"
_SHAPE = r"(?i)\bSELECT\b.*\bCORR\( ?s\.\w+ ?, ?t\.\w+ ?\).* FROM \w+ s (?:INNER )?JOIN \w+ t ON t\.\w+ = s\.\w+(?: \+ INTERVAL '?\d+'? DAYS?'?)? WHERE (?:(?:[st]\.\w+ = '[^']*'|s\.\w+ BETWEEN DATE '[^']*' AND DATE '[^']*')(?: AND |$))+$"


def parsed(statements: DataFrame, sql: str = "sql") -> DataFrame:
    """``statements`` with source, target, lag, since, until, regime; all null where the statement has another shape."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.col(sql), r"\s+", " "), r"\s*;\s*$", ""))
    fits = F.coalesce(text.rlike(_SHAPE), F.lit(False))

    def part(pattern: str) -> Column:
        found = F.regexp_extract(text, "(?i)" + pattern, 1)
        return F.when(fits & (found != ""), found)

    out = {
        "source": part(r"\bs\.(?!regime\b)\w+ = '([^']*)'"),
        "target": part(r"\bt\.(?!regime\b)\w+ = '([^']*)'"),
        "lag": F.when(fits, F.coalesce(part(r" \+ INTERVAL '?(\d+)"), F.lit("0")).try_cast("int")),
        "since": part(rf"\bs\.\w+ BETWEEN {_DAY} AND").try_cast("date"),
        "until": part(rf"\bs\.\w+ BETWEEN DATE '[^']*' AND {_DAY}").try_cast("date"),
        "regime": part(r"\bs\.regime = '([^']*)'"),
    }
    rows = statements.withColumns(out)
    named = F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("lag").isNotNull()
    return rows.withColumns({c: F.when(named, F.col(c)) for c in out})


def measured(statements: DataFrame, sources: DataFrame, targets: DataFrame, regimes: DataFrame | None = None, sql: str = "sql") -> DataFrame:
    """``statements`` with n, r and, where the statement has a lag, r0, its r without the lag; null where it can't be measured.

    ``sources``: source, day, x; ``targets``: target, day, y; ``regimes``: regime, day. A source under a period and a regime is a
    series of its own, limited to those days; the distinct ones, the targets they name and the lags are one grid of
    matrix products. Repeated statements are measured once.
    """
    # Each text is parsed once, and what it says is kept: a filter on it, pushed below, would match the patterns again for every row and use.
    texts = statements.filter(F.col(sql).isNotNull()).select(F.col(sql).alias("_sql")).distinct()
    limits = ["since", "until", "regime"]
    series = F.concat_ws("\u0001", "source", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in limits])
    told = keep(parsed(texts, "_sql").withColumn("_series", F.when(F.col("source").isNotNull(), series)), "statements")
    asked = told.filter("_series is not null")
    kinds = asked.select("_series", "source", *limits).distinct()
    limited = sources.join(kinds, "source").filter((F.col("since").isNull() | (F.col("day") >= F.col("since"))) & (F.col("until").isNull() | (F.col("day") <= F.col("until"))))
    if regimes is not None:
        held = regimes.select("regime", "day").distinct().withColumn("_held", F.lit(True))
        limited = limited.join(held, ["regime", "day"], "left").filter(F.col("regime").isNull() | F.col("_held"))
    else:
        limited = limited.filter(F.col("regime").isNull())
    # A few numbers of days.
    lags = sorted({0, *(r[0] for r in asked.select("lag").distinct().collect())})
    named = targets.join(asked.select("target").distinct(), "target", "left_semi")
    cells = gram.correlations(limited.select(F.col("_series").alias("source"), "day", "x"), named.select("target", "day", "y"), lags)
    cells = cells.select(F.col("source").alias("_series"), "target", "lag", "n", r4(F.col("r")).alias("r"))
    flat = cells.filter("lag = 0").select("_series", "target", F.col("r").alias("_r0"))
    found = asked.join(cells, ["_series", "target", "lag"], "left").join(flat, ["_series", "target"], "left")
    found = found.select("_sql", "n", "r", F.when(F.col("lag") > 0, F.col("_r0")).alias("r0"))
    return statements.join(found, F.col(sql) == F.col("_sql"), "left").select(*[statements[c] for c in statements.columns], "n", "r", "r0")
