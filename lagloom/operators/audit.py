"""Deterministic audit of SQL-based findings.

``static_issues`` flags aliasing, tautology and inactive regimes, and structural pairs only where nothing else was
found. ``rerun_issues`` compares a finding's correlation with that at lag zero. ``convergence`` counts repeated
hypotheses. ``run`` joins them: the confirmed findings of a session, those of high score that nothing else flags
held against their statements run again, with and without their lag.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.functions import fixed
from lagloom.functions.text import hypothesis_fingerprint
from lagloom.operators.statements import measured


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols, F.lit(False))


def aliasing(sql: Column, instruments: list[str] | None = None, columns: list[str] | None = None) -> Column:
    """A context column renamed to a foreign instrument."""
    names, cols = "|".join(map(re.escape, instruments or fixed.FOREIGN_INSTRUMENTS)), "|".join(map(re.escape, columns or fixed.CONTEXT_COLUMNS))
    return F.coalesce(sql.rlike(rf"(?i)\b(?:{cols})\s+AS\s+(?:{names})\b"), F.lit(False))


def tautology(text: Column, pairs: list[tuple[str, str]] | None = None) -> Column:
    low = F.lower(text)
    return _any([low.contains(a) & low.contains(b) for a, b in pairs or fixed.TAUTOLOGY_PAIRS])


def inactive_regime(text: Column, inactive: list[str] | None = None, active: list[str] | None = None) -> Column:
    """An inactive condition without an active one beside it (both together are a comparison)."""
    off, on = (_any([text.rlike("(?i)" + p) for p in ps]) for ps in (inactive or fixed.INACTIVE_REGIME, active or fixed.ACTIVE_REGIME))
    return off & ~on


def structural(text: Column, patterns: list[str] | None = None) -> Column:
    return _any([F.lower(text).rlike(p) for p in patterns or fixed.STRUCTURAL])


def static_issues(findings: DataFrame) -> DataFrame:
    """``findings`` (sql, hypothesis, …) with the array ``issues``; clean findings have an empty one."""
    text = F.concat_ws(" ", F.coalesce("sql", F.lit("")), F.coalesce("hypothesis", F.lit("")))
    flags = {"ALIASING": aliasing(F.col("sql")), "TAUTOLOGY": tautology(text), "REGIME_INACTIVE": inactive_regime(text)}
    first = F.array_compact(F.array(*[F.when(v, k) for k, v in flags.items()]))
    out = findings.withColumn("_first", first).withColumn("_structural", structural(text))
    alone = F.when((F.size("_first") == 0) & F.col("_structural"), F.array(F.lit("STRUCTURAL"))).otherwise(F.col("_first"))
    return out.withColumn("issues", alone).drop("_first", "_structural")


def summary(audited: DataFrame) -> DataFrame:
    """Issues by kind; a finding without issues counts as CLEAN."""
    kinds = F.explode(F.when(F.size("issues") == 0, F.array(F.lit("CLEAN"))).otherwise(F.col("issues")))
    return audited.select(kinds.alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def convergence(findings: DataFrame, least: int = fixed.CONVERGENCE_MIN, top: int | None = 5, by: list[str] | None = None) -> DataFrame:
    """Fingerprints of at least ``least`` hypotheses (for each of ``by``), the most frequent first."""
    counted = findings.groupBy(*by or [], hypothesis_fingerprint(F.coalesce("hypothesis", F.lit(""))).alias("fingerprint")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counted.orderBy(F.desc("n"), "fingerprint").limit(top) if top else counted


def rerun_issues(cells: DataFrame, delta: float = fixed.STRUCTURAL_DELTA, least: float = fixed.MIN_R) -> DataFrame:
    """Cells (source, target, lag, corr) against lag 0: STRUCTURAL if | |r| - |r0| | < delta, else WEAK_R if |r| < least."""
    zero = cells.filter("lag = 0").select("source", "target", F.col("corr").alias("r0"))
    both = cells.filter("lag > 0").join(zero, ["source", "target"], "left")
    flat = F.abs(F.abs("corr") - F.abs("r0")) < delta
    return both.withColumn("issue", F.when(flat, "STRUCTURAL").when(F.abs("corr") < least, "WEAK_R"))


def without_lag(sql: str) -> str:
    """The statement with every ``INTERVAL n DAY(S)``, quoted or not, at zero."""
    return re.sub(r"INTERVAL\s+'?\d+(?:\s+DAYS?'|'?\s+DAYS?)", "INTERVAL 0 DAYS", sql, flags=re.I)


def first_r(rows: list[tuple]) -> float | None:
    """r in a result: the first float in [-1, 1], to 4 places."""
    return next((round(v, 4) for row in rows for v in row if isinstance(v, float) and -1 <= v <= 1), None)


def both_r(run: Callable[[str], list[tuple]], sql: str, lag: int | None) -> tuple[float | None, float | None]:
    """(r, r without the lag) of a statement by running it again; null where it fails, tells no r or names no lag."""

    def r(statement: str) -> float | None:
        try:
            return first_r(run(statement))
        except Exception:
            return None

    flat = without_lag(sql)
    return r(sql), r(flat) if lag and flat != sql else None


def rerun(run: Callable[[str], list[tuple]], sql: str, delta: float = fixed.STRUCTURAL_DELTA, least: float = fixed.MIN_R) -> str | None:
    """The issue of one statement by running it again; ``run`` gives its rows."""
    r, r0 = both_r(run, sql, 1)
    if r is None:
        return None
    if r0 is not None and abs(abs(r) - abs(r0)) < delta:
        return "STRUCTURAL"
    return "WEAK_R" if abs(r) < least else None


def confirmed_rows(log: DataFrame, session: object = None, order: str = "event_id") -> DataFrame:
    """The confirmed findings of ``session``; of the session of the last row by ``order`` if it is null."""
    if session is not None:
        return log.filter((F.col("session") == F.lit(session)) & F.col("confirmed"))
    last = log.agg(F.max_by("session", order).alias("session"))  # one row
    return log.filter("confirmed").join(F.broadcast(last), "session").select(*log.columns)


def candidates(findings: DataFrame, least: int = fixed.RERUN_MIN_SCORE) -> Column:
    """Whether a finding of ``static_issues`` is run again: nothing flags it, its score is high, there is a statement."""
    return (F.size("issues") == 0) & (F.coalesce("score", F.lit(0)) >= least) & (F.coalesce("sql", F.lit("")) != "")


def told_again(measured: DataFrame, least: int = fixed.RERUN_MIN_SCORE, delta: float = fixed.STRUCTURAL_DELTA, weak: float = fixed.MIN_R) -> DataFrame:
    """Findings of ``static_issues`` that have r and r0, with what these tell.

    With a lag, an r that stays without it is STRUCTURAL, else a small one is WEAK_R; without a lag only the latter.
    """
    flat = (F.coalesce("lag", F.lit(0)) > 0) & (F.abs(F.abs("r") - F.abs("r0")) < delta)
    issue = F.when(flat, "STRUCTURAL").when(F.abs("r") < weak, "WEAK_R")
    again = F.when(candidates(measured, least) & issue.isNotNull(), F.array(issue)).otherwise(F.col("issues"))
    return measured.withColumn("issues", again)


def with_reruns(findings: DataFrame, reruns: DataFrame, on: list[str], least: int = fixed.RERUN_MIN_SCORE, delta: float = fixed.STRUCTURAL_DELTA, weak: float = fixed.MIN_R) -> DataFrame:
    """``findings`` of ``static_issues`` with what running them again tells (``told_again``); ``reruns`` has on, r and r0."""
    return told_again(findings.join(reruns.select(*on, "r", "r0"), on, "left"), least, delta, weak)


KINDS = {"aliasing": "ALIASING", "tautology": "TAUTOLOGY", "regime_inactive": "REGIME_INACTIVE", "structural": "STRUCTURAL", "weak_r": "WEAK_R"}


def rates(log: DataFrame, findings: DataFrame, traps: int = fixed.CONVERGENCE_MIN) -> DataFrame:
    """One row a session: all rows, confirmed ones, those without an issue, their rates in percent, issues by kind.

    ``findings`` has ``issues`` for the confirmed rows of those sessions.
    """
    total = log.groupBy("session").agg(F.count("*").alias("total"))
    counts = [F.count_if(F.array_contains("issues", v)).alias(k) for k, v in KINDS.items()]
    told = findings.groupBy("session").agg(F.count("*").alias("confirmed_raw"), F.count_if(F.size("issues") == 0).alias("clean_confirmed"), *counts, F.sum(F.size("issues")).alias("total_issues"))
    repeated = convergence(findings, traps, None, ["session"]).groupBy("session").agg(F.count("*").alias("convergence_traps"))
    out = total.join(told, "session").join(repeated, "session", "left").withColumn("convergence_traps", F.coalesce("convergence_traps", F.lit(0)))
    share = lambda c: F.round(F.col(c) / F.col("total") * 100, 1)
    return out.withColumns({"raw_rate": share("confirmed_raw"), "clean_rate": share("clean_confirmed")})


def recurring_weak(findings: DataFrame, least: int = 3, chars: int = 80, by: list[str] | None = None) -> DataFrame:
    """Beginnings of statements that came out WEAK_R at least ``least`` times in their session (or for each of ``by``)."""
    begin = F.trim(F.regexp_replace(F.lower(F.substring("sql", 1, chars)), r"\s+", " "))
    return findings.filter(F.array_contains("issues", "WEAK_R")).groupBy(*["session"] if by is None else by, begin.alias("beginning")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def alias_pairs(sql: Column, instruments: list[str] | None = None, columns: list[str] | None = None) -> Column:
    """The 'column AS instrument' pairs that ``aliasing`` finds in a statement."""
    pairs = [(c, i) for i in instruments or fixed.FOREIGN_INSTRUMENTS for c in columns or fixed.CONTEXT_COLUMNS]
    return F.array_compact(F.array(*[F.when(sql.rlike(rf"(?i)\b{re.escape(c)}\s+AS\s+{re.escape(i)}\b"), f"{c} AS {i}") for c, i in pairs]))


@dataclass
class Audit:
    """What an audit found: ``findings`` with issues, one row of ``rates``, repeated hypotheses, recurring weak statements."""

    findings: DataFrame
    rates: DataFrame
    convergence: DataFrame
    weak: DataFrame


def run(log: DataFrame, session: object = None, execute: Callable[[str], list[tuple]] | None = None, order: str = "event_id", series: tuple[DataFrame, ...] | None = None) -> Audit:
    """The audit of one session (by default that of the last row) of a log with ``order`` as its key.

    ``series`` (sources, targets and, if wanted, regimes of ``statements.measured``) measures all candidates of the lag-join
    shape in one job. ``execute`` gives the rows of any statement: those run one after another from the driver, each as
    a job of its own, the candidates of one session. Without either nothing is run again.
    """
    findings = static_issues(confirmed_rows(log, session, order))
    if series:
        reruns = measured(findings.filter(candidates(findings)).select(order, "sql"), *series).select(order, "r", "r0")
    elif execute:
        again = [(r[order], *both_r(execute, r["sql"], r["lag"])) for r in findings.filter(candidates(findings)).select(order, "sql", "lag").toLocalIterator()]
        reruns = log.sparkSession.createDataFrame(again, f"{order} bigint, r double, r0 double")
    else:
        reruns = log.sparkSession.createDataFrame([], f"{order} bigint, r double, r0 double")
    checked = with_reruns(findings, reruns, [order])
    return Audit(checked, rates(log, checked), convergence(checked), recurring_weak(checked))


def write_report(audit: Audit, folder: str, regime: dict[str, float] | None = None) -> None:
    """The audit as audit.md in ``folder``, and the files that the loop reads next time."""
    from lagloom.sources.sinks import markdown_table

    os.makedirs(folder, exist_ok=True)
    regime = regime or fixed.CURRENT_REGIME
    detail = audit.findings.filter(F.size("issues") > 0).select("iteration", "score", F.array_join("issues", ", ").alias("issues"), F.regexp_replace(F.substring("sql", 1, 120), r"\s+", " ").alias("sql")).orderBy("iteration")
    parts = {"Rates": audit.rates, "Repeated hypotheses": audit.convergence, "Recurring weak statements": audit.weak, "Issues": detail}
    with open(os.path.join(folder, "audit.md"), "w", encoding="utf-8") as f:
        f.write(f"# Audit\n\nRegime: {', '.join(f'{k} {v}' for k, v in regime.items())}\n")
        f.writelines(f"\n## {name}\n\n{markdown_table(df)}\n" for name, df in parts.items())
    traps = [r["fingerprint"] for r in audit.convergence.collect()]
    pairs = [r[0] for r in audit.findings.select(F.explode(alias_pairs(F.col("sql")))).distinct().orderBy("col").collect()]
    weak = [f"weak: {r['beginning']}" for r in audit.weak.orderBy("beginning").toLocalIterator()]
    apply_fixes(folder, regime, traps, [*(f"alias: {p}" for p in pairs), *weak])


def merged(old: list[str], new: list[str]) -> list[str]:
    """A blacklist with new entries, each once, in order."""
    return list(dict.fromkeys([*old, *new]))


def apply_fixes(folder: str, regime: dict[str, float], traps: list[str], patterns: list[str]) -> None:
    """Driver-side files that the loop reads: the current regime, the blacklist, and a list of known patterns.

    The blacklist grows by what is new; a pattern is appended once.
    """
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, "regime.json"), "w", encoding="utf-8") as f:
        json.dump(regime, f)
    path = os.path.join(folder, "blacklist.json")
    old = json.load(open(path, encoding="utf-8")) if os.path.exists(path) else []
    with open(path, "w", encoding="utf-8") as f:
        json.dump(merged(old, traps), f, ensure_ascii=False)
    path = os.path.join(folder, "patterns.md")
    known = open(path, encoding="utf-8").read().splitlines() if os.path.exists(path) else []
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(f"{p}\n" for p in merged([], patterns) if p not in known)
