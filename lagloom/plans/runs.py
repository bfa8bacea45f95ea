"""Run-log, audit and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lagloom.functions import fixed
from lagloom.functions.text import error_class, hypothesis_fingerprint
from lagloom.operators import audit, lineage, statements, tables
from lagloom.operators import experiments as E
from lagloom.plans import stand_ins as T
from lagloom.plans.registry import query
from lagloom.sources import lines, sinks
from lagloom.sources.shared import new_path
from lagloom.streaming import rollup, traps

_L = f"WITH {T.LOG}"
_OUT = "count(*) FILTER (confirmed) AS confirmed, count(*) FILTER (NOT confirmed) AS rejected, count(*) FILTER (confirmed IS NULL) AS partial"


@query(f"{_L} SELECT session, count(*) AS total, {_OUT}, coalesce(max(score), 0) AS top_score, round(coalesce(avg(score), 0), 4) + 0.0 AS avg_score, CAST(coalesce(sum(attempts), 0) AS BIGINT) AS attempts FROM log GROUP BY session")
def session_stats(spark, d):
    return E.session_stats(T.log(spark, d))


@query(f"{_L} SELECT count(*) AS total, {_OUT}, round(avg(CASE WHEN confirmed THEN score END), 4) + 0.0 AS avg_confirmed_score, count(DISTINCT session) AS sessions FROM log")
def total_stats(spark, d):
    return E.total_stats(T.log(spark, d))


_MEANS = {"avg_rag_ms": "ms_rag", "avg_news_ms": "ms_news", "avg_sql_ms": "ms_sql", "avg_llm_gen_ms": "ms_generate", "avg_llm_eval_ms": "ms_evaluate", "avg_ctx_rag_chars": "context", "avg_ctx_news_chars": "context_news"}


@query(f"""{_L}, l AS (SELECT session, lag, count(*) AS n FROM log GROUP BY ALL), s AS (SELECT session, string_agg(lag || ':' || n, ',' ORDER BY lag) AS lag_distribution FROM l GROUP BY session)
SELECT session, count(*) AS iterations, round(sum(ms) / 1000.0, 1) AS total_wall_s, round(sum(ms) / count(*) / 1000.0, 1) AS avg_iter_s, CAST(sum(tokens) AS BIGINT) AS total_tokens, round(sum(tokens) / count(*), 0) AS avg_tokens_per_iter,
  {", ".join(f"round(sum({c}) / count(*), 0) AS {k}" for k, c in _MEANS.items())}, any_value(lag_distribution) AS lag_distribution, round(count(*) FILTER (attempts > 1) / count(*) * 100, 1) AS sql_repair_rate
FROM log JOIN s USING (session) GROUP BY session""")
def session_summary(spark, d):
    return E.session_summary(T.log(spark, d), _MEANS)


_DEPTH = """i AS (SELECT *, sum(CASE WHEN NOT confirmed THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY iteration) AS island FROM typed),
p AS (SELECT *, sum(CASE WHEN NOT confirmed THEN 0 ELSE 1 END) OVER (PARTITION BY session, island ORDER BY iteration) AS depth FROM i)"""


@query(f"{_L} SELECT lag, count(*) AS n, round(avg(CAST(coalesce(confirmed, false) AS DOUBLE)) * 100, 4) + 0.0 AS confirm_pct, round(avg(CASE WHEN score <> 0 THEN score END), 4) + 0.0 AS avg_score FROM log GROUP BY lag")
def lag_effectiveness(spark, d):
    return E.lag_effectiveness(T.log(spark, d))


@query(f"{_L} SELECT attempts, count(*) AS n FROM log GROUP BY attempts")
def attempts_distribution(spark, d):
    return E.attempts_distribution(T.log(spark, d))


_CLASS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower({{0}}), '{p.lower()}')" for p in ps) + f" THEN '{k}'" for k, ps in fixed.ERROR_CLASSES.items() if ps) + " ELSE 'unknown' END"


def _typed(spark, d):
    log = T.log(spark, d)
    typed = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", error_class(F.col(c)))
    return log.withColumns({"error_type_1": typed("error_1"), "error_type_2": typed("error_2"), "error_type_3": typed("error_3"), "sql_2": F.when(F.col("attempts") > 1, F.concat("sql", F.lit(" -- 2"))), "sql_ok": (F.col("attempts") < 3) | F.col("error_2").isNull()})


_T1, _T2, _T3 = (f"CASE WHEN coalesce({c}, '') <> '' THEN {_CLASS.format(c)} END" for c in ("error_1", "error_2", "error_3"))
_TYPED = f"{_L}, typed AS (SELECT *, {_T1} AS error_type_1, {_T2} AS error_type_2, {_T3} AS error_type_3, CASE WHEN attempts > 1 THEN sql || ' -- 2' END AS sql_2, attempts < 3 OR error_2 IS NULL AS sql_ok FROM log)"


@query(f"{_TYPED}, e AS (SELECT error_type_1 AS error_type FROM typed UNION ALL SELECT error_type_2 FROM typed UNION ALL SELECT error_type_3 FROM typed) SELECT error_type, count(*) AS n FROM e WHERE error_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, error_type LIMIT 8")
def error_type_frequency(spark, d):
    return E.error_types(_typed(spark, d), ["error_type_1", "error_type_2", "error_type_3"])


@query(f"{_TYPED} SELECT event_id, error_type_1, error_type_2, error_type_3 FROM typed")
def error_taxonomy(spark, d):
    return _typed(spark, d).select("event_id", "error_type_1", "error_type_2", "error_type_3")


@query(f"""{_TYPED}, {_DEPTH} SELECT session, count(*) AS total, {_OUT}, round(count(*) FILTER (confirmed) / count(*) * 100, 1) AS confirmation_rate, round(sum(coalesce(score, 0)) / count(*), 1) AS avg_score,
coalesce(round(avg(coalesce(score, 0)) FILTER (confirmed), 1), 0.0) AS avg_confirmed_score, round(count(*) FILTER (NOT sql_ok) / count(*) * 100, 1) AS sql_error_rate, CAST(max(depth) AS INTEGER) AS max_chain FROM p GROUP BY session""")
def session_metrics(spark, d):
    return E.session_metrics(_typed(spark, d))


@query(f"{_L} SELECT session, CAST(row_number() OVER (PARTITION BY session ORDER BY coalesce(score, 0) DESC, iteration) AS INTEGER) AS place, coalesce(score, 0) AS score, hypothesis, confirmed FROM log QUALIFY row_number() OVER (PARTITION BY session ORDER BY coalesce(score, 0) DESC, iteration) <= 3")
def session_top(spark, d):
    return E.session_top(T.log(spark, d))


@query(f"{_TYPED}, a AS (SELECT event_id, session, iteration, attempts, [{{'sql': sql, 'error': error_1, 'error_type': error_type_1}}, {{'sql': sql_2, 'error': error_2, 'error_type': error_type_2}}, {{'sql': NULL, 'error': error_3, 'error_type': error_type_3}}][1:attempts] AS tries FROM typed) SELECT session, iteration, len(tries) AS sql_attempts, {', '.join(f'tries[{i}].{f} AS {f}_{i}' for i in (1, 2, 3) for f in ('sql', 'error', 'error_type'))} FROM a")
def experiment_insert(spark, d):
    t = _typed(spark, d)
    tries = F.array(*[F.struct((F.col(q) if q else F.lit(None).cast("string")).alias("sql"), F.col(f"error_{i}").alias("error"), F.col(f"error_type_{i}").alias("error_type")) for i, q in ((1, "sql"), (2, "sql_2"), (3, None))])
    runs = t.select("session", "iteration", F.slice(tries, F.lit(1), F.col("attempts")).alias("attempts"))
    path = new_path(spark, "experiments")
    # Twice, as after a crash: the second insert adds nothing.
    E.insert(runs, path)
    E.insert(runs, path)
    return spark.read.schema(E.attempt_columns(runs).schema).parquet(path)


@query("SELECT to_json({'event_id': event_id, 'event_type': event_type, 'user_id': user_id}) AS value FROM events")
def json_log(spark, d):
    return sinks.json_rows(T.table(spark, d, "events").select("event_id", "event_type", "user_id"))


@query(f"{_TYPED} SELECT session, iteration, hypothesis, sql, score FROM typed WHERE sql_ok")
def text2sql_export(spark, d):
    return E.text2sql_export(_typed(spark, d))


@query(f"{_TYPED} SELECT session, iteration, sql, error_1, error_type_1, sql_2 FROM typed WHERE error_1 IS NOT NULL AND sql_2 IS NOT NULL")
def repair_export(spark, d):
    return E.repair_export(_typed(spark, d))


@query(f"{_L}, b AS (SELECT CAST(unnest(range(0, 101, 10)) AS INTEGER) AS bin) SELECT bin, count(event_id) AS n FROM b LEFT JOIN log ON coalesce(score, 0) // 10 * 10 = bin GROUP BY bin")
def score_histogram(spark, d):
    return E.score_histogram(T.log(spark, d))


@query(f"{_L} SELECT session, CAST((iteration - 1) // 50 * 50 AS INTEGER) AS bucket, {_OUT} FROM log GROUP BY 1, 2")
def outcome_buckets(spark, d):
    return E.outcome_buckets(T.log(spark, d))


@query(f"{_L} SELECT session, CAST((iteration - 1) // 20 * 20 + 10 AS INTEGER) AS label, round(avg(ms), 4) + 0.0 AS avg_ms, round(avg(context), 4) + 0.0 AS avg_context FROM log GROUP BY 1, 2")
def timing_buckets(spark, d):
    return E.timing_buckets(T.log(spark, d))


@query(f"""{_L}, r AS (SELECT session, iteration, round(avg(CAST(coalesce(confirmed, false) AS DOUBLE)) OVER (PARTITION BY session ORDER BY iteration ROWS 29 PRECEDING) * 100, 4) + 0.0 AS rate_pct FROM log) SELECT * FROM r WHERE iteration >= 30""")
def rolling_confirm_rate(spark, d):
    return E.rolling_rate(T.log(spark, d))


@query(f"{_L}, c AS (SELECT session, iteration, CAST(sum(tokens) OVER (PARTITION BY session ORDER BY iteration) AS BIGINT) AS tokens FROM log) SELECT * FROM c WHERE iteration % 10 = 0")
def cumulative_tokens(spark, d):
    return E.cumulative_tokens(T.log(spark, d))


@query(f"""{_L}, i AS (SELECT session, iteration, confirmed, sum(CASE WHEN NOT confirmed THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY iteration) AS island FROM log),
p AS (SELECT session, iteration, CAST(sum(CASE WHEN NOT confirmed THEN 0 ELSE 1 END) OVER (PARTITION BY session, island ORDER BY iteration) AS INTEGER) AS depth FROM i)
SELECT *, max(depth) OVER (PARTITION BY session ORDER BY iteration) AS max_depth FROM p""")
def chain_depth(spark, d):
    return E.chain_depth(T.log(spark, d))


@query(f"""{_L}, g AS (SELECT hypothesis[1:60] AS beginning, score, session, iteration FROM log WHERE confirmed AND score >= 70 QUALIFY row_number() OVER (PARTITION BY hypothesis[1:60] ORDER BY score DESC, session, iteration) = 1)
SELECT * FROM g ORDER BY score DESC, session, iteration LIMIT 10""")
def top_signals(spark, d):
    return E.top_signals(T.log(spark, d))


@query(f"{_L} SELECT round(sum(tokens_in) / 1e6 * 0.014 + sum(tokens_out) / 1e6 * 0.028, 2) AS cost_usd FROM log")
def token_cost(spark, d):
    return E.cost(T.log(spark, d))


_FP = "regexp_replace(trim(lower(hypothesis[1:55])), '\\d+', 'N', 'g')"


@query(f"{_L} SELECT {_FP} AS fingerprint, count(*) AS n FROM log GROUP BY 1 HAVING count(*) >= 3")
def fingerprint_convergence(spark, d):
    return audit.convergence(T.log(spark, d), top=None)


_LATEST = "(SELECT session FROM log ORDER BY event_id DESC LIMIT 1)"


@query(f"{_L} SELECT {_FP} AS fingerprint, count(*) AS n FROM log WHERE confirmed AND session = {_LATEST} GROUP BY 1 HAVING count(*) >= 3 ORDER BY n DESC, fingerprint LIMIT 5")
def convergence_top(spark, d):
    return audit.convergence(audit.confirmed_rows(T.log(spark, d)))


@query(f"{_L}, f AS (SELECT session, iteration, {_FP} AS fp FROM log), n AS (SELECT *, CAST(row_number() OVER (PARTITION BY session, fp ORDER BY iteration) AS INTEGER) AS seen FROM f) SELECT * FROM n WHERE seen >= 3")
def repeat_block(spark, d):
    return E.repeats(T.log(spark, d).withColumn("fp", hypothesis_fingerprint(F.col("hypothesis"))), "fp")


@query(f"{_L}, f AS (SELECT session, iteration, {_FP} AS fp FROM log), n AS (SELECT *, row_number() OVER (PARTITION BY session, fp ORDER BY iteration) AS seen FROM f) SELECT * FROM n WHERE seen >= 3")
def repeat_block_stream(spark, d):
    """The same while the log grows: iterations come in three parts, and the query is started again on its checkpoint for each."""
    src, out, seen = (new_path(spark, n) for n in ("growing", "blocked", "counters"))
    log = T.log(spark, d).select("session", "iteration", hypothesis_fingerprint(F.col("hypothesis")).alias("fp"), F.timestamp_seconds("iteration").alias("at"))
    for part in ("iteration <= 10", "iteration between 11 and 40", "iteration > 40"):
        log.filter(part).write.mode("append").parquet(src)
        rows = traps.repeats(spark.readStream.schema(log.schema).parquet(src), "fp", "at", buckets=1024)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out)


_NAMES, _COLS = "|".join(fixed.FOREIGN_INSTRUMENTS), "|".join(fixed.CONTEXT_COLUMNS)
_ALIAS = f"regexp_matches(sql, '(?i)\\b({_COLS})\\s+AS\\s+({_NAMES})\\b')"
_TEXT = "lower(sql || ' ' || hypothesis)"
_TAUT = f"(contains({_TEXT}, 'eur_rub') AND contains({_TEXT}, 'usd_rub'))"
_OFF = "(" + " OR ".join(f"regexp_matches({_TEXT}, '{p.replace(chr(39), chr(39) * 2)}')" for p in fixed.INACTIVE_REGIME) + ")"
_ON = "(" + " OR ".join(f"regexp_matches({_TEXT}, '{p.replace(chr(39), chr(39) * 2)}')" for p in fixed.ACTIVE_REGIME) + ")"
_STRUCT = "(" + " OR ".join(f"regexp_matches({_TEXT}, '{p}')" for p in fixed.STRUCTURAL) + ")"
_ISSUES = f"""{_L}, a AS (SELECT event_id, list_filter([CASE WHEN {_ALIAS} THEN 'ALIASING' END, CASE WHEN {_TAUT} THEN 'TAUTOLOGY' END, CASE WHEN {_OFF} AND NOT {_ON} THEN 'REGIME_INACTIVE' END], lambda x: x IS NOT NULL) AS one, {_STRUCT} AS st FROM log),
issues AS (SELECT event_id, CASE WHEN len(one) = 0 AND st THEN ['STRUCTURAL'] ELSE one END AS issues FROM a)"""


@query(f"{_L} SELECT event_id, {_ALIAS} AS aliasing FROM log")
def aliasing_check(spark, d):
    return T.log(spark, d).select("event_id", audit.aliasing(F.col("sql")).alias("aliasing"))


@query(f"{_L} SELECT event_id, {_TAUT} AS tautology FROM log")
def tautology_check(spark, d):
    return T.log(spark, d).select("event_id", audit.tautology(F.concat_ws(" ", "sql", "hypothesis")).alias("tautology"))


@query(f"{_L} SELECT event_id, {_OFF} AND NOT {_ON} AS inactive FROM log")
def regime_inactive_check(spark, d):
    return T.log(spark, d).select("event_id", audit.inactive_regime(F.concat_ws(" ", "sql", "hypothesis")).alias("inactive"))


@query(f"{_ISSUES} SELECT event_id, array_to_string(issues, ',') AS issues FROM issues")
def audit_issues(spark, d):
    return audit.static_issues(T.log(spark, d)).select("event_id", F.array_join("issues", ",").alias("issues"))


#: Statements of the log's findings: a market series against an index, at the finding's lag, some within a period, some of another shape.
_INSTRUMENTS, _INDEXES, _PERIOD = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], ["AF", "NO", "RF"], ("1996-01-01", "1998-06-30")
_PICK = f"CASE WHEN k % 13 <> 0 THEN {_INSTRUMENTS!r}[k % 5 + 1] END AS source, {_INDEXES!r}[k % 3 + 1] AS target, k % 4 = 1 AS within"
_AUDITED = f"""WITH {T.MARKET}, {T.INDICES}, {T.LOG}, grid AS (
  SELECT instrument AS source, ticker AS target, lag_days AS lag, within, CASE WHEN isnan(corr(m.close, i.close)) THEN NULL ELSE round(corr(m.close, i.close), 4) + 0.0 END AS r
  FROM market m CROSS JOIN (VALUES (0), (7), (14), (30), (60), (90)) l(lag_days) CROSS JOIN (VALUES (true), (false)) w(within) JOIN indices i ON i.trade_date = m.trade_date + lag_days
  WHERE NOT within OR m.trade_date BETWEEN DATE '{_PERIOD[0]}' AND DATE '{_PERIOD[1]}' GROUP BY ALL
), asked AS (SELECT event_id, lag, {_PICK} FROM log), reruns AS (
  SELECT event_id, g.r, CASE WHEN asked.lag > 0 THEN z.r END AS r0 FROM asked LEFT JOIN grid g USING (source, target, lag, within)
  LEFT JOIN grid z ON z.source = asked.source AND z.target = asked.target AND z.within = asked.within AND z.lag = 0
), told AS (
  SELECT *, list_filter([CASE WHEN {_ALIAS} THEN 'ALIASING' END, CASE WHEN {_TAUT} THEN 'TAUTOLOGY' END, CASE WHEN {_OFF} AND NOT {_ON} THEN 'REGIME_INACTIVE' END], lambda x: x IS NOT NULL) AS one, {_STRUCT} AS st FROM log WHERE confirmed
), static AS (SELECT *, CASE WHEN len(one) = 0 AND st THEN ['STRUCTURAL'] ELSE one END AS before FROM told
), audited AS (
  SELECT static.*, CASE
      WHEN len(before) > 0 OR coalesce(score, 0) < 65 OR sql = '' OR r IS NULL THEN before
      WHEN lag > 0 AND r0 IS NOT NULL AND abs(abs(r) - abs(r0)) < 0.08 THEN ['STRUCTURAL']
      WHEN abs(r) < 0.3 THEN ['WEAK_R'] ELSE before END AS issues
  FROM static JOIN reruns USING (event_id))"""


def _statement():
    """A finding of the log as a statement."""
    k = F.col("k")
    of = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    later = F.when(F.col("lag") > 0, F.concat(F.lit(" + INTERVAL "), F.col("lag").cast("string"), F.lit(" DAYS"))).otherwise("")
    period = F.when(k % 4 == 1, f" AND s.trade_date BETWEEN DATE '{_PERIOD[0]}' AND DATE '{_PERIOD[1]}'").otherwise("")
    text = F.concat(F.lit("SELECT CORR(s.close, t.close) AS r, COUNT(*) AS n\n FROM market s JOIN indices t ON t.trade_date = s.trade_date"), later, F.lit(" WHERE s.instrument = '"), of(_INSTRUMENTS, 5), F.lit("' AND t.ticker = '"), of(_INDEXES, 3), F.lit("'"), period)
    return F.when(k % 13 != 0, text).otherwise("SELECT 1").alias("statement")


def _stated(spark, d):
    """(event_id, statement): the log's findings as statements."""
    return T.log(spark, d).select("event_id", _statement())


def _series(spark, d):
    market = T.market(spark, d).select(F.col("instrument").alias("source"), F.col("trade_date").alias("day"), F.col("close").alias("x"))
    return market, T.indices(spark, d).select(F.col("ticker").alias("target"), F.col("trade_date").alias("day"), F.col("close").alias("y"))


def _audited(spark, d, confirmed=None):
    """The confirmed rows (by default of all sessions) with their issues; their statements are measured in one grid.

    A row holds its own statement, so r comes to it by the text alone, and the log is neither joined with itself nor shuffled.
    """
    confirmed = T.log(spark, d).filter("confirmed") if confirmed is None else confirmed
    stated = audit.static_issues(confirmed).select("event_id", "session", "iteration", "score", "lag", "hypothesis", "sql", "issues", _statement())
    return audit.told_again(statements.measured(stated, *_series(spark, d), sql="statement"))


@query(f"{_AUDITED} SELECT event_id, r, r0 FROM reruns")
def statement_reruns(spark, d):
    return statements.measured(_stated(spark, d), *_series(spark, d), sql="statement").select("event_id", "r", "r0")


@query(f"{_L} SELECT event_id, CASE WHEN k % 5 <> 4 AND k % 4 <> 3 AND k % 3 <> 2 THEN [['usd_rub', 'eur_rub', 'brent_usd', 'close'][k % 4 + 1] || ' AS ' || ['dxy', 'silver', 'price'][k % 3 + 1]] ELSE [] END AS pairs FROM log")
def alias_lineage(spark, d):
    """Statements that rename a context column in two steps; those that can't be parsed have no pairs."""
    part = lambda n: F.regexp_extract("sql", r"^SELECT (\w+) AS (\w+) (FROM ctx.*)$", n)
    deep = F.concat(F.lit("WITH a AS (SELECT "), part(1), F.lit(" * 1 AS v "), part(3), F.lit(") SELECT v AS "), part(2), F.lit(" FROM a"))
    ctx = StructType([StructField(c, DoubleType()) for c in [*fixed.CONTEXT_COLUMNS, "close", "rugold"]])
    return lineage.checked(T.log(spark, d).select("event_id", deep.alias("deep")), "event_id", "deep", {"ctx": ctx})


@query(f"{_AUDITED} SELECT unnest(CASE WHEN len(issues) = 0 THEN ['CLEAN'] ELSE issues END) AS issue, count(*) AS n FROM audited GROUP BY 1")
def audit_summary(spark, d):
    return audit.summary(_audited(spark, d))


@query(f"{_AUDITED} SELECT event_id, session, iteration, score, array_to_string(issues, ',') AS issues FROM audited WHERE session = {_LATEST}")
def audit_run(spark, d):
    log = T.log(spark, d)
    # One row; as a filter on the session it reaches the scan, before iterations are numbered.
    last = tables.latest(log, "session", "event_id").first()["session"]
    return _audited(spark, d, audit.confirmed_rows(log, last)).select("event_id", "session", "iteration", "score", F.array_join("issues", ",").alias("issues"))


@query(f"""{_AUDITED}, t AS (SELECT session, count(*) AS total FROM log GROUP BY session),
c AS (SELECT session, count(*) AS convergence_traps FROM (SELECT session, {_FP} AS f FROM audited GROUP BY ALL HAVING count(*) >= 3) GROUP BY session),
a AS (SELECT session, count(*) AS confirmed_raw, count(*) FILTER (len(issues) = 0) AS clean_confirmed, {", ".join(f"count(*) FILTER (list_contains(issues, '{v}')) AS {k}" for k, v in audit.KINDS.items())}, CAST(sum(len(issues)) AS BIGINT) AS total_issues FROM audited GROUP BY session)
SELECT t.session, total, a.* EXCLUDE (session), coalesce(convergence_traps, 0) AS convergence_traps, round(confirmed_raw / total * 100, 1) AS raw_rate, round(clean_confirmed / total * 100, 1) AS clean_rate FROM t JOIN a USING (session) LEFT JOIN c USING (session)""")
def audit_rates(spark, d):
    return audit.rates(T.log(spark, d), _audited(spark, d))


@query(f"{_AUDITED} SELECT trim(regexp_replace(lower(sql[1:80]), '\\s+', ' ', 'g')) AS beginning, count(*) AS n FROM audited WHERE list_contains(issues, 'WEAK_R') GROUP BY ALL HAVING count(*) >= 3")
def recurring_weak(spark, d):
    return audit.recurring_weak(_audited(spark, d), by=[])


@query(f"{_L} SELECT event_id, list_filter([{', '.join(f'CASE WHEN regexp_matches(sql, $$(?i)' + chr(92) + f'b{c}' + chr(92) + f's+AS' + chr(92) + f's+{i}' + chr(92) + f'b$$) THEN $${c} AS {i}$$ END' for i in fixed.FOREIGN_INSTRUMENTS for c in fixed.CONTEXT_COLUMNS)}], lambda x: x IS NOT NULL) AS pairs FROM log WHERE confirmed")
def alias_pairs(spark, d):
    return T.log(spark, d).filter("confirmed").select("event_id", audit.alias_pairs(F.col("sql")).alias("pairs"))


@query(f"{_L} SELECT last(session ORDER BY event_id) AS session FROM log")
def latest_session(spark, d):
    return tables.latest(T.log(spark, d), "session", "event_id")


@query(f"{_L} SELECT session, iteration, [0, 7, 14, 30, 60, 90][(iteration - 1) % 6 + 1] AS next_lag, ['oil', 'rate', 'ruble', 'sanctions', 'inflation', 'banking', 'gold'][(iteration - 1) % 7 + 1] AS topic, iteration % 5 = 0 AS reflects FROM log")
def lag_topic_sweep(spark, d):
    return E.sweep(T.log(spark, d), fixed.LAGS, list(fixed.TOPICS))


def _event_lines(spark, d):
    """The events as JSON lines in the shared folder, written by the tasks, in folders by type."""
    path = new_path(spark, "event-lines")
    T.table(spark, d, "events").select("event_type", "event_id", "user_id", "value").write.partitionBy("event_type").json(path)
    return path


@query("SELECT event_type, user_id, count(*) AS n, max(event_id) AS last FROM events WHERE event_type IN ('purchase', 'error') AND user_id > 20 GROUP BY ALL")
def line_ranges_scan(spark, d):
    """JSON lines by byte ranges: the types are chosen by folder while planning, users before rows are made."""
    rows = lines.read(spark, _event_lines(spark, d), "event_type string, event_id long, user_id long, value double", 1 << 16, push=True)
    return rows.filter("event_type in ('purchase', 'error') and user_id > 20").groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def line_ranges_stream(spark, d):
    """The same lines as a stream into a table; the query is started twice on one checkpoint, and reads each line once."""
    path, out, seen = _event_lines(spark, d), new_path(spark, "streamed"), new_path(spark, "offsets")
    for _ in range(2):
        rows = lines.stream(spark, path, "event_type string, event_id long, user_id long", 1 << 16)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming_event_rollup(spark, d):
    out = new_path(spark, "rollup")
    rollup.event_counts(spark, f"{d}/events.parquet", out, new_path(spark, "stream"))
    return rollup.counted(spark, out)
