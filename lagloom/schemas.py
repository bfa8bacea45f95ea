"""Types of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructType


def _struct(ddl: str) -> StructType:
    out = StructType()
    names = {"string": "string", "double": "double", "int": "integer", "date": "date", "bigint": "long", "boolean": "boolean"}
    for part in ddl.split(", "):
        name, kind = part.split()
        out = out.add(name, names[kind])
    return out


INDICES = _struct("ticker string, trade_date date, close double, open double, high double, low double, value double, volume double, currency string")
KEY_RATE = _struct("period string, rate_pct double, inflation double, days_to_meeting int")
FOREX = _struct("trade_date date, currency string, rate double, nominal int")
MARKET = _struct("trade_date date, instrument string, close double, open double, high double, low double, change_pct double")
MACRO = _struct("period string, indicator string, region string, value double, unit string, source_file string")
NEWS_DAILY = _struct("news_date date, oil int, rate int, ruble int, sanctions int, inflation int, banking int, gold int")
ARTICLES = _struct("id string, source string, date string, text string, extra_fields string, loaded_at string")
PROGRESS = _struct("subset string, status string, rows_loaded bigint, started_at string, finished_at string")
SIGNALS = _struct("ts string, hypothesis string, confirmed boolean, signal_score int, finding string, signal_brief string, next_hypothesis string, sql string")

# The fields of the logs and of the chunk collections as they are stored, in their order.
EXPERIMENTS = _struct(
    "id bigint, session_id string, iteration int, ts string, hypothesis string, rationale string, expected_signal string, "
    "sql_v1 string, sql_v1_error string, sql_v1_error_type string, sql_v2 string, sql_v2_error string, sql_v2_error_type string, "
    "sql_v3 string, sql_v3_error string, sql_v3_error_type string, sql_final string, sql_attempts int, sql_success int, rows_count int, "
    "confirmed int, signal_score int, finding string, signal_brief string, next_hypothesis string, principles_version string, "
    "knowledge_lines int, lag_days int"
)
TELEMETRY = _struct(
    "session_id string, iteration int, lag_days int, ts string, t_rag_ms int, t_news_ms int, t_llm_gen_ms int, t_sql_ms int, "
    "t_llm_eval_ms int, t_total_ms int, tok_gen_in int, tok_gen_out int, tok_eval_in int, tok_eval_out int, ctx_rag_fragments int, "
    "ctx_rag_chars int, ctx_news_articles int, ctx_news_chars int, ctx_schema_chars int, ctx_knowledge_chars int, "
    "ctx_principles_chars int, sql_attempts int, sql_success boolean, sql_rows int, signal_score int, confirmed boolean, "
    "tok_gen_total int, tok_eval_total int, tok_session_total int"
)
CHUNKS = _struct("id string, company string, year int, source string, filename string, page int, chunk int, document string").add("embedding", ArrayType(FloatType()))


def log_of(experiments: DataFrame) -> DataFrame:
    """Stored experiments as the log that ``operators.experiments`` and ``operators.audit`` read."""
    c = F.col
    return experiments.select(
        c("id").alias("event_id"), c("session_id").alias("session"), "iteration", "hypothesis", c("sql_final").alias("sql"), c("confirmed").cast("boolean").alias("confirmed"),
        c("signal_score").alias("score"), c("lag_days").alias("lag"), c("sql_attempts").alias("attempts"), c("sql_success").cast("boolean").alias("sql_ok"),
        *[c(f"sql_v{i}_error").alias(f"error_{i}") for i in (1, 2, 3)], *[c(f"sql_v{i}_error_type").alias(f"error_type_{i}") for i in (1, 2, 3)], c("sql_v2").alias("sql_2"),
    )


def times_of(telemetry: DataFrame) -> DataFrame:
    """Stored telemetry with the names that session summaries read."""
    names = {"session_id": "session", "lag_days": "lag", "sql_attempts": "attempts", "t_total_ms": "ms", "tok_session_total": "tokens", "t_rag_ms": "ms_rag", "t_news_ms": "ms_news", "t_sql_ms": "ms_sql", "t_llm_gen_ms": "ms_generate", "t_llm_eval_ms": "ms_evaluate", "ctx_rag_chars": "context", "ctx_news_chars": "context_news"}
    return telemetry.select("iteration", *[F.col(k).alias(v) for k, v in names.items()])


#: Primary keys, held by operators.tables and checked by operators.quality.
KEYS = {"indices": ["ticker", "trade_date"], "forex": ["trade_date", "currency"], "market": ["trade_date", "instrument"], "news_daily": ["news_date"]}

__all__ = ["ARTICLES", "CHUNKS", "EXPERIMENTS", "FOREX", "INDICES", "KEYS", "KEY_RATE", "MACRO", "MARKET", "NEWS_DAILY", "PROGRESS", "SIGNALS", "TELEMETRY", "log_of", "times_of"]
