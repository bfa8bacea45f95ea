"""Analytics over run logs: one row per iteration of a session.

Columns: session, iteration, hypothesis, confirmed (true, false, null for partial), score, lag, attempts, errors of the
attempts, timings and tokens. What runs over a session's order is a two-level scan (``prefix``): one session may be the whole log.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.functions import fixed
from lagloom.functions.stats import r4
from lagloom.operators import prefix

#: Runs that a task of ``insert`` holds, about.
ROWS = 1 << 16


def outcome_counts() -> list:
    c = F.col("confirmed")
    return [F.count_if(c).alias("confirmed"), F.count_if(~c).alias("rejected"), F.count_if(c.isNull()).alias("partial")]


def session_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("session").agg(F.count("*").alias("total"), *outcome_counts(), F.coalesce(F.max("score"), F.lit(0)).alias("top_score"), r4(F.coalesce(F.avg("score"), F.lit(0.0))).alias("avg_score"), F.coalesce(F.sum("attempts"), F.lit(0)).cast("bigint").alias("attempts"))


def total_stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total"), *outcome_counts(), r4(F.avg(F.when(F.col("confirmed"), F.col("score")))).alias("avg_confirmed_score"), F.countDistinct("session").alias("sessions"))


def session_summary(log: DataFrame, means: dict[str, str]) -> DataFrame:
    """For each session: iterations, time and tokens in all and by iteration, ``means`` (name -> column) to whole numbers,
    the distribution of lags ('lag:count' in order) and the share of iterations with a repaired statement."""
    lags = log.groupBy("session", "lag").agg(F.count("*").alias("n"))
    spread = lags.groupBy("session").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lag", "n"))), lambda x: F.concat_ws(":", x.lag, x.n)), ",").alias("lag_distribution"))
    n = F.count("*")
    sums = log.groupBy("session").agg(
        n.alias("iterations"), F.round(F.sum("ms") / 1000.0, 1).alias("total_wall_s"), F.round(F.sum("ms") / n / 1000.0, 1).alias("avg_iter_s"),
        F.sum("tokens").cast("bigint").alias("total_tokens"), F.round(F.sum("tokens") / n, 0).alias("avg_tokens_per_iter"),
        *[F.round(F.sum(c) / n, 0).alias(k) for k, c in means.items()],
        F.round(F.count_if(F.col("attempts") > 1) / n * 100, 1).alias("sql_repair_rate"),
    )
    return sums.join(spread, "session")


def session_metrics(log: DataFrame) -> DataFrame:
    """Outcomes, rates and means of each session to one place, and its longest chain; a null score counts as 0."""
    score, n = F.coalesce("score", F.lit(0)), F.count("*")
    share = lambda c: F.round(F.count_if(c) / n * 100, 1)
    sums = log.groupBy("session").agg(
        n.alias("total"), *outcome_counts(), share(F.col("confirmed")).alias("confirmation_rate"), F.round(F.sum(score) / n, 1).alias("avg_score"),
        F.coalesce(F.round(F.avg(F.when(F.col("confirmed"), score)), 1), F.lit(0.0)).alias("avg_confirmed_score"), share(~F.col("sql_ok")).alias("sql_error_rate"),
    )
    return sums.join(chain_depth(log).groupBy("session").agg(F.max("depth").alias("max_chain")), "session")


def session_top(log: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` iterations of each session by score, the earlier first on ties; a null score counts as 0."""
    scored = log.withColumn("score", F.coalesce("score", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("score"), "iteration"))
    return scored.select("session", place.alias("place"), "score", "hypothesis", "confirmed").filter(F.col("place") <= top)


def insert(runs: DataFrame, path: str) -> None:
    """Append runs (session, iteration, attempts, ...) to the table of experiments; those that are there stay.

    They are counted and dealt by key into about ``ROWS`` a task, as a task sorts their whole statements: dealt by session, or
    by the bytes of the log's narrow rows, it would hold more the longer the log is.
    """
    from lagloom.operators.tables import first_by_key

    keys = ["session", "iteration"]
    new = attempt_columns(runs.repartition(max(1, -(-runs.count() // ROWS)), *keys))
    new = first_by_key(new, keys, [F.xxhash64(*[c for c in new.columns if c not in keys])])
    try:
        # By merging: small files of many keys would be taken for a small table, and held whole in every task.
        new = new.join(runs.sparkSession.read.schema(new.schema).parquet(path).select(*keys).hint("merge"), keys, "left_anti")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    new.write.mode("append").parquet(path)


def lag_effectiveness(log: DataFrame) -> DataFrame:
    s = F.col("score")
    return log.groupBy("lag").agg(F.count("*").alias("n"), r4(F.avg(F.coalesce(F.col("confirmed"), F.lit(False)).cast("double")) * 100).alias("confirm_pct"), r4(F.avg(F.when(s != 0, s))).alias("avg_score"))


def attempts_distribution(log: DataFrame) -> DataFrame:
    return log.groupBy("attempts").agg(F.count("*").alias("n"))


def error_types(log: DataFrame, columns: list[str], top: int = 8) -> DataFrame:
    """Frequency over several columns; ties by name."""
    rows = log.select(F.explode(F.array(*columns)).alias("error_type")).filter("error_type is not null and error_type <> ''")
    return rows.groupBy("error_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "error_type").limit(top)


def score_histogram(log: DataFrame, width: int = 10, last: int = 100) -> DataFrame:
    """Bins 0, 10, …, 100, those without rows too; a null score counts as 0."""
    bins = log.sparkSession.range(0, last + 1, width).select(F.col("id").cast("int").alias("bin"))
    own = log.select((F.floor(F.coalesce("score", F.lit(0)) / width) * width).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    return bins.join(own, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def outcome_buckets(log: DataFrame, size: int = 50) -> DataFrame:
    """Outcomes for each ``size`` iterations of a session; bucket is the first iteration's number from 0."""
    rows = _numbered(log.select("session", "iteration", "confirmed"))
    return rows.withColumn("bucket", (F.floor((F.col("rn") - 1) / size) * size).cast("int")).groupBy("session", "bucket").agg(*outcome_counts())


def timing_buckets(log: DataFrame, step: int = 20) -> DataFrame:
    """Mean time and context for each ``step`` iterations; the label is the bucket's middle."""
    rows = _numbered(log.select("session", "iteration", "ms", "context"))
    label = (F.floor((F.col("rn") - 1) / step) * step + step // 2).cast("int")
    return rows.withColumn("label", label).groupBy("session", "label").agg(r4(F.avg("ms")).alias("avg_ms"), r4(F.avg("context")).alias("avg_context"))


def _numbered(log: DataFrame) -> DataFrame:
    """``log`` with rn, the number of each row in its session; a session of any size is cut into ranges (``prefix``)."""
    return prefix.numbered(log, ["session"], ["iteration"], "rn", "iterations")


def rolling_rate(log: DataFrame, window: int = 30, size: int = 4096) -> DataFrame:
    """Share of confirmed among the last ``window`` iterations, from the first full window on.

    Sessions are dealt in pieces of ``size`` iterations that begin with the ``window`` - 1 before them.
    """
    dealt = prefix.pieces(_numbered(log.select("session", "iteration", "confirmed")), "rn", size, window - 1)
    frame = Window.partitionBy("session", "piece").orderBy("rn").rowsBetween(-(window - 1), 0)
    hit = F.coalesce(F.col("confirmed"), F.lit(False)).cast("double")
    rows = dealt.withColumn("rate_pct", r4(F.avg(hit).over(frame) * 100))
    own = F.floor((F.col("rn") - 1) / size) == F.col("piece")
    return rows.filter(own & (F.col("rn") >= window)).select("session", "iteration", "rate_pct")


def cumulative_tokens(log: DataFrame, step: int = 10) -> DataFrame:
    """Tokens so far at every ``step``-th iteration; null before the first known number."""
    cut = prefix.cut(log.select("session", "iteration", "tokens"), ["session"], ["iteration"], "iterations")
    known = F.when(F.col("tokens").isNotNull(), F.lit(1)).cast("bigint")
    rows = prefix.running(cut, ["session"], ["iteration"], {"rn": ("sum", F.lit(1).cast("bigint")), "total": ("sum", F.col("tokens").cast("bigint")), "known": ("max", known)})
    return rows.filter(F.col("rn") % step == 0).select("session", "iteration", F.when(F.col("known").isNotNull(), F.col("total")).alias("tokens"))


def chain_depth(log: DataFrame) -> DataFrame:
    """Iterations in a row that were not rejected; a rejection resets to 0.

    The depth is the distance to the last rejection: running maxima of row numbers and of depths, over ranges of a session.
    """
    cut = prefix.cut(log.select("session", "iteration", "confirmed"), ["session"], ["iteration"], "iterations")
    keys, order = ["session"], ["iteration"]
    rows = prefix.running(cut, keys, order, {"rn": ("sum", F.lit(1).cast("bigint"))})
    rows = prefix.running(rows, keys, order, {"last": ("max", F.when(~F.col("confirmed"), F.col("rn")))})
    deep = rows.withColumn("depth", (F.col("rn") - F.coalesce("last", F.lit(0))).cast("int"))
    return prefix.running(deep, keys, order, {"max_depth": ("max", F.col("depth"))}).select("session", "iteration", "depth", "max_depth")


def top_signals(log: DataFrame, least: int = 70, chars: int = 60, limit: int = 10) -> DataFrame:
    """Confirmed hypotheses of high score, one for each beginning of ``chars`` characters; earliest wins on ties."""
    good = log.filter(F.col("confirmed") & (F.col("score") >= least))
    key = F.substring("hypothesis", 1, chars)
    best = good.groupBy(key.alias("beginning")).agg(F.min_by(F.struct("score", "session", "iteration"), F.struct(-F.col("score"), "session", "iteration")).alias("b"))
    return best.select("beginning", "b.*").orderBy(F.desc("score"), "session", "iteration").limit(limit)


def cost(log: DataFrame, price_in: float = fixed.PRICE_IN, price_out: float = fixed.PRICE_OUT) -> DataFrame:
    return log.agg(F.round(F.sum("tokens_in") / 1e6 * price_in + F.sum("tokens_out") / 1e6 * price_out, 2).alias("cost_usd"))


def repeats(log: DataFrame, fingerprint: str, limit: int = 3) -> DataFrame:
    """The iterations at which a fingerprint has come up ``limit`` times in its session."""
    n = F.row_number().over(Window.partitionBy("session", fingerprint).orderBy("iteration"))
    return log.select("session", "iteration", fingerprint, n.alias("seen")).filter(F.col("seen") >= limit)


def sweep(log: DataFrame, lags: list[int], topics: list[str], reflect_every: int = 5) -> DataFrame:
    """The lag and topic that the loop assigns to each iteration, and whether it reflects there."""
    i = F.col("iteration") - 1
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.pmod(i, F.lit(len(xs))) + 1).cast("int"))
    return log.select("session", "iteration", pick(lags).alias("next_lag"), pick(topics).alias("topic"), (F.col("iteration") % reflect_every == 0).alias("reflects"))


def text2sql_export(log: DataFrame) -> DataFrame:
    """Iterations whose SQL succeeded, best first (scores of null last)."""
    return log.filter("sql_ok").select("session", "iteration", "hypothesis", "sql", "score").orderBy(F.desc_nulls_last("score"), "session", "iteration")


def repair_export(log: DataFrame) -> DataFrame:
    """Failed statements with the repaired ones that followed."""
    return log.filter("error_1 is not null and sql_2 is not null").select("session", "iteration", "sql", "error_1", "error_type_1", "sql_2")


def attempt_columns(runs: DataFrame, most: int = 3) -> DataFrame:
    """``attempts`` (array of sql, error, error_type) as columns sql_1, error_1, error_type_1, … and their number."""
    at = lambda i, f: F.get("attempts", F.lit(i)).getField(f).alias(f"{f}_{i + 1}")
    n = F.coalesce(F.size("attempts"), F.lit(0)).alias("sql_attempts")
    return runs.select(*[c for c in runs.columns if c != "attempts"], n, *[at(i, f) for i in range(most) for f in ("sql", "error", "error_type")])
