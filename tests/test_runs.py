import json
import random

from pyspark.sql import functions as F

from lagloom.functions import fixed
from lagloom.operators import audit, loop, quality, tables
from lagloom.operators import experiments as E


def log(spark, rows):
    return spark.createDataFrame([(1, i + 1, c, s, f"h {i}") for i, (c, s) in enumerate(rows)], "session int, iteration int, confirmed boolean, score int, hypothesis string")


def test_chain_depth(spark):
    rows = E.chain_depth(log(spark, [(True, 1), (None, 1), (True, 1), (False, 1), (True, 1)])).orderBy("iteration").collect()
    assert [r["depth"] for r in rows] == [1, 2, 3, 0, 1]
    assert rows[-1]["max_depth"] == 3


def test_rolling_needs_a_full_window(spark):
    assert [E.rolling_rate(log(spark, [(True, 1)] * n)).count() for n in (29, 30, 31)] == [0, 1, 2]


def test_histogram_is_dense(spark):
    got = {r["bin"]: r["n"] for r in E.score_histogram(log(spark, [(None, s) for s in (None, 0, 9, 10, 100)])).collect()}
    assert got == {0: 3, 10: 1, 100: 1} | dict.fromkeys(range(20, 100, 10), 0)


def test_keys_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, None)], "k string, n int, v string")
    assert {(r["k"], r["v"]) for r in tables.first_by_key(df, ["k"], [F.col("n")]).collect()} == {("a", "x"), ("b", None)}
    assert {(r["k"], r["v"]) for r in tables.last_by_key(df, ["k"], [F.col("n")]).collect()} == {("a", "y"), ("b", None)}
    old = spark.createDataFrame([("a", 0, "old")], "k string, n int, v string")
    assert {(r["k"], r["v"]) for r in tables.insert_or_ignore(old, df, ["k"], [F.col("n")]).collect()} == {("a", "old"), ("b", None)}
    assert {(r["k"], r["v"]) for r in tables.upsert(old, df, ["k"], [F.col("n")]).collect()} == {("a", "y"), ("b", None)}


def test_audit(spark):
    rows = [
        ("SELECT usd_rub AS dxy FROM c", "x", "ALIASING"),
        ("SELECT eur_rub, usd_rub", "x", "TAUTOLOGY"),
        ("WHERE key_rate_pct < 15", "x", "REGIME_INACTIVE"),
        ("WHERE key_rate_pct < 15 OR key_rate_pct > 20", "x", ""),
        ("SELECT 1", "silver leads rugold", "STRUCTURAL"),
        ("SELECT usd_rub AS silver", "silver and rugold", "ALIASING"),
        (None, None, ""),
    ]
    df = spark.createDataFrame([r[:2] for r in rows], "sql string, hypothesis string")
    assert [",".join(r["issues"]) for r in audit.static_issues(df).collect()] == [r[2] for r in rows]
    assert audit.without_lag("d + INTERVAL 14 DAYS, INTERVAL '7 days', INTERVAL 3 DAY") == "d + INTERVAL 0 DAYS, INTERVAL 0 DAYS, INTERVAL 0 DAYS"
    assert audit.rerun(lambda s: [(14, 0.5 if "14" in s else -0.46, 900)], "x INTERVAL 14 DAYS") == "STRUCTURAL"
    assert audit.rerun(lambda s: [(14, 0.2 if "14" in s else 0.9, 900)], "x INTERVAL 14 DAYS") == "WEAK_R"


def test_repair_loop(spark):
    spark.range(3).createOrReplaceTempView("three")
    run = loop.spark_runner(spark)
    columns, rows, attempts = loop.execute_with_repair(run, "SELECT nope FROM three", lambda sql, e, kind: f"```sql\nSELECT id FROM three -- {kind}\n```")
    assert (columns, len(rows), len(attempts), attempts[0].error_type) == (["id"], 3, 2, "schema_column")
    # Errors of execution show only on an action.
    assert loop.execute_with_repair(run, "SELECT CAST('x' AS INT) AS n", lambda *a: "SELECT 1 AS n")[2][0].error_type == "type_cast"
    try:
        loop.execute_with_repair(run, "SELEC 1", lambda sql, *_: sql)
        raise AssertionError
    except Exception as e:
        assert loop.classify_error(str(e)) == "syntax"


def same(context, lag, known):
    return f'ok {{"hypothesis": "Lag {lag} same", "sql": "SELECT 0.7D AS r, 200 AS n", "next_hypothesis": "go on"}}'


def test_loop_sweeps_and_blocks(spark):
    """The third time of a hypothesis blocks it: from then on the next context is another topic."""
    made = loop.Loop(same, loop.spark_runner(spark), jump=0.0, seed=1, blacklist=set())(6)
    assert [r["lag"] for r in made] == [0, 7, 14, 30, 60, 90]
    assert [r["blocked"] for r in made] == [False, False, True, True, True, True]
    assert [r["jump"] for r in made] == [None, None, "repeat", "repeat", "topic", "repeat"]
    assert made[0]["confirmed"] is True and made[0]["score"] == 70
    assert made[1]["context"] == "go on" and made[3]["context"] in fixed.TOPICS and made[5]["context"] == next(iter(fixed.TOPICS))


def test_loop_ends_in_time_and_jumps_at_random(spark):
    ticks = iter(range(0, 1000, 10))
    made = loop.Loop(lambda c, lag, k: '{"hypothesis": "h%d"}' % next(ticks), lambda sql: ([], []), clock=lambda: next(ticks), max_seconds=100)(50)
    assert 2 < len(made) < 8
    jumps = [r["jump"] for r in loop.Loop(lambda c, lag, k: '{"hypothesis": "%s", "next_hypothesis": "%s"}' % (chr(97 + len(c) % 26) * 9, c[:20]), lambda sql: ([], []), seed=3, repeat_limit=10**9)(400)]
    assert jumps.count("topic") == 80 and 50 < jumps.count("random") < 110


def test_n_comes_from_the_statement():
    assert loop.sample_size(["r", "n"], [(0.5, 900)]) == 900
    assert loop.sample_size(["lag", "r", "rows"], [(1, 0.5, 77)]) == 77
    assert loop.sample_size(["r"], [(0.5,), (0.4,)]) == 0
    assert loop.sample_size(["ok", "n"], [(True, None), (True, 12)]) == 12


def test_a_long_result_is_an_error_not_a_cut(spark):
    run = loop.spark_runner(spark, 10)
    assert len(run("SELECT id FROM range(10)")[1]) == 10
    try:
        run("SELECT id FROM range(11)")
        raise AssertionError
    except ValueError as e:
        assert "more than 10 rows" in str(e)
    assert loop.bound_runner(spark, least=8)("SELECT id FROM range(10) WHERE id >= :least") == [(8,), (9,)]


def test_memory_outlives_a_run(spark, tmp_path):
    (tmp_path / "principles.md").write_text("look twice")
    (tmp_path / "blacklist.json").write_text('["lag n same"]')
    told = []

    def generate(context, lag, known):
        told.append(known)
        return same(context, lag, known)

    memory = loop.Memory(str(tmp_path))
    made = loop.Loop(generate, loop.spark_runner(spark), memory=memory, jump=0.0)(2)
    assert told[0]["principles"] == "look twice" and told[0]["knowledge"] == ""
    assert len((tmp_path / "journal.jsonl").read_text().splitlines()) == 2 and made[0]["confirmed"]
    assert memory.known()["knowledge"] == "- [70] Lag 0 same\n- [70] Lag 7 same"
    assert "SELECT 0.7D" in memory.known()["patterns"]
    assert memory.learn([], None) is False
    assert memory.learn(made, lambda old, new: f"{len(old.splitlines())} and {len(new)}") and memory.known()["knowledge"] == "2 and 2"


def test_supervision_restarts_until_the_time_is_up():
    now, told = [0.0], []

    def start(left):
        told.append(left)
        now[0] += 300

    audited = []
    runs = loop.supervise(start, 1000, 10, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s), then=lambda: audited.append(1))
    assert told == [1000, 690, 380, 70] and runs == 4 and audited == [1]


def test_audit_of_a_session(spark, tmp_path):
    """Confirmed rows of the last session only; high scores that nothing flags are run again, with and without their lag."""
    rows = [
        (1, "a", 1, "x", "SELECT usd_rub AS dxy", True, 90, 7),
        (2, "b", 1, "Lag 7 one", "flat INTERVAL 14 DAYS", True, 70, 14),
        (3, "b", 2, "Lag 14 one", "weak INTERVAL 14 DAYS", True, 65, 14),
        (4, "b", 3, "Lag 30 one", "good INTERVAL 14 DAYS", True, 99, 14),
        (5, "b", 4, "two", "flat INTERVAL 14 DAYS", True, 64, 14),
        (6, "b", 5, "three", "flat INTERVAL 14 DAYS", False, 90, 14),
        (7, "b", 6, "four", "SELECT usd_rub AS dxy, eur_rub", None, 90, 14),
        (8, "b", 7, None, "SELECT usd_rub AS dxy, eur_rub", True, None, 0),
        (9, "b", 8, "five", "weak, no lag", True, 80, 0),
        (10, "b", 9, "six", "fails", True, 80, 7),
        (11, "b", 10, "seven", "flat, says no days", True, 80, 7),
    ]
    log = spark.createDataFrame(rows, "event_id bigint, session string, iteration int, hypothesis string, sql string, confirmed boolean, score int, lag int")
    asked = []

    def execute(sql):
        asked.append(sql)
        if sql == "fails":
            raise ValueError
        lagged = "INTERVAL 14" in sql
        return [(100, {"f": 0.5, "w": 0.2, "g": 0.6}[sql[0]] if lagged or sql[0] in "fw" else 0.1)]

    done = audit.run(log, execute=execute)
    got = {r["event_id"]: list(r["issues"]) for r in done.findings.collect()}
    assert got == {2: ["STRUCTURAL"], 3: ["STRUCTURAL"], 4: [], 5: [], 8: ["ALIASING", "TAUTOLOGY"], 9: ["WEAK_R"], 10: [], 11: []}
    assert not any("64" in a for a in asked) and "SELECT usd_rub AS dxy" not in asked
    r = done.rates.collect()
    assert [(x["session"], x["total"], x["confirmed_raw"], x["clean_confirmed"], x["raw_rate"], x["clean_rate"], x["structural"], x["weak_r"], x["total_issues"], x["convergence_traps"]) for x in r] == [("b", 10, 8, 4, 80.0, 40.0, 2, 1, 5, 1)]
    assert [(x["fingerprint"], x["n"]) for x in done.convergence.collect()] == [("lag N one", 3)]
    assert audit.run(log, "a").rates.first()["aliasing"] == 1
    audit.write_report(done, str(tmp_path))
    text = (tmp_path / "audit.md").read_text()
    assert "| b | 10 | 8 | 4 |" in text and "ALIASING, TAUTOLOGY" in text
    assert json.loads((tmp_path / "blacklist.json").read_text()) == ["lag N one"]
    assert json.loads((tmp_path / "regime.json").read_text()) == fixed.CURRENT_REGIME
    assert "alias: usd_rub AS dxy" in (tmp_path / "patterns.md").read_text()


def test_recurring_weak_statements(spark):
    rows = [(s, "SELECT  x\n FROM t", ["WEAK_R"]) for s in (1, 1, 1, 2, 2)] + [(1, "other", ["WEAK_R"]), (1, "SELECT x FROM t", [])]
    df = spark.createDataFrame(rows, "session int, sql string, issues array<string>")
    assert [tuple(r) for r in audit.recurring_weak(df).collect()] == [(1, "select x from t", 3)]
    assert [tuple(r) for r in audit.recurring_weak(df, by=[]).collect()] == [("select x from t", 5)]


def test_quality_checks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", None)], "k string, v double")
    got = {r["check"]: r["bad"] for r in quality.run_checks(df, quality.Checks("t", ["v"], {"low": F.col("v") < 2}, ["k", "v"], 5, ("k", ["a", "z"]), ("k", 2))).collect()}
    assert got == {"null v": 1, "low": 2, "rows >= 5": 1, "unique k, v": 1, "expected k": 1, "rows per k": 1}


def test_attempts_become_columns(spark):
    df = spark.sql("SELECT 1 AS id, array(named_struct('sql', 'a', 'error', 'e', 'error_type', 't'), named_struct('sql', 'b', 'error', null, 'error_type', null)) AS attempts UNION ALL SELECT 2, null")
    a, b = E.attempt_columns(df).orderBy("id").collect()
    assert (a["sql_attempts"], a["sql_1"], a["error_1"], a["sql_2"], a["error_2"], a["sql_3"]) == (2, "a", "e", "b", None, None)
    assert (b["sql_attempts"], b["sql_1"]) == (0, None)


def test_fixes_are_written_once(tmp_path):
    for _ in range(2):
        audit.apply_fixes(str(tmp_path), {"key_rate_pct": 21.0}, ["trap"], ["pattern", "pattern"])
    assert (tmp_path / "blacklist.json").read_text() == '["trap"]'
    assert (tmp_path / "patterns.md").read_text() == "pattern\n"


def test_convergence(spark):
    df = spark.createDataFrame([("Lag 7 x",), ("lag 14 x ",), ("Lag 3 x",), ("other",)], "hypothesis string")
    assert [(r["fingerprint"], r["n"]) for r in audit.convergence(df).collect()] == [("lag N x", 3)]


def test_windows_over_one_session_that_is_the_whole_log(spark):
    """Ranges of one session, small pieces: rolling rates, sums, chains and buckets as a walk over the rows gives them."""
    rng = random.Random(12)
    rows = [(s, i, rng.choice([True, False, None]), rng.choice([None, 5, 9]), rng.randint(1, 9), rng.randint(1, 9)) for s, n in (("all", 230), (None, 3), ("few", 11)) for i in range(n)]
    log = spark.createDataFrame(rows, "session string, iteration int, confirmed boolean, tokens long, ms int, context int").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rate = {(r.session, r.iteration): r.rate_pct for r in E.rolling_rate(log, 5, size=16).collect()}
        tokens = {(r.session, r.iteration): r.tokens for r in E.cumulative_tokens(log, 3).collect()}
        chain = {(r.session, r.iteration): (r.depth, r.max_depth) for r in E.chain_depth(log).collect()}
        outcomes = {(r.session, r.bucket): (r.confirmed, r.rejected, r.partial) for r in E.outcome_buckets(log, 50).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for s in ("all", None, "few"):
        own = [r for r in rows if r[0] == s]
        depth = most = 0
        for i, r in enumerate(own):
            depth = 0 if r[2] is False else depth + 1
            most = max(most, depth)
            assert chain[s, i] == (depth, most)
            if i >= 4:
                assert rate[s, i] == round(sum(x[2] is True for x in own[i - 4 : i + 1]) / 5 * 100, 4)
            if (i + 1) % 3 == 0:
                known = [x[3] for x in own[: i + 1] if x[3] is not None]
                assert tokens[s, i] == (sum(known) if known else None)
        for b in range(0, len(own), 50):
            part = [x[2] for x in own[b : b + 50]]
            assert outcomes[s, b] == (part.count(True), part.count(False), part.count(None))
