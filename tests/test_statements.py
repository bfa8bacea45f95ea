import random
import re
from datetime import date, timedelta

import numpy as np
from pyspark.sql.types import DoubleType, StructField, StructType

from lagloom.operators import audit, lineage, statements


def _stmt(source="a", target="p", lag=None, more="", corr="CORR(s.close, t.close)"):
    later = f" + INTERVAL {lag} DAYS" if lag else ""
    return f"SELECT {corr} AS r FROM market s JOIN indices t ON t.d = s.d{later} WHERE s.name = '{source}' AND t.name = '{target}'{more}"


def _series(spark, n=80):
    rng = random.Random(2)
    day = [date(2022, 1, 1) + timedelta(i) for i in range(n)]
    x = {s: {d: rng.gauss(0, 1) for d in day} for s in "ab"}
    y = {"p": {d: x["a"].get(d - timedelta(7), 0) + 0.3 * rng.gauss(0, 1) for d in day}, "q": {d: rng.gauss(0, 1) for d in day}}
    s = spark.createDataFrame([(k, d, v) for k, vs in x.items() for d, v in vs.items()], "source string, day date, x double")
    t = spark.createDataFrame([(k, d, v) for k, vs in y.items() for d, v in vs.items()], "target string, day date, y double")
    regimes = spark.createDataFrame([("high", d) for i, d in enumerate(day) if i % 3] + [("low", d) for i, d in enumerate(day) if not i % 3], "regime string, day date")
    return x, y, day, s, t, regimes


def _r(x, y, lag, days):
    two = [(x[d], y[d + timedelta(lag)]) for d in days if d + timedelta(lag) in y]
    return round(float(np.corrcoef(*zip(*two, strict=True))[0, 1]), 4)


def test_measured_as_the_statements_say(spark):
    x, y, day, s, t, regimes = _series(spark)
    rows = [
        (1, _stmt(lag=7)), (2, _stmt("b", "q")), (3, _stmt(lag=7, more=" AND s.d BETWEEN DATE '2022-01-10' AND DATE '2022-02-09'")),
        (4, _stmt(lag=7, more=" AND s.regime = 'high'")), (5, _stmt("no", "p")), (6, "SELECT usd_rub AS dxy FROM ctx"), (7, None), (8, _stmt(lag=7)),
        (9, _stmt(lag=7).lower().replace(" where", "\n\n WHERE") + " ;"), (10, _stmt(more=" OR 1 = 1")), (11, _stmt(lag=14, more=" AND s.regime = 'none'")),
    ]
    got = {r.id: (r.n, r.r, r.r0) for r in statements.measured(spark.createDataFrame(rows, "id int, sql string"), s, t, regimes).collect()}
    within = [d for d in day if date(2022, 1, 10) <= d <= date(2022, 2, 9)]
    high = [d for i, d in enumerate(day) if i % 3]
    lagged = (73, _r(x["a"], y["p"], 7, day), _r(x["a"], y["p"], 0, day))
    assert got[1] == got[8] == got[9] == lagged and abs(lagged[1]) > 0.9 > 0.3 > abs(lagged[2])
    assert got[2] == (80, _r(x["b"], y["q"], 0, day), None)
    assert got[3] == (31, _r(x["a"], y["p"], 7, within), _r(x["a"], y["p"], 0, within))
    assert got[4][1:] == (_r(x["a"], y["p"], 7, high), _r(x["a"], y["p"], 0, high))
    assert all(got[i] == (None, None, None) for i in (5, 6, 7, 10, 11))


def test_a_text_is_parsed_once_however_often_it_comes(spark, monkeypatch):
    *_, s, t, _ = _series(spark)
    given, parsed = [], statements.parsed
    monkeypatch.setattr(statements, "parsed", lambda rows, sql: given.append(rows.count()) or parsed(rows, sql))
    rows = spark.range(3000).selectExpr("id", f"""case when id % 3 = 0 then "{_stmt(lag=7)}" when id % 3 = 1 then 'SELECT 1' end as sql""")
    got = statements.measured(rows, s, t)
    assert given == [2]
    assert not {"regexp", "RLIKE"} & set(got._jdf.queryExecution().optimizedPlan().toString().replace("(", " ").replace("_", " ").split())
    found = {(r.id % 3, r.n) for r in got.collect()}
    assert got.count() == 3000 and found == {(0, 73), (1, None), (2, None)}


def test_the_audit_measures_its_candidates_in_one_grid(spark):
    x, y, day, s, t, regimes = _series(spark)
    r, r0 = (abs(_r(x["b"], y["q"], lag, day)) for lag in (7, 0))
    assert r < 0.3
    rows = [(1, "z", 1, "h one", _stmt(lag=7), True, 90, 7), (2, "z", 2, "h two", _stmt("b", "q", 7), True, 90, 7), (3, "z", 3, "h", _stmt("b", "q", 7), True, 10, 7), (4, "z", 4, "h", _stmt("b", "q"), True, 80, 0)]
    log = spark.createDataFrame(rows, "event_id bigint, session string, iteration int, hypothesis string, sql string, confirmed boolean, score int, lag int")
    got = {r.event_id: r.issues for r in audit.run(log, series=(s, t, regimes)).findings.collect()}
    assert got == {1: [], 2: ["STRUCTURAL" if abs(r - r0) < 0.08 else "WEAK_R"], 3: [], 4: ["WEAK_R"]}


CTX = {"ctx": StructType([StructField(c, DoubleType()) for c in ("usd_rub", "eur_rub", "close", "dxy", "key_rate_pct")]), "rates": StructType([StructField("key_rate_pct", DoubleType()), StructField("sp500", DoubleType())])}


def test_aliases_by_lineage(spark):
    own = spark.newSession()
    for name, schema in CTX.items():
        own.createDataFrame([], schema).createOrReplaceTempView(name)
    of = lambda sql: lineage.foreign_aliases(own, sql, CTX)
    hit = [("usd_rub", "dxy")]
    assert of("SELECT usd_rub AS dxy FROM ctx") == hit
    assert of("SELECT (usd_rub * 1) AS dxy FROM ctx") == hit
    assert of("SELECT c.usd_rub dxy FROM ctx c") == hit
    assert of("WITH a AS (SELECT usd_rub AS v FROM ctx), b AS (SELECT v + 0 AS w FROM a) SELECT max(w) AS DXY FROM b") == hit
    assert of("SELECT q FROM (SELECT corr(dxy, close) AS q FROM (SELECT usd_rub AS dxy, close FROM ctx))") == hit
    assert of("SELECT v AS dxy FROM (SELECT usd_rub AS v FROM ctx UNION ALL SELECT close FROM ctx)") == hit
    assert of("SELECT (SELECT max(usd_rub) FROM ctx) AS dxy") == hit
    assert of("SELECT lag(usd_rub) OVER (ORDER BY close) AS dxy FROM ctx") == hit
    assert of("SELECT rates.key_rate_pct AS sp500, usd_rub AS silver FROM ctx JOIN rates ON rates.key_rate_pct = ctx.key_rate_pct") == [("key_rate_pct", "sp500"), ("usd_rub", "silver")]
    assert of("SELECT dxy FROM ctx") == of("SELECT dxy * 2 AS dxy FROM ctx") == of("SELECT close AS dxy FROM ctx") == of("SELECT usd_rub AS rate FROM ctx") == []
    assert of("SELECT usd_rub AS dxy FROM nowhere") == of("SELEC") == []


def test_output_columns_and_checked_logs(spark):
    own = spark.newSession()
    own.createDataFrame([], CTX["ctx"]).createOrReplaceTempView("ctx")
    assert lineage.columns(own, "SELECT usd_rub + eur_rub AS s, 1 AS one FROM ctx", ["ctx"]) == [("s", {("ctx", "usd_rub"), ("ctx", "eur_rub")}), ("one", set())]
    rows = spark.createDataFrame([(1, "SELECT usd_rub AS dxy FROM ctx"), (2, "SELECT usd_rub AS dxy FROM ctx"), (3, None), (4, "no")], "id int, sql string")
    assert {r.id: r.pairs for r in lineage.checked(rows, "id", "sql", CTX).collect()} == {1: ["usd_rub AS dxy"], 2: ["usd_rub AS dxy"], 3: None, 4: []}


def test_a_finding_brings_its_statement_and_the_log_is_read_once(spark, tmp_path):
    import duckdb

    from lagloom.plans import registry, runs

    registry.load()
    days = [date(1996, 1, 1) + timedelta(i) for i in range(200)]
    kinds = ["purchase", "signup", "error", "view"]
    tables = {
        "orders": ([(d, p, float((i * 37 + j * 11) % 101)) for i, d in enumerate(days) for j, p in enumerate(runs._INSTRUMENTS)], "o_orderdate date, o_orderpriority string, o_totalprice double"),
        "lineitem": ([(t[0], t[1], d, float((i * 53 + j * 29) % 97), 1.0) for i, d in enumerate(days) for j, t in enumerate(runs._INDEXES)], "l_returnflag string, l_linestatus string, l_shipdate date, l_extendedprice double, l_quantity double"),
        "events": ([(i, i % 7, kinds[i % 4], float(i * 13 % 101), f'{{"k": {i * 7 % 100}}}') for i in range(2000)], "event_id long, user_id long, event_type string, value double, props string"),
    }
    db = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("audit_summary", "audit_run", "recurring_weak"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # Only the log has props; it was read for the findings and again for their statements.
        assert sum("Relation" in line and "props#" in line for line in plan.splitlines()) == 1
        if name == "audit_run":  # the session is chosen before iterations are numbered
            assert re.search(r"\(user_id#\d+L = \d+\)", plan[plan.index("Window [row_number()") :])
        want = db.execute(f"SELECT {', '.join(df.columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
        assert want and sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, want))
