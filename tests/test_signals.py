import datetime as dt

import pytest
from pyspark.sql import functions as F

from lagloom.functions.stats import n_pairs, safe_corr
from lagloom.operators import signals as S
from lagloom.operators import views

D = dt.date


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("rows", "want"),
    [([], None), ([(1.0, 2.0)], None), ([(1.0, 2.0), (1.0, 3.0)], None), ([(1.0, 2.0), (2.0, 4.0), (3.0, None)], 1.0), ([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)], -1.0)],
)
def test_safe_corr_edges(spark, rows, want):
    r = frame(spark, rows, "x double, y double").agg(safe_corr("x", "y").alias("r"), F.count("*").alias("n"), n_pairs("x", "y").alias("p")).first()
    assert r["n"] == len(rows)
    assert r["p"] == sum(a is not None and b is not None for a, b in rows)
    assert r["r"] == want if want is None else abs(r["r"] - want) < 1e-12


def test_lag_join_takes_exact_days_only(spark):
    src = frame(spark, [(D(2024, 1, 1), 1.0), (D(2024, 1, 2), 2.0)], "day date, x double")
    tgt = frame(spark, [(D(2024, 1, 15), 5.0), (D(2024, 1, 17), 6.0)], "day date, y double")
    rows = S.lag_pairs(src, tgt, [14]).collect()
    assert [(r["day"], r["y"]) for r in rows] == [(D(2024, 1, 1), 5.0)]


def test_null_driver_is_below(spark):
    rows = frame(spark, [(None,), (81.0,), (80.0,)], "z double").select(S.regime(F.col("z"), 80, "hi", "lo").alias("g")).collect()
    assert [r["g"] for r in rows] == ["lo", "hi", "lo"]


def test_scan_counts_cells_and_breaks_ties_by_lag(spark):
    days = [D(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    src = frame(spark, [("a", d, float(i % 7)) for i, d in enumerate(days)], "source string, day date, x double")
    tgt = frame(spark, [("t", d, float(i % 7)) for i, d in enumerate(days)], "target string, day date, y double")
    cells = S.scan(src, tgt, [0, 7, 3], 10).cache()
    assert cells.count() == 3
    best = S.best_lags(cells).first()
    assert (best["lag"], best["corr"]) == (0, 1.0)
    assert S.scan(src, tgt, [0], 41).count() == 0
    assert S.scan(src, tgt, [0, 7], 10, F.col("lag_days") == 0).count() == 1


def test_month_gap_is_null_and_asof_carries(spark):
    days = frame(spark, [(D(2023, 12, 31), 1.0), (D(2024, 1, 5), 2.0), (D(2024, 2, 5), 3.0), (D(2026, 1, 1), 4.0)], "trade_date date, close double")
    rates = frame(spark, [(D(2024, 1, 1), 10.0, 1.0)], "period_date date, rate_pct double, inflation double")
    got = {r["trade_date"]: r["rate_pct"] for r in views.market_context(days.withColumn("instrument", F.lit("d")), {"close": "d"}, {}, rates).collect()}
    assert got == {D(2023, 12, 31): None, D(2024, 1, 5): 10.0, D(2024, 2, 5): None, D(2026, 1, 1): None}
    got = {r["trade_date"]: r["rate_pct"] for r in views.asof(days, rates, "trade_date", "period_date", ["rate_pct"]).collect()}
    assert got == {D(2023, 12, 31): None, D(2024, 1, 5): 10.0, D(2024, 2, 5): 10.0, D(2026, 1, 1): 10.0}


def test_correlation_is_affine_invariant(spark):
    rows = [(float(i), float((i * 7) % 11)) for i in range(20)]
    r = frame(spark, rows, "x double, y double").agg(safe_corr("x", "y").alias("a"), safe_corr("y", "x").alias("b"), safe_corr(F.col("x") * -3 + 5, "y").alias("c")).first()
    assert abs(r["a"] - r["b"]) < 1e-12 and abs(r["a"] + r["c"]) < 1e-12


@pytest.mark.parametrize("name", ["signal_scan", "best_lag_per_pair", "structural_rerun"])
def test_the_scan_takes_days_of_all_years(spark, tmp_path, name):
    from lagloom.plans import registry, stand_ins

    registry.load()
    days = [D(2010, 1, 1) + dt.timedelta(i) for i in range(400)]
    tables = {
        "orders": frame(spark, [(d, "1-URGENT", float(i * 37 % 101)) for i, d in enumerate(days)], "o_orderdate date, o_orderpriority string, o_totalprice double"),
        "lineitem": frame(spark, [("N", "O", d, float(i * 53 % 97), 1.0, i % 7 / 100, 0.02) for i, d in enumerate(days)], "l_returnflag string, l_linestatus string, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, l_tax double"),
        "documents": frame(spark, [(1, "the", "en", "s")], "doc_id bigint, text string, lang string, source string"),
    }
    for k, df in tables.items():
        df.write.parquet(f"{tmp_path}/{k}.parquet")
    rows = registry.QUERIES[name](spark, str(tmp_path)).filter("source = '1-URGENT'").collect()
    lags = {"signal_scan": set(stand_ins.LAGS6), "structural_rerun": set(stand_ins.LAGS6) - {0}}
    assert {r["target"] for r in rows} == {"NO"}
    assert len(rows) == 1 if name == "best_lag_per_pair" else {r["lag"]: r["n"] for r in rows} == {lag: 400 - lag for lag in lags[name]}


def test_the_best_lag_is_of_all_days_by_its_sql_too(spark, tmp_path):
    import duckdb

    from lagloom.plans import registry

    registry.load()
    days = [D(1992, 1, 1) + dt.timedelta(i) for i in range(400)]
    tables = {
        "orders": frame(spark, [(d, "1-URGENT", float(i * 37 % 101)) for i, d in enumerate(days)], "o_orderdate date, o_orderpriority string, o_totalprice double"),
        "lineitem": frame(spark, [("N", "O", d, float(i * 53 % 97), 1.0, i % 7 / 100, 0.02) for i, d in enumerate(days)], "l_returnflag string, l_linestatus string, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, l_tax double"),
        "documents": frame(spark, [(1, "the", "en", "s")], "doc_id bigint, text string, lang string, source string"),
    }
    db = duckdb.connect()
    for k, df in tables.items():
        df.write.parquet(f"{tmp_path}/{k}.parquet")
        db.execute(f"CREATE VIEW {k} AS SELECT * FROM '{tmp_path}/{k}.parquet/*.parquet'")
    got = registry.QUERIES["best_lag_per_pair"](spark, str(tmp_path))
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL['best_lag_per_pair']}) WHERE source = '1-URGENT'").fetchall()
    assert [tuple(r) for r in got.filter("source = '1-URGENT'").collect()] == want
    (row,) = got.filter("source = '1-URGENT'").collect()
    assert row["n"] == 400 - row["lag"]


def test_the_best_lag_of_prices_near_a_constant_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    from lagloom.plans import registry

    registry.load()
    days = [D(1996, 1, 1) + dt.timedelta(i) for i in range(400)]
    tables = {
        "orders": frame(spark, [(d, p, 100000 + i * k % 101 / 100) for i, d in enumerate(days) for p, k in (("1-URGENT", 37), ("2-HIGH", 41))], "o_orderdate date, o_orderpriority string, o_totalprice double"),
        "lineitem": frame(spark, [("N", "O", d, 2e7 + i * 53 % 97 / 100, 1.0, i % 7 / 100, 0.02) for i, d in enumerate(days)], "l_returnflag string, l_linestatus string, l_shipdate date, l_extendedprice double, l_quantity double, l_discount double, l_tax double"),
        "documents": frame(spark, [(1, "the", "en", "s")], "doc_id bigint, text string, lang string, source string"),
    }
    db = duckdb.connect()
    for k, df in tables.items():
        df.write.parquet(f"{tmp_path}/{k}.parquet")
        db.execute(f"CREATE VIEW {k} AS SELECT * FROM '{tmp_path}/{k}.parquet/*.parquet'")
    got = registry.QUERIES["best_lag_per_pair"](spark, str(tmp_path)).filter("source in ('1-URGENT', '2-HIGH')")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({registry.ORACLE_SQL['best_lag_per_pair']}) WHERE source IN ('1-URGENT', '2-HIGH') ORDER BY source").fetchall()
    assert len(want) == 2
    assert sorted(tuple(r) for r in got.collect()) == want
