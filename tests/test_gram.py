import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lagloom.operators import gram, signals


def _series(rng, names, days, nulls=0.2, twice=0.1):
    rows = []
    for name in names:
        level = rng.uniform(50, 90)
        for d in range(days):
            if rng.random() < 0.7:
                level += rng.gauss(0, 1)
                rows += [(name, date(2021, 1, 1) + timedelta(d), None if rng.random() < nulls else level)] * (2 if rng.random() < twice else 1)
    return rows


def brute(xs, ys, lags):
    out = {}
    for a in {r[0] for r in xs}:
        for b in {r[0] for r in ys}:
            for lag in lags:
                met = [(x, y) for n, d, x in xs if n == a and d for m, t, y in ys if m == b and t == d + timedelta(lag)]
                if met:
                    two = [(x, y) for x, y in met if x is not None and y is not None]
                    r = None
                    if len(two) > 1 and len({x for x, _ in two}) > 1 and len({y for _, y in two}) > 1:
                        r = round(float(np.corrcoef(*zip(*two, strict=True))[0, 1]), 4) + 0.0
                    out[a, b, lag] = (len(met), len(two), r)
    return out


def _get(spark, xs, ys, lags):
    s = spark.createDataFrame(xs, "source string, day date, x double").repartition(3)
    t = spark.createDataFrame(ys, "target string, day date, y double").repartition(3)
    rows = gram.correlations(s, t, lags).withColumn("r", F.round("r", 4) + F.lit(0.0)).collect()
    return {(r.source, r.target, r.lag): (r.n, r.n_pairs, r.r) for r in rows}


@pytest.mark.parametrize(("span", "tile"), [(2048, 512), (16, 2)])
def test_equals_a_join_on_the_day(spark, monkeypatch, span, tile):
    """Nulls, several rows a day, a constant and a short series; small tiles and spans give several of each."""
    monkeypatch.setattr(gram, "SPAN", span)
    monkeypatch.setattr(gram, "TILE", tile)
    rng = random.Random(4)
    xs = _series(rng, ["a", "b", "c", "d", "e"], 60) + [("flat", date(2021, 1, 1) + timedelta(d), 0.1) for d in range(40)] + [("one", date(2021, 1, 5), 3.0), (None, date(2021, 1, 5), 1.0), ("gone", None, 1.0)]
    ys = _series(rng, ["p", "q", "r"], 60) + [("level", date(2021, 1, 1) + timedelta(d), 1e6) for d in range(40)]
    lags = [-3, 0, 7, 14]
    assert _get(spark, xs, ys, lags) == brute(xs, ys, lags)


def test_a_level_with_little_spread_is_not_constant(spark, monkeypatch):
    """Means of 1e5 and 1e8 with a spread of cents, several rows a day and several spans; equal values stay constant."""
    monkeypatch.setattr(gram, "SPAN", 16)
    rng = random.Random(5)
    of = lambda name, level: [(name, date(2021, 1, 1) + timedelta(d), level + rng.randrange(5) / 100) for d in range(60) for _ in range(1 + d % 3)]
    flat = [("flat", date(2021, 1, 1) + timedelta(d), 0.1) for d in range(60) for _ in range(1 + d % 3)]
    xs, ys = of("a", 1e5) + of("b", 1e8) + flat, of("p", 1e5) + of("q", 0.0) + flat
    got, want = _get(spark, xs, ys, [0, 7]), brute(xs, ys, [0, 7])
    assert got == want
    assert {k[:2] for k, (_, _, r) in got.items() if r is None} == {k[:2] for k in got if "flat" in k}


def test_bounds_reach_both_sides_and_cells_can_be_excluded(spark):
    rng = random.Random(9)
    xs, ys = _series(rng, ["a", "b"], 60, 0, 0), _series(rng, ["p", "q"], 60, 0, 0)
    s = spark.createDataFrame(xs, "source string, day date, x double")
    t = spark.createDataFrame(ys, "target string, day date, y double")
    since, until = date(2021, 1, 11), date(2021, 2, 9)
    got = signals.scan(s, t, [0, 7], 3, (F.col("source") == "a") & (F.col("lag_days") == 0), str(since), str(until)).collect()
    want = brute([r for r in xs if since <= r[1] <= until], [r for r in ys if since <= r[1] <= until], [0, 7])
    assert {(r.source, r.target, r.lag): (r.n, r.corr) for r in got} == {k: (n, r) for k, (n, _, r) in want.items() if not (k[0] == "a" and k[2] == 0)}


def test_nothing_in_common(spark):
    none = spark.createDataFrame([], "source string, day date, x double")
    t = spark.createDataFrame([("p", date(2021, 1, 1), 1.0)], "target string, day date, y double")
    assert gram.correlations(none, t, [0]).collect() == []


def test_many_series_shuffle_no_pairs(spark):
    """600 x 600 series: rows that are shuffled are series by tiles, and cells, not pairs by day."""
    days = spark.range(120).select(F.date_add(F.lit("2021-01-01").cast("date"), F.col("id").cast("int")).alias("day"), "id")
    of = lambda name, v: spark.range(600).select(F.concat(F.lit(name), F.col("id").cast("string")).alias("who"), F.col("id").alias("k")).crossJoin(F.broadcast(days)).select("who", "day", (F.pmod(F.xxhash64("k", "id", F.lit(v)), F.lit(1000)) / 10).alias("v"))
    s = of("s", 1).toDF("source", "day", "x")
    t = of("t", 2).toDF("target", "day", "y")
    cells = gram.correlations(s, t, [0, 14])
    assert cells.count() == 600 * 600 * 2
    one = cells.filter("source = 's7' and target = 't11' and lag = 14").first()
    x = {r.day: r.x for r in s.filter("source = 's7'").collect()}
    two = [(x[r.day - timedelta(14)], r.y) for r in t.filter("target = 't11'").collect() if r.day - timedelta(14) in x]
    assert one.n == len(two) and abs(one.r - np.corrcoef(*zip(*two, strict=True))[0, 1]) < 1e-9
