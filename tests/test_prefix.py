import random

from pyspark.sql import functions as F

from lagloom.operators import prefix


def _rows(n=400, hot=0.7):
    rng = random.Random(3)
    return [("hot" if rng.random() < hot else rng.choice(["a", "b", None]), i, rng.choice([None, 1, 5, 9])) for i in rng.sample(range(10 * n), n)]


def _brute(rows):
    out = {}
    for key in {r[0] for r in rows}:
        total, most = 0, None
        for n, (_, at, v) in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1]), 1):
            total += v or 0
            most = v if most is None else most if v is None else max(most, v)
            out[key, at] = (n, total, most)
    return out


def test_running_equals_a_window_and_splits_a_hot_key(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, at int, v int").repartition(5)
    cut = prefix.cut(df, ["k"], ["at"], parts=6)
    assert cut.filter("k = 'hot'").select(prefix.BLOCK).distinct().count() > 1
    got = prefix.running(cut, ["k"], ["at"], {"n": ("sum", F.lit(1)), "total": ("sum", F.col("v")), "most": ("max", F.col("v"))})
    assert {(r.k, r.at): (r.n, r.total, r.most) for r in got.collect()} == _brute(rows)


def test_numbers_and_pieces(spark):
    df = spark.createDataFrame(_rows(hot=1.0), "k string, at int, v int")
    dealt = prefix.pieces(prefix.numbered(df, ["k"], ["at"]), "rn", 50, 7).collect()
    own = [r for r in dealt if (r.rn - 1) // 50 == r.piece]
    assert sorted(r.rn for r in own) == list(range(1, 401))
    back = sorted((r.piece, r.rn) for r in dealt if (r.rn - 1) // 50 != r.piece)
    # The last piece holds looked-back rows alone.
    assert back == [(p, 50 * p - 6 + i) for p in range(1, 9) for i in range(7)]


def test_no_rows(spark):
    df = spark.createDataFrame([], "k string, at int, v int")
    assert prefix.numbered(df, ["k"], ["at"]).collect() == []
