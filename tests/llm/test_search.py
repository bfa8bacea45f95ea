import math
import random

from lagloom.llm import topk


def slow(rows, k, every):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in {i: v for i, v in sorted(ok, reverse=True) if i % every == 0}.items():
        scored = sorted((-sum(x * y for x, y in zip(a, v, strict=False)), i) for i, v in ok if i != q)
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def run(spark, rows, k=10, every=10, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.filter(f"vec_id % {every} = 0"), k, **options).collect()]


def test_against_brute_force_with_ties_and_a_frequent_vector(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 16)
    rng = random.Random(1)
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(8)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]
    rows += [(2000, None), (2010, [float("nan")] * 8), (2020, [1.0, None] * 4), (None, [1.0] * 8), (2030, [float("inf")] + [0.0] * 7)]
    as_float = spark.createDataFrame(rows, "vec_id long, embedding array<float>").collect()
    got = run(spark, rows, wave=7)
    assert len(got) == len(set(got)) and set(got) == slow([(r[0], r[1]) for r in as_float], 10, 10)


def test_few_rows_and_none(spark):
    assert set(run(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])])) == {(0, 1, 1, 1024 * 512), (0, 2, 2, -1024 * 1024)}
    assert run(spark, [(0, [1.0])]) == []
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_pruning_skips_annuli(spark, monkeypatch):
    """On clustered vectors less than half of the products are made, by one pass over the index, and none is missed."""
    monkeypatch.setattr(topk, "ANNULUS", 32)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(20)]
    rows = [(i, [x + rng.gauss(0, 0.1) for x in rng.choice(centres)]) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = topk.build_index(df, pivots=32)
    queries = topk.whole(df.filter("vec_id % 20 = 0"), "vec_id", "embedding")
    found = topk.search(index, queries, 10)
    share = topk.share_made(found, index, queries)
    print(f"products made: {share:.3f}")
    assert 0 < share < 0.2
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.filter("vec_id % 20 = 0"), 10).collect()}
    assert got == slow(rows, 10, 20)


def test_bounds_hold(spark, monkeypatch):
    """No product exceeds the bound of its annulus, lengths equal or not, with a zero query among them."""
    import numpy as np

    monkeypatch.setattr(topk, "ANNULUS", 8)
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(x) for x in rng.normal(0, rng.choice([0.01, 1, 3]), 6)]) for i in range(300)]
    index = topk.build_index(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), pivots=7)
    q = np.floor(1024 * np.vstack([np.zeros(6), rng.normal(0, 1, (20, 6))]))
    facts = index.facts()
    for r in index.parts.filter("kind = 0").collect():
        x = np.frombuffer(r["vecs"]).reshape(-1, 6)
        top = topk.highest(q, topk.query_distances(q, facts), np.frombuffer(r["more"])[None, :], facts)[:, 0]
        assert ((q @ x.T).max(axis=1) <= top).all()


def test_more_groups_than_bounds_sent(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 4)
    monkeypatch.setattr(topk, "GROUP", 1)
    monkeypatch.setattr(topk, "CELLS", 3)
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, df.filter("vec_id % 10 = 0"), 3).collect()}
    assert got == slow(rows, 3, 10)


def test_clashing_columns_and_uneven_lengths(spark):
    rows = [(0, [1.0, 2.0], 9, 1.0, "a"), (1, [3.0], 9, 1.0, "b"), (2, [0.0, 1.0, 5.0], 9, 1.0, None), (2, [0.0, 1.0, 5.0], 9, 1.0, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double, grp string")
    got = [tuple(r) for r in topk.top_k(df, df.filter("vec_id = 0"), 3).collect()]
    m = 1024 * 1024
    assert sorted(got) == [(0, 1, 1, 3 * m), (0, 2, 2, 2 * m), (0, 3, 2, 2 * m)]
