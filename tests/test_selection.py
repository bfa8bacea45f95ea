import random

import numpy as np
import pytest

from lagloom.operators import selection


def _get(spark, rows, at):
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    return {r.k: tuple(r[n] for n in at) for r in selection.percentiles(df, ["k"], "v", at).collect()}


AT = {"low": 0.0, "p10": 0.1, "median": 0.5, "p90": 0.9, "high": 1.0}


@pytest.mark.parametrize(("bins", "few"), [(1024, 4096), (8, 20), (2, 1)])
def test_equals_sorting(spark, monkeypatch, bins, few):
    """One group of many values and ties, one of wide range, one constant, one of one value, and one under a null key."""
    monkeypatch.setattr(selection, "BINS", bins)
    monkeypatch.setattr(selection, "FEW", few)
    rng = random.Random(6)
    groups = {
        "hot": [round(rng.gauss(0, 5)) / 2 for _ in range(600)],
        "wide": [rng.choice([-1, 1]) * 10 ** rng.uniform(-9, 9) for _ in range(150)],
        "far": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0],
        "same": [3.25] * 90,
        "one": [7.0],
        None: [1.0, 2.0],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("hot", float("nan")), ("hot", float("inf")), ("none", None)]
    got = _get(spark, rows, AT)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        if k != "far":
            assert np.allclose(got[k], np.quantile(vs, list(AT.values())), rtol=1e-12, atol=0), k
    assert got["far"][0] == -1.7e308 and got["far"][2] == 1.0 and got["far"][4] == 1.7e308


def test_without_keys(spark):
    df = spark.createDataFrame([(float(v),) for v in range(11)], "v double")
    assert tuple(selection.percentiles(df, [], "v", {"a": 0.5, "b": 0.25}).first()) == (5.0, 2.5)


def test_joined_by_key_when_states_are_many(spark, monkeypatch):
    monkeypatch.setattr(selection, "SMALL", 0)
    monkeypatch.setattr(selection, "FEW", 3)
    rows = [(str(k), float(v)) for k in range(5) for v in range(k, 30)]
    assert _get(spark, rows, {"m": 0.5}) == {str(k): (float(np.median(range(k, 30))),) for k in range(5)}
