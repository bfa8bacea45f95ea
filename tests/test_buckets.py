import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lagloom.sources import buckets


def _rows(spark, ids, v):
    return spark.createDataFrame([(i, f"{v}-{i}", i % 3) for i in ids], "id long, v string, at int")


def _order():
    return [F.col("at"), F.col("v")]


def _files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def _held(spark, path):
    return {r.id: r.v for r in buckets.read(spark, path).collect()}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(_rows(spark, range(2000), "a"), path, ["id"], _order(), 16)
    before = _files(path)
    assert len({f.split("/")[0] for f in before}) == 16
    hit = buckets.upsert(spark, path, _rows(spark, [5, 6, 5000], "b"), ["id"], _order())
    assert 1 <= len(hit) <= 3
    changed = {f.split("/")[0] for f in before ^ _files(path)}
    assert changed == {f"bucket_of_16={b}" for b in hit}
    written = sum(os.path.getsize(f"{path}/{f}") for f in _files(path) - before)
    whole = sum(os.path.getsize(f"{path}/{f}") for f in _files(path))
    assert written < whole * len(hit) / 16 * 2
    assert _held(spark, path) == {i: f"a-{i}" for i in range(2000)} | {i: f"b-{i}" for i in (5, 6, 5000)}


def test_three_upserts_an_insert_and_a_delete(spark, tmp_path):
    path, want = str(tmp_path / "t"), {}
    for k, ids in enumerate((range(50), range(30, 80), [1, 79, 200])):
        buckets.upsert(spark, path, _rows(spark, ids, f"u{k}"), ["id"], _order(), 8)
        want |= {i: f"u{k}-{i}" for i in ids}
        assert _held(spark, path) == want
    new = _rows(spark, [0, 300, 301], "n")
    assert buckets.insert(spark, path, new, ["id"], _order())
    assert buckets.insert(spark, path, new, ["id"], _order()) == []
    assert _held(spark, path) == want | {i: f"n-{i}" for i in (300, 301)}
    buckets.delete(spark, path, spark.range(4, 400), ["id"])
    assert _held(spark, path) == {i: want[i] for i in range(4)}


def test_repeated_keys_and_nulls(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "n", 1)], "id long, v string, at int")
    buckets.upsert(spark, path, rows, ["id"], _order(), 4)
    assert _held(spark, path) == {1: "y", None: "n"}
    assert buckets.upsert(spark, path, rows.limit(0), ["id"], _order()) == []


def test_a_failed_write_leaves_the_old_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    buckets.create(_rows(spark, range(100), "a"), path, ["id"], _order(), 8)
    before = _files(path)
    bad = _rows(spark, range(50), "b").withColumn("v", F.when(F.col("id") == 49, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(PySparkException):
        buckets.upsert(spark, path, bad, ["id"], _order())
    assert _files(path) == before
    assert _held(spark, path) == {i: f"a-{i}" for i in range(100)}
