import json
import random

from pyspark.sql import functions as F

from lagloom.operators import experiments as E
from lagloom.streaming import traps


def test_counts_go_on_over_restarts_as_in_the_whole_log(spark, tmp_path):
    rng = random.Random(3)
    rows = [(s, i, rng.choice(["a", "b", None])) for s in ("x", "y", None) for i in range(30)]
    log = spark.createDataFrame(rows, "session string, iteration int, fp string").withColumn("at", F.timestamp_seconds(F.col("iteration") * 60 + 1_700_000_000))
    src, out, seen = (str(tmp_path / n) for n in ("src", "out", "seen"))
    for k in range(3):
        log.filter(F.floor(F.col("iteration") / 10) == k).write.mode("append").parquet(src)
        found = traps.repeats(spark.readStream.schema(log.schema).parquet(src), "fp", "at")
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (str(r.session), r.iteration, str(r.fp), r.seen)
    want = E.repeats(log, "fp").collect()
    assert sorted(map(key, spark.read.parquet(out).collect())) == sorted(map(key, want))
    # The state is a number a key, in the checkpoint.
    assert spark.read.format("statestore").load(seen).count() == len({(s, f) for s, _, f in rows})


def test_state_is_dropped_by_the_watermark(spark, tmp_path):
    src, out, seen = (str(tmp_path / n) for n in ("src", "out", "seen"))
    for i, hour in enumerate((0, 0, 100, 101)):
        spark.createDataFrame([("x", i, "a" if hour < 100 else "b", hour * 3600)], "session string, iteration int, fp string, s long").withColumn("at", F.timestamp_seconds("s")).drop("s").write.mode("append").parquet(src)
        rows = traps.repeats(spark.readStream.schema("session string, iteration int, fp string, at timestamp").parquet(src), "fp", "at", idle_s=7200)
        rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    assert [json.loads(r.key.key)["fp"] for r in spark.read.format("statestore").load(seen).collect()] == ["b"]


def test_keys_share_rows_of_state(spark, tmp_path):
    """Two rows of state for many keys: the same counts over restarts, each key dropped at its own time."""
    src, out, seen = (str(tmp_path / n) for n in ("src", "out", "seen"))
    kinds = "session string, iteration int, fp string, s long"
    for k in range(3):
        rows = [(None if s == 9 else f"s{s}", k * 10 + i, "ab"[i % 2], 1_700_000_000 + (k * 10 + i) * 60) for s in range(40) for i in range(10)]
        spark.createDataFrame(rows, kinds).withColumn("at", F.timestamp_seconds("s")).drop("s").write.mode("append").parquet(src)
        found = traps.repeats(spark.readStream.schema(kinds.replace("s long", "at timestamp")).parquet(src), "fp", "at", idle_s=7200, buckets=2)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    key = lambda r: (str(r.session), r.iteration, str(r.fp), r.seen)
    whole = spark.read.parquet(src)
    assert sorted(map(key, spark.read.parquet(out).collect())) == sorted(map(key, E.repeats(whole, "fp").collect()))
    assert spark.read.format("statestore").load(seen).count() <= 2
    for i, hour in enumerate((100, 101)):
        spark.createDataFrame([("s0", 100 + i, "a", 1_700_000_000 + hour * 3600)], kinds).withColumn("at", F.timestamp_seconds("s")).drop("s").write.mode("append").parquet(src)
        found = traps.repeats(spark.readStream.schema(kinds.replace("s long", "at timestamp")).parquet(src), "fp", "at", idle_s=7200, buckets=2)
        found.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).trigger(availableNow=True).start().awaitTermination()
    left = [json.loads(k) for r in spark.read.format("statestore").load(seen).collect() for k in r.value.groupState["keys"]]
    assert left == [{"session": "s0", "fp": "a"}]
