"""Repeated hypotheses while a run goes on: counters of fingerprints as state of a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructField, StructType


def repeats(log: DataFrame, fingerprint: str, at: str, limit: int = 3, late: str = "1 hour", idle_s: int = 86_400, buckets: int | None = None) -> DataFrame:
    """The iterations of a stream of a run log at which a fingerprint has come up ``limit`` times in its session.

    Columns: session, iteration, the fingerprint and seen, as ``experiments.repeats`` gives them for a whole log. The state is
    a number for each session and fingerprint; with ``buckets``, which a query must keep over restarts, they lie in so many rows by a hash
    of both, as a call into Python for each key costs far more than its counting. It is kept in the query's checkpoint over restarts, and dropped by a timer when the
    watermark (``at`` less ``late``) has passed the fingerprint's last time by ``idle_s`` seconds: a later one is counted from the
    beginning. Iterations of a batch are put in order; batches are taken as they come. A null session or fingerprint is a
    key like any other.
    """
    kinds = {f.name: f for f in log.schema.fields}
    out = StructType([kinds["session"], kinds["iteration"], kinds[fingerprint], StructField("seen", LongType())])

    def count(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        keys, counts, ends = state.get if state.exists else ([], [], [])
        held = pd.DataFrame({"n": list(counts), "end": list(ends)}, index=pd.Index(list(keys), dtype=object), dtype="int64")
        passed, own = state.getCurrentWatermarkMs(), None
        if not state.hasTimedOut:
            own = pd.concat(list(batches), ignore_index=True).sort_values("iteration", kind="stable", ignore_index=True)
            by = own.groupby("name", sort=False)
            own["seen"] = by.cumcount() + 1 + own["name"].map(held["n"]).fillna(0).astype("int64")
            last = (by[at].max().astype("datetime64[ms]").astype("int64")).clip(lower=passed) + idle_s * 1000
            now = pd.DataFrame({"n": by["seen"].max(), "end": last})
            # A key of this batch goes on, though its time may have passed.
            held = pd.concat([held[(held["end"] > passed) & ~held.index.isin(now.index)], now])
        else:
            held = held[held["end"] > passed]
        if len(held):
            state.update((held.index.tolist(), held["n"].tolist(), held["end"].tolist()))
            state.setTimeoutTimestamp(int(held["end"].min()))
        elif state.exists:
            state.remove()
        if own is not None:
            yield own.loc[own["seen"] >= limit, out.names]

    # Time of the events, not of the clock: a query that takes what is there and ends never ends with timers on the clock.
    # The key is one text, for a key of nulls alone would find no state.
    name = F.to_json(F.struct("session", fingerprint), {"ignoreNullFields": "false"})
    few = log.select("session", "iteration", fingerprint, at, name.alias("name")).withWatermark(at, late)
    dealt = few.withColumn("key", F.pmod(F.xxhash64("name"), F.lit(buckets)) if buckets else F.col("name"))
    return dealt.groupBy("key").applyInPandasWithState(count, out, "keys array<string>, counts array<bigint>, ends array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
