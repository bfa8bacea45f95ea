"""Exact percentiles of groups of any size, by narrowing ranges of values.

``percentile`` holds all distinct values of a group in one task. Here each wanted rank of each group has a range of values
that holds it. A pass counts the values of all groups in ``BINS`` equal bins of their ranges, in one aggregation with map-side
combine, and the bin that holds the rank, cut down to the values in it, is the next range. A range of at most ``FEW`` values
is sorted; one whose ends are equal is the answer, however often that value repeats. A task holds a bin count or ``FEW`` values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lagloom.sources.shared import discard, keep

BINS, FEW = 1024, 4096
#: States up to this many are broadcast to the values; more are joined by key.
SMALL = 100_000


def _ranged(values: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    """Each value with every open rank of its group whose range holds it."""
    states = open_.select(*[F.col(k).alias(f"_{k}") for k in keys], "rank", "lo", "hi", "before")
    same = [values[k].eqNullSafe(states[f"_{k}"]) for k in keys]
    if open_.count() <= SMALL:
        states = F.broadcast(states)
    return values.join(states, [*same, values["v"] >= states["lo"], values["v"] <= states["hi"]]).select(*keys, "rank", "lo", "hi", "before", "v")


def _narrowed(values: DataFrame, open_: DataFrame, keys: list[str]) -> DataFrame:
    # Halves, so that the width of a range stays finite.
    width = F.col("hi") / 2 - F.col("lo") / 2
    bin_ = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * BINS), F.lit(BINS - 1)).cast("int")
    bins = _ranged(values, open_, keys).groupBy(*keys, "rank", "before", bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    held = bins.withColumn("upto", F.col("before") + upto).filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    return held.select(*keys, "rank", "lo", "hi", (F.col("upto") - F.col("n")).alias("before"), "n")


def order_statistics(values: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, value) for ``wanted`` (keys, rank from 0, lo, hi, before = 0, n) among ``values`` (keys, v)."""
    found, open_ = None, keep(wanted, "ranges")
    while True:
        done = open_.filter("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
        small = open_.filter((F.col("lo") < F.col("hi")) & (F.col("n") <= FEW))
        few = _ranged(values, small, keys).groupBy(*keys, "rank", "before").agg(F.array_sort(F.collect_list("v")).alias("vs"))
        few = few.select(*keys, "rank", F.get("vs", F.col("rank") - F.col("before")).alias("value"))
        both = keep(done.unionByName(few), "found")
        found = both if found is None else found.unionByName(both)
        large = open_.filter((F.col("lo") < F.col("hi")) & (F.col("n") > FEW))
        if large.isEmpty():
            discard(open_)
            return found
        narrowed = keep(_narrowed(values, large, keys), "ranges")
        discard(open_)
        open_ = narrowed


def percentiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """(keys, a column for each of ``at``: name -> share): exact, interpolated between the two nearest ranks.

    Nulls and values that are not finite are left out; a group without any other has no row.
    """
    v = F.col(value).cast("double")
    values = keep(df.select(*keys, v.alias("v")).filter(F.col("v").isNotNull() & (F.abs("v") < float("inf")) & ~F.isnan("v")), "values")
    totals = keep(values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "totals")
    place = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in at.items()}
    ranks = F.array_distinct(F.array(*[f(x).cast("bigint") for x in place.values() for f in (F.floor, F.ceil)]))
    wanted = totals.select(*keys, F.explode(ranks).alias("rank"), "lo", "hi", F.lit(0).cast("bigint").alias("before"), "n")
    found = order_statistics(values, wanted, keys)
    by_rank = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("vs"))
    named = by_rank.select(*[F.col(k).alias(f"_{k}") for k in keys], "vs")
    met = totals.join(named, [totals[k].eqNullSafe(named[f"_{k}"]) for k in keys]) if keys else totals.crossJoin(F.broadcast(named))

    def between(x):
        low, high = F.col("vs")[F.floor(x).cast("bigint")], F.col("vs")[F.ceil(x).cast("bigint")]
        return low + (x - F.floor(x)) * (high - low)

    return met.select(*keys, *[between(x).alias(name) for name, x in place.items()])
