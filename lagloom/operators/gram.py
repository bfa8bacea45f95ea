"""A grid of lagged correlations by blocked matrix products.

Joining sources and targets on the day makes a row for each source, target, lag and day. Here a series' days of a span of
``SPAN`` days are one row of arrays; series are dealt into tiles of about ``TILE``, and a task takes a tile of sources, a
tile of targets and a span. For each lag it shifts the targets' matrix and multiplies: counts, sums, squares and products
of all pairs at once are seven matrix products. Spans are added by one aggregation, and correlations follow from the sums. Values
count from their series' mean, which r does not see, so that sums keep the digits of a level with little spread. What is
shuffled is each series once for every tile of the other side, whatever the lags, and one row a pair, lag and span.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lagloom.sources.shared import keep

SPAN, TILE = 2048, 512
#: A side whose variance is a smaller part of its mean square, from the series' mean, counts as constant: that much is rounding.
FLAT = 1e-13
_SUMS = ["m", "sx", "sy", "sxx", "syy", "sxy"]
_CELLS = "source string, target string, lag int, n long, m long, " + ", ".join(f"{s} double" for s in _SUMS[1:])


def _mean(v: Column) -> Column:
    """The mean, and of equal values exactly their value."""
    return F.least(F.greatest(F.avg(v), F.min(v)), F.max(v))


def _centred(both: DataFrame) -> DataFrame:
    """Each series with its mean over days, the same in all its spans."""
    days = both.select("side", "name", F.explode("days").alias("day")).filter("day.m > 0")
    centres = days.groupBy(F.col("side").alias("_side"), F.col("name").alias("_name")).agg(_mean(F.col("day.a")).alias("centre"))
    found = both.join(centres, (F.col("side") == F.col("_side")) & F.col("name").eqNullSafe(F.col("_name")), "left")
    return found.select(*both.columns, F.coalesce("centre", F.lit(0.0)).alias("centre"))


def _vectors(series: DataFrame, name: str, value: str, spans: Column, side: int) -> DataFrame:
    """A row for each series and span: its days with rows, values, means and squared deviations from them."""
    v = F.col(value).cast("double")
    days = series.filter(F.col("day").isNotNull()).groupBy(F.col(name).cast("string").alias("name"), F.unix_date("day").alias("d"))
    days = days.agg(F.count("*").alias("r"), F.count(v).alias("m"), F.coalesce(_mean(v), F.lit(0.0)).alias("a"), F.coalesce(F.var_pop(v) * F.count(v), F.lit(0.0)).alias("v"))
    dealt = days.withColumn("span", F.explode(spans))
    return dealt.groupBy("name", "span").agg(F.collect_list(F.struct("d", "r", "m", "a", "v")).alias("days")).withColumn("side", F.lit(side))


def products(x: np.ndarray, y: np.ndarray, first: int, lags: list[int]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """For each lag the matrices n, m, sx, sy, sxx, syy, sxy. ``x``: (4, series, days) of r, m, s, q; ``y`` begins ``first`` days from x."""
    span = x.shape[2]
    for lag in lags:
        z = y[:, :, lag - first : lag - first + span]
        yield lag, [a @ b.T for a, b in ((x[0], z[0]), (x[1], z[1]), (x[2], z[1]), (x[1], z[2]), (x[3], z[1]), (x[1], z[3]), (x[2], z[2]))]


def _matrix(rows: list[tuple], at: int, length: int) -> tuple[list[str | None], np.ndarray]:
    names = [r[1] for r in rows]
    out = np.zeros((4, len(rows), length))
    for i, (_, _, days, centre) in enumerate(rows):
        where = np.asarray(days.field("d")) - at
        inside = (where >= 0) & (where < length)
        r, m, a, v = (np.asarray(days.field(c))[inside] for c in "rmav")
        off = a - centre
        for k, of in enumerate((r, m, m * off, v + m * off * off)):
            out[k, i, where[inside]] = of
    return names, out


def _multiplied(groups: DataFrame, lags: list[int]) -> DataFrame:
    schema = to_arrow_schema(_parse_datatype_string(_CELLS))
    low, high = min(lags), max(lags)

    def cells(span: int, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        sources, x = _matrix([r for r in rows if r[0] == 0], span * SPAN, SPAN)
        targets, y = _matrix([r for r in rows if r[0] == 1], span * SPAN + low, SPAN + high - low)
        if not sources or not targets:
            return
        left, right = pa.array(sources, pa.string()), pa.array(targets, pa.string())
        for lag, sums in products(x, y, low, lags):
            # Some rows of sources at a time: a batch stays small.
            for at in range(0, len(sources), 64):
                i, j = np.nonzero(sums[0][at : at + 64])
                whole = [pa.array(s[at : at + 64][i, j]) for s in sums]
                whole[:2] = [pa.array(s[at : at + 64][i, j].astype(np.int64)) for s in sums[:2]]
                yield pa.RecordBatch.from_arrays([left.take(pa.array(i + at)), right.take(pa.array(j)), pa.repeat(pa.scalar(lag, pa.int32()), len(i)), *whole], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for k, (own, side, name) in enumerate(zip(keys, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                if own != key and rows:
                    yield from cells(key[2], rows)
                    rows = []
                key = own
                rows.append((side, name, batch.column(5)[k].values, batch.column(6)[k].as_py()))
        if rows:
            yield from cells(key[2], rows)

    return groups.repartition("i", "j", "span").sortWithinPartitions("i", "j", "span").select("i", "j", "span", "side", "name", "days", "centre").mapInArrow(run, _CELLS)


def correlations(sources: DataFrame, targets: DataFrame, lags: list[int]) -> DataFrame:
    """(source, target, lag, n, n_pairs, r) for all pairs that meet on a day at a lag.

    ``sources``: source, day, x; ``targets``: target, day, y. Of several rows of a series and day each counts, as in a
    join; n counts rows that meet, n_pairs those without a null. r is null for fewer than two pairs or a constant side.
    """
    lags = sorted(set(lags))
    span = F.floor(F.col("d") / SPAN)
    back = F.array_distinct(F.array(*[F.floor((F.col("d") - lag) / SPAN) for lag in lags]))
    both = keep(_vectors(sources, "source", "x", F.array(span), 0).unionByName(_vectors(targets, "target", "y", back, 1)), "vectors")
    counts = {r["side"]: r["n"] for r in both.groupBy("side").agg(F.count_distinct(F.coalesce(F.concat(F.lit("="), "name"), F.lit(""))).alias("n")).collect()}
    tiles = [max(1, -(-counts.get(k, 0) // TILE)) for k in (0, 1)]
    own = F.pmod(F.xxhash64("name"), F.when(F.col("side") == 0, tiles[0]).otherwise(tiles[1]))
    others = F.sequence(F.lit(0).cast("bigint"), F.when(F.col("side") == 0, tiles[1] - 1).otherwise(tiles[0] - 1).cast("bigint"))
    dealt = _centred(both).withColumn("own", own).withColumn("other", F.explode(others))
    first = F.col("side") == 0
    dealt = dealt.withColumns({"i": F.when(first, F.col("own")).otherwise(F.col("other")), "j": F.when(first, F.col("other")).otherwise(F.col("own"))})
    sums = _multiplied(dealt, lags).groupBy("source", "target", "lag").agg(*[F.sum(c).alias(c) for c in ["n", *_SUMS]])
    m = F.col("m")
    spread = {c: F.greatest(m * F.col(f"s{c}{c}") - F.col(f"s{c}") * F.col(f"s{c}"), F.lit(0.0)) for c in "xy"}
    flat = [spread[c] <= FLAT * m * F.col(f"s{c}{c}") for c in "xy"]
    r = F.when((m > 1) & ~flat[0] & ~flat[1], (m * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(spread["x"]) / F.sqrt(spread["y"]))
    # Rounding may pass 1; greatest and least alone would take a null for the bound.
    return sums.select("source", "target", "lag", "n", m.alias("n_pairs"), F.when(F.abs(r) > 1, F.signum(r)).otherwise(r).alias("r"))
