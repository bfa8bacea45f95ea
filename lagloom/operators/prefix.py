"""Running sums and numbers within keys of any size: a two-level scan.

A window over one key is one task, however large the key. Here rows are dealt by ranges of (keys, order), so that a large
key is cut into several blocks, each the rows of one task; a block's summary (a sum, a maximum) is one row, and what the
blocks before it add up to is joined to its rows. A range begins and ends once, so the keys that span blocks have at most
two rows a partition between them: that table is bounded by the number of partitions, not by the input, and is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lagloom.sources.shared import keep

BLOCK = "_block"


def _columns(names: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def cut(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "ranges", parts: int | None = None) -> DataFrame:
    """``df`` with the block of each row, written to the shared folder; blocks of a key follow its order.

    Rows that tie in keys and order share a block, so an order that tells rows apart bounds the blocks. Written, as ranges
    are drawn from a sample: a second evaluation might cut elsewhere. Without ``parts`` Spark chooses how many ranges.
    """
    return keep(df.repartitionByRange(*([parts] if parts else []), *keys, *order).withColumn(BLOCK, F.spark_partition_id()), name)


def _within(keys: list[str], order: list[str | Column]) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(*_columns(order)).rowsBetween(Window.unboundedPreceding, 0)


def _earlier(blocked: DataFrame, keys: list[str], summaries: dict[str, Column], kinds: dict[str, str]) -> DataFrame:
    """For keys in several blocks: (keys, block, what the blocks before hold). At most two rows for each range."""
    own = blocked.groupBy(*keys, BLOCK).agg(*[s.alias(n) for n, s in summaries.items()])
    spans = own.groupBy(*keys).agg(F.min(BLOCK).alias("_low"), F.max(BLOCK).alias("_high")).filter("_low < _high").select(*keys)
    # Null keys are a group, as in groupBy.
    same = [own[k].eqNullSafe(spans[k]) for k in keys]
    wide = own.join(F.broadcast(spans), same, "left_semi") if keys else own
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    fold = {"sum": F.sum, "max": F.max}
    return wide.select(*keys, BLOCK, *[fold[kinds[n]](n).over(before).alias(f"_{n}_before") for n in summaries])


def running(blocked: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``blocked`` with a column for each of ``values``: name -> ("sum" or "max", value), from the key's first row to this.

    Nulls add nothing; where a key has had no value yet, a sum is 0 and a maximum null.
    """
    fold = {"sum": F.sum, "max": F.max}
    kinds = {n: k for n, (k, _) in values.items()}
    earlier = _earlier(blocked, keys, {n: fold[k](v) for n, (k, v) in values.items()}, kinds)
    w = _within(keys, order)
    own = blocked.withColumns({n: fold[k](v).over(w) for n, (k, v) in values.items()})
    names = {k: f"_k{i}" for i, k in enumerate([*keys, BLOCK])}
    named = earlier.select(*[F.col(k).alias(x) for k, x in names.items()], *[f"_{n}_before" for n in values])
    met = own.join(F.broadcast(named), [own[k].eqNullSafe(named[x]) for k, x in names.items()], "left")

    def whole(n: str) -> Column:
        if kinds[n] == "max":
            return F.greatest(n, f"_{n}_before")
        kind = own.schema[n].dataType
        return (F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_{n}_before"), F.lit(0))).cast(kind)

    return met.select(*[c for c in own.columns if c not in values], *[whole(n).alias(n) for n in values])


def numbered(df: DataFrame, keys: list[str], order: list[str | Column], to: str = "rn", name: str = "ranges") -> DataFrame:
    """``df`` with the number from 1 of each row in its key's order, and the block."""
    return running(cut(df, keys, order, name), keys, order, {to: ("sum", F.lit(1).cast("bigint"))})


def pieces(df: DataFrame, number: str, size: int, overlap: int, piece: str = "piece") -> DataFrame:
    """Rows numbered from 1 within keys, dealt in pieces of ``size`` rows; each piece begins with the ``overlap`` rows before it.

    A row is its piece's own if ``(number - 1) div size`` is the piece; the others are there to be looked back at.
    """
    at = F.col(number) - 1
    return df.withColumn(piece, F.explode(F.sequence(F.floor(at / size), F.floor((at + overlap) / size))))
