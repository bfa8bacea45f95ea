"""Keys and merges: the semantics of primary keys on tables without enforced ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Insert-or-ignore: of the rows of a key the first in ``order`` stays.

    An aggregation with map-side combine, not a sort by key: a frequent key crosses the shuffle once a task.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def last_by_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Upsert: of the rows of a key the last in ``order`` stays."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def insert_or_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Existing rows, and of the new ones the first of each key that is not there yet."""
    return existing.unionByName(first_by_key(new, keys, order).join(existing.select(*keys), keys, "left_anti"))


def upsert(existing: DataFrame, new: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """New rows replace existing ones of their key."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(last_by_key(new, keys, order))


def skip_done(items: DataFrame, progress: DataFrame, key: str, status: str = "done") -> DataFrame:
    """Items whose key is not marked as done."""
    return items.join(progress.filter(F.col("status") == status).select(key), key, "left_anti")


def unpivot(df: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Columns to rows; rows without a value drop."""
    return df.unpivot(ids, values, name, value).filter(F.col(value).isNotNull())


def latest(df: DataFrame, value: str, order: str) -> DataFrame:
    """One row: ``value`` of the largest ``order``."""
    return df.agg(F.max_by(value, order).alias(value))


def missing_keys(df: DataFrame, key: str, expected: list[str]) -> DataFrame:
    want = df.sparkSession.createDataFrame([(k,) for k in expected], f"{key} string")
    return want.join(df.select(key).distinct(), key, "left_anti")


def map_names(df: DataFrame, col: str, table: dict[str, str]) -> Column:
    """Looked up by ``table``; names it lacks stay as they are."""
    pairs = [x for k, v in table.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(col)), F.col(col))

