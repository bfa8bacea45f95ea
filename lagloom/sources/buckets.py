"""Tables in hash buckets of a key: an upsert reads and writes only the buckets that its rows fall into.

A table is Parquet, partitioned by ``bucket_of_N``, the key's hash modulo N; the column's name tells N, so a table describes
itself. Merged buckets are replaced by Spark's own dynamic partition overwrite: new files are staged beside the table and
take their place when the job commits, so a job that fails before leaves every old bucket as it was. (The commit itself
replaces folder after folder; a reader in between meets old and new buckets, each whole.) One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.operators.tables import insert_or_ignore, last_by_key
from lagloom.operators.tables import upsert as merge

_NAME = "bucket_of_"


def _bucket(keys: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")


def _write(rows: DataFrame, path: str, keys: list[str], n: int) -> None:
    """Each bucket by one task or, where it is large, by several (a rebalance splits what is above the advised size)."""
    name = f"{_NAME}{n}"
    rows = rows.withColumn(name, _bucket(keys, n))
    rows.hint("rebalance", F.col(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)


def create(rows: DataFrame, path: str, keys: list[str], order: list[Column], n: int = 256) -> None:
    """A table of the last row in ``order`` of each key, in ``n`` buckets. Choose n for about 100 MB a bucket."""
    _write(last_by_key(rows, keys, order), path, keys, n)


def _number(df: DataFrame) -> int:
    return next(int(c[len(_NAME) :]) for c in reversed(df.columns) if c.startswith(_NAME) and c[len(_NAME) :].isdigit())


def read(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.drop(f"{_NAME}{_number(df)}")


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return True


def touched(rows: DataFrame, keys: list[str], n: int) -> list[int]:
    """The buckets that ``rows`` fall into: at most ``n`` numbers come to the driver."""
    return sorted(r[0] for r in rows.select(_bucket(keys, n)).distinct().collect())


def _changed(spark: SparkSession, path: str, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, list[int], int]:
    whole = spark.read.parquet(path)
    n = _number(whole)
    hit = touched(rows, keys, n)
    return whole.filter(F.col(f"{_NAME}{n}").isin(hit)).drop(f"{_NAME}{n}"), hit, n


def upsert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[Column], n: int = 256) -> list[int]:
    """``rows`` (the last in ``order`` of each key) replace the table's rows of their keys; gives the buckets rewritten.

    Rows whose key holds a null never meet a row of the table and are added, as in a join. ``rows`` is evaluated twice;
    it must not read ``path``. A table that is not there is created with ``n`` buckets; one without new rows is not touched.
    """
    if not exists(spark, path):
        create(rows, path, keys, order, n)
        return touched(rows, keys, n)
    old, hit, n = _changed(spark, path, rows, keys)
    if hit:
        _write(merge(old, rows.select(*old.columns), keys, order), path, keys, n)
    return hit


def insert(spark: SparkSession, path: str, rows: DataFrame, keys: list[str], order: list[Column]) -> list[int]:
    """Of ``rows`` the first in ``order`` of each key that the table lacks; gives the buckets rewritten."""
    old, _, n = _changed(spark, path, rows, keys)
    # Buckets in which something is new: a repeated insert rewrites nothing.
    new = rows.join(old.select(*keys), keys, "left_anti")
    hit = touched(new, keys, n)
    if hit:
        _write(insert_or_ignore(old.filter(_bucket(keys, n).isin(hit)), new.select(*old.columns), keys, order), path, keys, n)
    return hit


def delete(spark: SparkSession, path: str, keys_of: DataFrame, keys: list[str]) -> list[int]:
    """The rows whose key is in ``keys_of`` go; gives the buckets rewritten. A bucket left empty loses its folder."""
    from lagloom.sources.shared import drop

    old, hit, n = _changed(spark, path, keys_of, keys)
    left = old.join(keys_of.select(*keys).distinct(), keys, "left_anti")
    stay = touched(left, keys, n) if hit else []
    if stay:
        _write(left, path, keys, n)
    for b in set(hit) - set(stay):
        drop(spark, f"{path}/{_NAME}{n}={b}")
    return hit
