"""Intermediate tables in the folder that driver and executors share.

``spark.checkpoint.dir`` names that folder on a cluster, or ``SparkContext.setCheckpointDir`` does. Where neither is set,
a temporary folder stands in on a local master (tests, a laptop); on any other it would lie on one machine, and others
would read incomplete tables, so that is an error. Tables are written by Spark's own committer, so a lost executor
costs a retried task and no data. They lie in a folder of the application, which ``clear`` deletes.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def one_machine(master: str) -> bool:
    """Whether driver and executors are one process ('local', 'local[8]'; 'local-cluster[...]' has executors of its own)."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if named:
        return named.rstrip("/")
    if not one_machine(spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lagloom-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return f"file://{_LOCAL[0]}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lagloom/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the application's folder that nothing else uses."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has kept. Results that still read it must be written first."""
    drop(spark, _own(spark))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*kept: DataFrame) -> None:
    """Delete tables that ``keep`` has written and nothing reads any more."""
    for df in kept:
        drop(df.sparkSession, df._kept_at)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of this module by Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def put(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one small file by Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        stream.write(bytearray(content))
    finally:
        stream.close()
