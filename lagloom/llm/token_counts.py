"""Token counts through a digest cache.

The normalised content of a text (null becomes empty; nothing else may change, or the count would) and the tokenizer's
version are digested. The digests are joined to stored counts; of the misses one text per digest is encoded, and the
new counts are appended to the cache, a Parquet folder with a partition for each tokenizer version.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from importlib import metadata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.arrow import arrow_schema, map_batches, slices
from lagloom.llm.pieces import encoder, vocabulary
from lagloom.llm.decontaminate import small
from lagloom.sources.shared import keep, new_path, shared_dir

COUNTED = "digest binary, n_tokens long"
CACHE_SCHEMA = f"{COUNTED}, version string"
#: Misses whose digests may be broadcast: 10 MB.
FEW_MISSES = 200_000


def tokenizer_version(name: str) -> str:
    """Digest of the vocabulary file and the library's version: where one is another, so may the counts be."""
    library = metadata.version("tokenizers" if name.endswith(".json") else "sentencepiece")
    with open(vocabulary(name), "rb") as f:
        return hashlib.sha256(f.read() + library.encode()).hexdigest()


def count_array(name: str, texts: pa.Array) -> np.ndarray:
    """Token counts by tokenizers (``.json``) or sentencepiece (``.model``)."""
    if name.endswith(".json"):
        return np.diff(encoder(name).encode_array(texts)[1])
    import sentencepiece

    return np.asarray([len(x) for x in sentencepiece.SentencePieceProcessor(model_file=vocabulary(name)).encode(texts.to_pylist(), num_threads=1)], np.int64)


def _count(name: str):
    out = arrow_schema(COUNTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in slices(batches, 1024):
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array(count_array(name, some.column(1)), pa.int64())], schema=out)

    return run


def stored(spark: SparkSession, path: str, version: str) -> DataFrame:
    """digest, n_tokens of a cache, one row a digest: runs that appended at the same time may have stored it twice."""
    if not _exists(spark, path):
        return spark.createDataFrame([], COUNTED)
    rows = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("version") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, name: str, cache: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``cache`` is the folder of stored counts; it is created where it does not exist, and misses are appended to it.
    Without one, a fresh folder serves this run alone. A null text counts as empty (0 bytes, 0 tokens), a null id stays
    null, repeated rows each keep their row, an empty table gives no rows. Other columns of ``docs`` are not read, so
    their names cannot clash. Texts are whole.
    """
    spark: SparkSession = docs.sparkSession
    path = cache or new_path(spark, "counts")
    version = tokenizer_version(name)
    text = F.coalesce(F.col(text_col), F.lit(""))
    # 256 bits of digest over tokenizer and content: equal digests are equal contents.
    digest = F.unhex(F.sha2(F.concat(F.lit(version), text), 256)).alias("digest")
    rows = keep(docs.select(F.col(id_col).alias("doc_id"), digest, F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    misses = keep(rows.select("digest").distinct().join(stored(spark, path, version), "digest", "left_anti"), "misses")
    if not misses.isEmpty():
        keyed = docs.select(digest, text.alias("text"))
        few = small(misses, FEW_MISSES)
        # Few misses: texts that are stored already cross no shuffle.
        keyed = keyed.join(few, "digest", "left_semi") if few is not misses else keyed
        # One text a digest: copies meet in the map-side part already, so a hot text crosses the shuffle once a task.
        first = keyed.groupBy("digest").agg(F.min("text").alias("text"))
        first = first if few is not misses else first.join(misses.hint("merge"), "digest", "left_semi")
        counted = map_batches(first, _count(name), COUNTED).withColumn("version", F.lit(version))
        counted.write.mode("append").partitionBy("version").parquet(path)
    counts = stored(spark, path, version)
    # Left outer, so that a hot digest's rows can be split among tasks (the counts have one row a digest).
    return rows.join(counts.hint("merge"), "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts through a cache in the shared folder, one for each folder of tables: a second run over it encodes nothing."""
    corpus = hashlib.sha256(sf_dir.rstrip("/").encode()).hexdigest()[:16]
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), "byte_bpe_50k.json", f"{shared_dir(spark)}/lagloom/token-counts-{corpus}")
