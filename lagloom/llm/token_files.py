"""Token ids on disk: shared frequency tables, independent rANS blocks, checkpoints, checksums.

``write_tokens`` deals documents into ranges of ascending id, encodes their texts, gathers the ids into frames of whole
documents, counts the ids of the whole corpus once, and codes every frame with the one table of frequencies. The
files are Parquet containers written by Spark's committer (any file system, lost tasks are repeated):

* ``<path>/table``: one row per id that occurs: id, freq, bits (frequencies add up to 2**bits);
* ``<path>/frames``: one row per frame: part and frame (the order of the corpus), start (ids before the frame in its
  part), n_ids, doc_ids and doc_sizes, and the rANS blocks, each with its checkpoints and checksum.

``read_tokens`` decodes the frames in any order and returns documents; ``digest_tokens`` returns their digests.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.arrow import Columns, arrow_schema, map_batches, map_columns, slices
from lagloom.llm.pieces import encoder
from lagloom.llm.rans import Coder, quantise
from lagloom.sources.shared import drop, new_path

FRAME_IDS, BLOCK_IDS = 1 << 16, 1 << 16
RAW = "part int, frame int, start long, n_ids long, doc_ids array<long>, doc_sizes array<long>, ids binary"
CODED = "part int, frame int, start long, n_ids long, doc_ids array<long>, doc_sizes array<long>, blocks array<binary>"


def _frames(name: str, end_id: int):
    out = arrow_schema(RAW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, frame, start, held = TaskContext.get().partitionId(), 0, 0, 0
        end = np.asarray([end_id], "<u4").tobytes()
        docs, sizes, ids = [], [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"part": [part], "frame": [frame], "start": [start], "n_ids": [held], "doc_ids": [docs], "doc_sizes": [sizes], "ids": [b"".join(ids)]}, schema=out)

        for some in slices(batches, 1024):
            own, at = encoder(name).encode_array(some.column(1))
            for doc, i, j in zip(some.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                docs.append(doc)
                sizes.append(int(j - i) + 1)
                ids.append(own[i:j].tobytes() + end)
                held += sizes[-1]
                if held >= FRAME_IDS:
                    yield flush()
                    frame, start, held, docs, sizes, ids = frame + 1, start + held, 0, [], [], []
        if docs:
            yield flush()

    return run


def _histogram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw in batch["ids"]:
            n = np.bincount(np.frombuffer(raw, "<u4"), minlength=len(total))
            n[: len(total)] += total
            total = n
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"id": seen, "n": total[seen]})


def _coder(table: pd.DataFrame) -> Coder:
    if not len(table):
        return Coder(np.zeros(1, np.int64), 16)  # no ids, no blocks
    freq = np.zeros(int(table["id"].max()) + 1, np.int64)
    freq[table["id"]] = table["freq"]
    return Coder(freq, int(table["bits"].iloc[0]))


def _encode(table: pd.DataFrame):
    def make():
        coder = _coder(table)

        def encode(c: Columns) -> Columns:
            cut = [[x[i : i + BLOCK_IDS] for i in range(0, len(x), BLOCK_IDS)] for x in (np.frombuffer(r, "<u4").astype(np.int64) for r in c.pop("ids"))]
            coded = iter(coder.encode([b for x in cut for b in x]))
            return c | {"blocks": [[next(coded) for _ in x] for x in cut]}

        return encode

    return make


def write_tokens(docs: DataFrame, path: str, name: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` to ``path`` in ascending order of id, each document followed by ``end_id``.

    A null text is empty (its document holds the end id alone). A null id sorts first. Rows with equal ids keep their
    own documents, in the order of a hash of their texts. An empty table gives a valid folder without frames. Other
    columns of ``docs`` are not read. The ranges are balanced by sampling keys, so one frequent id cannot gather rows
    of other ids, and equal ids are dealt by the hash of their text.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    raw = new_path(spark, "ids")
    map_batches(ranged, _frames(name, end_id), RAW).write.parquet(raw)
    frames = spark.read.schema(RAW).parquet(raw)
    # At most one row per vocabulary entry: bounded by the tokenizer, whatever the corpus.
    counts = frames.select("ids").mapInPandas(_histogram, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    dense = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 0, np.int64)
    dense[counts["id"]] = counts["n"]
    freq, bits = quantise(dense)
    seen = np.flatnonzero(freq)
    table = pd.DataFrame({"id": seen, "freq": freq[seen], "bits": bits})
    spark.createDataFrame(table.astype("int64"), "id long, freq long, bits long").coalesce(1).write.parquet(f"{path}/table")
    map_columns(frames, _encode(table), CODED, rows=16).write.parquet(f"{path}/frames")
    drop(spark, raw)


def _documents(table: pd.DataFrame, base: dict[int, int], digest: bool):
    def make():
        coder = _coder(table)

        def decode(c: Columns) -> Columns:
            rows = []
            decoded = iter(coder.decode([b for blocks in c["blocks"] for b in blocks]))
            for part, start, n, docs, sizes, blocks in zip(*(c[x] for x in ("part", "start", "n_ids", "doc_ids", "doc_sizes", "blocks")), strict=True):
                ids = np.concatenate([next(decoded) for _ in blocks]).astype("<u4")
                if len(ids) != n:
                    raise ValueError("a frame holds another number of ids than its index says")
                place, own = base[part] + start, 0
                for doc, size in zip(docs, sizes, strict=True):
                    mine = ids[own : own + size]
                    rows.append((doc, place + own, size, zlib.crc32(mine.tobytes()) if digest else mine.astype(np.int64)))
                    own += size
            return dict(zip(("doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"), map(list, zip(*rows, strict=True)), strict=True))

        return decode

    return make


def _read(spark: SparkSession, path: str, digest: bool, schema: str) -> DataFrame:
    frames = spark.read.schema(CODED).parquet(f"{path}/frames")
    table = spark.read.parquet(f"{path}/table").toPandas()  # one row per vocabulary entry
    # One row per part (a task's output), not per document.
    sizes = {r["part"]: r["n"] for r in frames.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    base, before = {}, 0
    for part in sorted(sizes):
        base[part], before = before, before + sizes[part]
    if not sizes:
        return spark.createDataFrame([], schema)
    return map_columns(frames, _documents(table, base, digest), schema, rows=16)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (array<long>) per document."""
    return _read(spark, path, False, "doc_id long, start long, n_tokens long, ids array<long>")


def digest_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) per document."""
    return _read(spark, path, True, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, "byte_bpe_50k.json", end_id=2)
    return digest_tokens(spark, path)
