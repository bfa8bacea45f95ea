"""A pipeline over documents; its stages call the operators of lagloom.llm.

Stages, each on all rows that the one before kept, all but the last with the columns of documents:

1. toxicity: documents that the factorization machine rejects go;
2. near_dedup: of documents linked by a five-word Jaccard similarity of 0.8 or more that with the smallest id stays
   (of rows that repeat an id and text, one);
3. decontamination: documents that hold a benchmark item go;
4. secrets: secrets and linked credentials in texts are replaced by a mark;
5. packing: texts become token pieces, packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lagloom.llm import decontaminate, near_copies, packing, secrets, toxicity
from lagloom.llm.arrow import small_batches
from lagloom.sources.shared import keep


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the machine does not predict toxic, with all columns.

    Null and empty texts are scored as texts without known terms, and stay unless those count as toxic; null ids and
    repeated rows are judged by their texts; without labels every row has the score 0.5 and none would stay, so then all
    stay; an empty table gives no rows.
    """
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = toxicity.fit(docs, labels.filter(toxicity.crc_mod("doc_id", 5) != 0))
    return toxicity.keep_clean(docs, machine)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies by five-word Jaccard similarity the row with the smallest id stays, with all columns.

    Rows are keyed by id and text: texts that share an id are judged apart, of rows equal in both one stays, rows without
    an id come last. Null, empty and blank texts are copies of each other; an empty table gives no rows.
    """
    small_batches(spark)
    return near_copies.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose own text holds no benchmark item of 8 words or more, with all columns.

    Rows without an id and several texts of one id are judged one by one; null and empty texts, and repeated rows, stay;
    an empty table or benchmark drops nothing.
    """
    return decontaminate.keep_uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows and columns; secrets in the text become [SECRET], and n_chars follows.

    Null texts stay null, texts without a secret stay as they are; null ids and repeated rows stay.
    """
    small_batches(spark)
    return secrets.redact_secrets(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    A null or empty text is a piece of its end id alone; null ids and repeated rows each keep their pieces; an empty
    table gives no rows.
    """
    small_batches(spark)
    # Workers serve all stages: fewer words than op4 remembers leave room for the others.
    return packing.pack(docs, "word_bpe_49k.json", remembered=100_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secrets_stage),
    ("packing", packing_stage),
]

#: SQL cannot state the model, the fingerprints or the tokens; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir).select(*columns), name)
    return STAGES[-1][1](spark, docs, sf_dir)
