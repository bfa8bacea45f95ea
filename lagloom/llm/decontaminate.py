"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask of 8 word positions hashes 5 of them and ignores 3. The hashes of all windows of the benchmark are joined to
those of the whole training texts; a hit names a document, an item and the shift between them. Around each hit the
item is laid over the document at that shift, word by word, and counts if some window of min(words of the item, 20)
has at least 80 % equal words: substitutions are tolerated, as the ignored positions let windows hit in spite of
them. The four masks together hit every window of 8 to 20 words with as many substitutions as 80 % allow (enumerated in
the tests), so nothing of that likeness is missed.

The shifts of a document and an item are gathered before anything is laid over anything: a text of one repeated word
meets an item of that word at each of its places, and costs no more than its length times that of the item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.sources.shared import keep

MASKS = ("11111000", "11101100", "10010111", "01110011")
SPAN = len(MASKS[0])
#: Rows that may be broadcast: at 40 bytes a row, 80 MB at most.
BROADCAST_ROWS = 2_000_000


def words(text: Column) -> Column:
    """Hashes of the lower-cased words (runs of letters and digits), in order."""
    split = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(split, lambda w: F.xxhash64(w))


def windows(rows: DataFrame, h: str, *keep_cols: str) -> DataFrame:
    """keep_cols, start and seed for each window of the word hashes ``h`` and each mask."""

    def codes(m: int) -> Column:
        at = [i for i, c in enumerate(MASKS[m]) if c == "1"]
        return F.transform(F.sequence(F.lit(0), F.size(h) - SPAN), lambda k: F.xxhash64(F.lit(m), *[F.get(h, k + i) for i in at]))

    every = F.when(F.size(h) >= SPAN, F.concat(*map(codes, range(len(MASKS)))))
    listed = rows.select(*keep_cols, (F.size(h) - SPAN + 1).alias("n"), every.alias("seeds"))
    # The outer form, as the plain one pushes a filter that computes the array again below.
    return listed.select(*keep_cols, "n", F.posexplode_outer("seeds").alias("place", "seed")).filter("seed is not null").select(*keep_cols, (F.col("place") % F.col("n")).alias("start"), "seed")


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted rows allow; otherwise the join shuffles."""
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and the key of a row in 128 bits: equal ids with other texts stay apart, equal rows are one."""
    i, t = F.col(id_col), F.col(text_col)
    one, two = _key(i, t)
    return docs.select(i.alias("doc_id"), t.alias("text"), one.alias("key_1"), two.alias("key_2"))


def _key(i: Column, t: Column) -> list[Column]:
    return [F.xxhash64(i, t), F.xxhash64(F.lit(1), t, i)]


def seed_hits(train: DataFrame, tests: DataFrame, salts: int = 16) -> DataFrame:
    """Windows joined by seed: broadcast if the tests are few, else shuffled, a frequent seed over ``salts`` tasks."""
    few = small(tests)
    if few is not tests:
        return train.join(few, "seed")
    salted = tests.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return train.withColumn("salt", F.pmod("key_1", F.lit(salts)).cast("int")).join(salted, ["seed", "salt"]).drop("salt")


def _found(docs: DataFrame, benchmark: DataFrame, share: float, most: int, id_col: str, text_col: str, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame]:
    """Rows and items that belong together (key_1, key_2, doc_id, item_key, n_window, n_equal), and the items' ids."""
    items = benchmark.select(F.col(item_col).alias("item_id"), words(F.col(item_text)).alias("item")).filter(F.size("item") >= SPAN)
    items = keep(items.withColumn("item_key", F.xxhash64("item")), "items")
    each = keep(items.groupBy("item_key", "item").agg(F.count("*").alias("n")).drop("n"), "distinct_items")
    tests = keep(windows(each, "item", "item_key").withColumnRenamed("start", "item_start"), "seeds")
    keyed = _keyed(docs, id_col, text_col)
    # Words become a column of their own first: inside a lambda they would be split again for every window.
    train = windows(keyed.select("key_1", "key_2", words(F.col("text")).alias("h")), "h", "key_1", "key_2")
    hits = seed_hits(train, tests).select("key_1", "key_2", "item_key", (F.col("start") - F.col("item_start")).alias("shift"))
    # No list is longer than a document and an item together.
    hits = keep(hits.distinct().groupBy("key_1", "key_2", "item_key").agg(F.collect_list("shift").alias("shifts")), "hits")
    # Only documents with a hit are read again in full.
    wanted = small(hits.select("key_1", "key_2").distinct())
    whole = keyed.join(wanted, ["key_1", "key_2"], "left_semi").dropDuplicates(["key_1", "key_2"]).select("doc_id", "key_1", "key_2", words(F.col("text")).alias("h"))
    laid = hits.join(whole, ["key_1", "key_2"]).join(small(each), "item_key").withColumn("n_window", F.least(F.size("item"), F.lit(most)))

    def best(shift: Column) -> Column:
        equal = F.transform("item", lambda w, i: F.when(F.get("h", i + shift) == w, 1).otherwise(0))
        n = F.col("n_window")
        sums = lambda e: F.transform(F.sequence(F.lit(1), F.size("item") - n + 1), lambda at: F.aggregate(F.slice(e, at, n), F.lit(0), lambda a, x: a + x))
        # As an array's only element it is computed once for all windows.
        return F.get(F.transform(F.array(equal), lambda e: F.array_max(sums(e))), 0)

    scored = laid.select("key_1", "key_2", "doc_id", "item_key", "n_window", F.array_max(F.transform("shifts", best)).alias("n_equal"))
    return scored.filter(F.col("n_equal") >= share * F.col("n_window")), items.select("item_key", "item_id").distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, most: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_window, n_equal: documents that hold a benchmark item, once for each item.

    n_window is min(words of the item, ``most``), n_equal the largest number of equal words in such a window, at least
    ``share`` of it. Items of fewer than 8 words are no evidence and match nothing; null texts have no words. Rows
    with equal ids are judged by their own texts and reported once; null ids of documents and items are reported as
    null. Empty tables give no rows. Other columns are not read.
    """
    scored, ids = _found(docs, benchmark, share, most, id_col, text_col, item_col, item_text)
    found = scored.join(small(ids), "item_key").select("doc_id", "item_id", "n_window", "n_equal")
    return found.groupBy("doc_id", "item_id", "n_window").agg(F.max("n_equal").alias("n_equal"))


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, share: float = 0.8, most: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own text holds no benchmark item, with all their columns.

    Rows without an id, and several texts of one id, are judged one by one; null and empty texts stay, as do repeated
    rows. Empty tables drop nothing.
    """
    scored, _ = _found(docs, benchmark, share, most, id_col, text_col, item_col, item_text)
    found = keep(scored.select("key_1", "key_2").distinct(), "contaminated")
    # Names of columns that ``docs`` may have itself are not touched.
    found = found.select(*[F.col(c).alias(f"_found_{c}") for c in ("key_1", "key_2")])
    one, two = _key(F.col(id_col), F.col(text_col))
    return docs.join(small(found), (one == F.col("_found_key_1")) & (two == F.col("_found_key_2")), "left_anti")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents
), b AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), dw AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), bw AS (
  SELECT item_id, least(len(w), 20) AS n_window, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM b WHERE len(w) >= 8
), likely AS (
  SELECT doc_id, item_id, i - j AS shift FROM dw JOIN bw USING (word) GROUP BY ALL HAVING count(*) >= 0.8 * any_value(n_window)
), laid AS (
  SELECT doc_id, item_id, i - j AS shift, j, n_window,
    count(*) OVER (PARTITION BY doc_id, item_id, i - j ORDER BY j RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS n_equal
  FROM dw JOIN bw USING (word) SEMI JOIN likely ON dw.doc_id = likely.doc_id AND bw.item_id = likely.item_id AND i - j = shift
)
SELECT doc_id, item_id, CAST(n_window AS INTEGER) AS n_window, CAST(max(n_equal) AS INTEGER) AS n_equal
FROM laid GROUP BY doc_id, item_id, n_window HAVING max(n_equal) >= 0.8 * n_window
"""
