"""Near copies by exact Jaccard similarity of five-word shingles, for the pipeline: SimHash, and what it cannot reach.

Candidates are the links of the Gray-order index of ``simhash`` (five words, 3 of 64 bits), texts of one fingerprint, and
texts that share a band of min-hashes. At a similarity of 0.8 fingerprints differ in about 10 bits, in one of a hundred pairs in
17, and no index over 64 bits can look that far; a pair of that similarity shares none of 32 bands with probability 5e-8.
``minhash`` prunes candidates by their signatures and verifies the rest on whole sets, so nothing below 0.8 is linked; it also says
how keys of any size are dealt out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagloom.llm import minhash
from lagloom.llm.arrow import Columns, map_columns
from lagloom.llm.decontaminate import small
from lagloom.llm.simhash import fingerprint, links
from lagloom.sources.shared import discard, keep

WORDS = 5


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes, one for each fingerprint, that the Gray-order index links."""
    by_print = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    found = links(by_print.select("fp"))
    of = lambda x: by_print.select(F.col("fp").alias(x), F.col("node").alias(f"node_{x}"))
    both = found.join(of("a"), "a").join(of("b"), "b")
    return both.select(F.greatest("node_a", "node_b").alias("a"), F.least("node_a", "node_b").alias("b"))


def _row_key(id_col: str, text: Column) -> Column:
    """128 bits over id and text: rows of one key are equal."""
    return F.unhex(F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("none")), F.lit(":"), text).cast("binary")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies, with all their columns.

    Rows are keyed by id and text, so texts that share an id are judged apart. Of a group of near copies the row with
    the smallest id stays (rows without an id come last; of one id's texts the one of smallest digest stays). Of rows
    equal in id and text one stays. Null, empty and blank texts are copies of each other. Very long texts are whole.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def make():
        def sign(c: Columns) -> Columns:
            sets = minhash.shingle_sets(c["text"], WORDS)
            keys, sketches = zip(*map(minhash.signature, sets), strict=True)
            return {k: c[k] for k in ("id", "row_key", "mark")} | {"digest": [minhash.digest(s) for s in sets], "size": [len(s) for s in sets], "fp": [fingerprint(t, WORDS) for t in c["text"]], "keys": keys, "sketch": sketches}

        return sign

    rows = docs.select(F.col(id_col).cast("long").alias("id"), _row_key(id_col, text).alias("row_key"), F.xxhash64(text).alias("mark"), text.alias("text"))
    signed = keep(map_columns(rows, make, "id long, row_key binary, mark long, digest binary, size long, fp long, keys array<long>, sketch binary"), "signed")
    first = [F.first(c).alias(c) for c in ("mark", "size", "fp", "keys", "sketch")]
    nodes = keep(signed.groupBy("digest").agg(*first).withColumn("node", F.monotonically_increasing_id()), "nodes")
    written = nodes.filter("size > 0")
    keyed = written.select("node", "size", F.concat("keys", F.array(F.xxhash64(F.lit("print"), "fp"))).alias("keys"), "sketch")
    roots = minhash.linked(keyed, minhash._sets(docs.select(text.alias("text")), nodes, WORDS), _simhash_pairs(written))
    named = keep(nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root")), "named")
    each = signed.groupBy("row_key").agg(F.first("digest").alias("digest"), F.first("id").alias("id"), F.count("*").alias("n"))
    each = keep(each.join(named, "digest").select("row_key", "id", "n", "root"), "rows")
    discard(signed, nodes, named)
    kept = each.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_key")).alias("first"), F.count("*").alias("m")).filter("m > 1").select("root", F.col("first.row_key").alias("kept"))
    gone = keep(each.join(kept, "root").filter("row_key <> kept").select("row_key"), "gone")
    twice = keep(each.filter("n > 1").select("row_key", F.lit(True).alias("twice")), "twice")
    # Names that ``docs`` cannot have itself.
    name = "_key_of_" + "_".join(docs.columns)
    left = docs.withColumn(name, _row_key(id_col, text)).join(small(gone.withColumnRenamed("row_key", name)), name, "left_anti").join(small(twice.select(F.col("row_key").alias(name), F.col("twice").alias(f"{name}_twice"))), name, "left")
    # Only repeated rows are shuffled.
    return left.filter(F.col(f"{name}_twice").isNull()).unionByName(left.filter(f"`{name}_twice`").dropDuplicates([name])).select(*docs.columns)
