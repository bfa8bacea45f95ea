"""Collocations: phrases of two and three words that occur together more often than their parts suggest.

Vertical positional lists. Texts of a language are gathered into blocks of about ``BLOCK`` bytes; a block is one row that
holds its distinct words and, word after word, the sorted positions at which each occurs. Positions run on within a piece
of text and leave a gap between pieces, so what stands at neighbouring positions is adjacent within one piece. A phrase's
list is extended by merging: lists are brought into the order of positions, where the postings of the next word follow at
once. The length of a list is the phrase's exact frequency in the block, and blocks are summed.

Only frequent phrases are extended, as no phrase is more frequent than its parts. Whether a part is frequent is looked
up in a bitmap of ``SLOTS`` hashed places, whose size is fixed however large the corpus; phrases that share a place with a
frequent one are counted in vain, and leave by their exact sums.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.llm.arrow import arrow_schema, map_batches, slices, small_batches
from lagloom.sources.shared import keep, new_path

BLOCK, HELD = 1 << 22, 1 << 25
#: Bytes of a row group of blocks.
GROUP = 1 << 23
#: Places of a bitmap; a bitmap is 8 MB, and at most a million rows gather it.
SLOTS = 1 << 26
LEAST, SHARE, TOP, SPREAD = 10, 50, 2000, 64
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_END = re.compile(rb"[.,;:!?\x0a-\x0d]")
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = 1
_KIND[list(_ENDS)] = 2
_LISTS = "lang string, n bigint, words array<string>, counts array<int>, places binary"
_COUNTS = "lang string, phrase string, f bigint"


def positions(text: bytes) -> tuple[pa.Array, np.ndarray]:
    """The words of ``text`` in order, and their positions, which leave out a number wherever a piece ends."""
    data = np.frombuffer(text.translate(_LOWER), np.uint8)
    kind = _KIND[data]
    inside = np.concatenate([[False], kind == 0, [False]])
    first, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    offsets = np.concatenate([[0], np.cumsum(end - first)]).astype(np.int32)
    words = pa.Array.from_buffers(pa.utf8(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[kind == 0])])
    ends = np.cumsum(kind == 2, dtype=np.int32)[first]
    return words, (np.arange(len(first)) + np.cumsum(np.diff(ends, prepend=ends[:1]) > 0)).astype(np.int32)


def inverted(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, how often each occurs, and the sorted positions of each, one list after the other."""
    words, at = positions(text)
    coded = words.dictionary_encode()
    ids = np.asarray(coded.indices)
    return coded.dictionary, np.bincount(ids, minlength=len(coded.dictionary)), at[np.argsort(ids, kind="stable")]


def lists(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row for each block: lang, n (words), words, counts, places (32-bit differences of positions), written to the shared folder."""
    schema = arrow_schema(_LISTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def block(lang: str) -> pa.RecordBatch:
            # Texts are joined by what ends a piece.
            words, counts, places = inverted(b"\n".join(held.pop(lang)))
            size.pop(lang)
            columns = [[lang], [len(places)], pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), pa.ListArray.from_arrays(pa.array([0, len(counts)], pa.int32()), pa.array(counts.astype(np.int32))), [np.diff(places, prepend=np.int32(0)).tobytes()]]
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, schema.field(i).type) for i, c in enumerate(columns)], schema=schema)

        for piece in slices(batches, 256):
            for lang, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                whole, at = text.encode("utf-8"), 0
                while at < len(whole):
                    # A very long text goes on in another block where one of its pieces ends.
                    cut = _END.search(whole, at + BLOCK) if len(whole) - at > BLOCK else None
                    part = whole[at : cut.end() if cut else len(whole)]
                    at += len(part)
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part)
                    if size[lang] >= BLOCK:
                        yield block(lang)
                    elif sum(size.values()) >= HELD:
                        yield block(max(size, key=size.get))
        for lang in list(held):
            yield block(lang)

    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    path = new_path(spark, "lists")
    # Small row groups: writer and reader hold one. Parquet looks at sizes after 100 rows, which blocks would never reach.
    map_batches(texts, run, _LISTS).write.option("parquet.block.size", GROUP).option("parquet.page.size.row.check.min", 1).option("compression", "zstd").parquet(path)
    return spark.read.schema(_LISTS).parquet(path)


def _word_hash(lang: str | Column, word: str | Column) -> Column:
    return F.xxhash64(lang, word)


def word_hashes(lang: str, words: list[str]) -> np.ndarray:
    """What ``xxhash64(lang, word)`` is in Spark: the first value's hash is the next one's seed."""
    import xxhash

    seed = xxhash.xxh64_intdigest(lang.encode("utf-8"), 42)
    return np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8"), seed) for w in words), np.uint64, len(words))


def _slot(first: Column, second: Column | None = None) -> Column:
    whole = first if second is None else F.shiftleft(first, 1).bitwiseXOR(second)
    return whole.bitwiseAND(F.lit(SLOTS - 1))


def bitmap(slots: DataFrame) -> np.ndarray:
    """The bitmap of the column ``slot``: at most ``SLOTS`` / 64 rows come to the driver, whatever the input."""
    part = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64, np.int64)
    out[np.asarray(part.column("at"))] = np.asarray(part.column("bits"))
    return out.view(np.uint64)


def _among(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def extended(lang: str, words: pa.Array, counts: np.ndarray, places: np.ndarray, one: np.ndarray, two: np.ndarray | None) -> tuple[pa.Array, np.ndarray]:
    """The phrases of two words (or of three, given the bitmap of pairs) in a block whose parts may be frequent, and their list's lengths."""
    h = word_hashes(lang, words.to_pylist())
    last = np.uint64(64 * len(one) - 1)
    ids = np.repeat(np.arange(len(words)), counts)
    often = _among(one, h & last)[ids]
    at, ids = places[often], ids[often]
    order = np.argsort(at, kind="stable")  # merges sorted lists
    at, ids = at[order], ids[order]
    follows = np.flatnonzero(at[1:] == at[:-1] + 1)
    pairs, which, n = np.unique(ids[follows] * len(words) + ids[follows + 1], return_inverse=True, return_counts=True)
    a, b = pairs // max(1, len(words)), pairs % max(1, len(words))
    if two is None:
        return pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), " "), n
    often = _among(two, (h[a] << np.uint64(1) ^ h[b]) & last)[which]
    at, which = at[follows][often], which[often]
    follows = np.flatnonzero(at[1:] == at[:-1] + 1)
    triples, n = np.unique(which[follows] * len(words) + b[which[follows + 1]], return_counts=True)
    head, third = triples // max(1, len(words)), triples % max(1, len(words))
    return pc.binary_join_element_wise(*(words.take(pa.array(x)) for x in (a[head], b[head], third)), " "), n


def _extend(blocks: DataFrame, one: Broadcast, two: Broadcast | None, least: int) -> DataFrame:
    """(lang, phrase, f) of the frequent phrases one word longer."""
    schema = arrow_schema(_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in slices(batches, 1):
            lang = row.column(0)[0].as_py()
            counts = np.asarray(row.column(2)[0].values)
            places = np.cumsum(np.frombuffer(row.column(3)[0].as_buffer(), np.int32), dtype=np.int32)
            phrases, n = extended(lang, row.column(1)[0].values, counts, places, one.value, two.value if two else None)
            for at in range(0, len(n), 1 << 15):
                part = phrases[at : at + (1 << 15)]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), part, pa.array(n[at : at + (1 << 15)], pa.int64())], schema=schema)

    found = map_batches(blocks.select("lang", "words", "counts", "places"), run, _COUNTS)
    return keep(found.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least), "phrases")


def frequent(blocks: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, phrase, f) of the words, pairs and triples that occur ``least`` times at least."""
    sc = blocks.sparkSession.sparkContext
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    ones = keep(each.groupBy("lang", F.col("x.words").alias("phrase")).agg(F.sum("x.counts").alias("f")).filter(F.col("f") >= least), "words")
    one = sc.broadcast(bitmap(ones.select(_slot(_word_hash("lang", "phrase")).alias("slot"))))
    twos = _extend(blocks, one, None, least)
    part = F.split("phrase", " ", -1)
    two = sc.broadcast(bitmap(twos.select(_slot(_word_hash("lang", part[0]), _word_hash("lang", part[1])).alias("slot"))))
    threes = _extend(blocks, one, two, least)
    one.unpersist()
    two.unpersist()
    return ones, twos, threes


def _score(a: str, left: str, right: str) -> Column:
    """floor(1,000,000 a^2 / (l r)), exact: products have up to 38 digits."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(18,0)))")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language.

    Null texts count as empty, null languages as ``und``; repeated rows count as often as they stand; texts without words
    and an empty table give nothing. Ties are told apart by frequency and phrase. Very long texts are whole. Other columns
    of ``docs`` are not read.
    """
    blocks = lists(docs, text_col, lang_col)
    total = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    ones, twos, threes = frequent(blocks, least)
    of = lambda df, key, f: df.select("lang", F.col("phrase").alias(key), F.col("f").alias(f))
    w = F.split("phrase", " ", -1)
    longer = threes.select("lang", "f", F.explode(F.array(F.concat_ws(" ", w[0], w[1]), F.concat_ws(" ", w[1], w[2]))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    pairs = twos.join(longer, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (100 * F.col("most") < share * F.col("f")))
    pairs = pairs.select("lang", "phrase", F.col("f").alias("a"), w[0].alias("w1"), w[1].alias("w2")).join(of(ones, "w1", "l"), ["lang", "w1"]).join(of(ones, "w2", "r"), ["lang", "w2"])
    pairs = pairs.select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"))
    wide = threes.select("lang", "phrase", F.col("f").alias("a"), w[0].alias("w1"), w[2].alias("w3"), F.concat_ws(" ", w[0], w[1]).alias("head"), F.concat_ws(" ", w[1], w[2]).alias("tail"))
    wide = wide.join(of(ones, "w1", "l1"), ["lang", "w1"]).join(of(twos, "tail", "r1"), ["lang", "tail"]).join(of(twos, "head", "l2"), ["lang", "head"]).join(of(ones, "w3", "r2"), ["lang", "w3"])
    wide = wide.withColumns({"s1": _score("a", "l1", "r1"), "s2": _score("a", "l2", "r2")})
    first = F.col("s1") <= F.col("s2")
    triples = wide.select("lang", "phrase", "a", *[F.when(first, x).otherwise(F.col(y)).alias(name) for x, y, name in ((F.col("l1"), "l2", "l"), (F.col("r1"), "r2", "r"), (F.col("s1"), "s2", "score"))])
    order = [F.desc("score"), F.desc("a"), "phrase"]
    scored = pairs.unionByName(triples).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    # A language's candidates first compete in parts, so that the last window sees a bounded number of rows.
    near = scored.withColumn("_k", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("_k") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return best.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2,000 best phrases over all ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_GRAMS = ", ".join(f"f{k} AS (SELECT lang, array_to_string(words[i:i + {k - 1}], ' ') AS phrase, count(*) AS f FROM (SELECT lang, words, unnest(range(1, len(words) - {k - 2})) AS i FROM pieces) GROUP BY 1, 2{' HAVING count(*) >= 10' if k > 1 else ''})" for k in (1, 2, 3))
OP12_SQL = rf"""WITH pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
{_GRAMS},
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f1 GROUP BY 1),
p2 AS (SELECT *, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 2) AS w2 FROM f2),
p3 AS (SELECT *, split_part(phrase, ' ', 1) AS w1, split_part(phrase, ' ', 2) AS w2, split_part(phrase, ' ', 3) AS w3 FROM f3),
longer AS (SELECT lang, phrase, max(f) AS most FROM (SELECT lang, w1 || ' ' || w2 AS phrase, f FROM p3 UNION ALL SELECT lang, w2 || ' ' || w3, f FROM p3) GROUP BY 1, 2),
cuts AS (
  SELECT p2.lang, p2.phrase, p2.f AS a, x.f AS l, y.f AS r, 1 AS k FROM p2 JOIN f1 x ON x.lang = p2.lang AND x.phrase = w1 JOIN f1 y ON y.lang = p2.lang AND y.phrase = w2
    LEFT JOIN longer ON longer.lang = p2.lang AND longer.phrase = p2.phrase WHERE most IS NULL OR 100 * most < 50 * p2.f
  UNION ALL SELECT p3.lang, p3.phrase, p3.f, x.f, y.f, 1 FROM p3 JOIN f1 x ON x.lang = p3.lang AND x.phrase = w1 JOIN f2 y ON y.lang = p3.lang AND y.phrase = w2 || ' ' || w3
  UNION ALL SELECT p3.lang, p3.phrase, p3.f, x.f, y.f, 2 FROM p3 JOIN f2 x ON x.lang = p3.lang AND x.phrase = w1 || ' ' || w2 JOIN f1 y ON y.lang = p3.lang AND y.phrase = w3),
scored AS (SELECT *, CAST((1000000::HUGEINT * a * a) // (l::HUGEINT * r) AS BIGINT) AS score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY (1000000::HUGEINT * a * a) // (l::HUGEINT * r), k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM scored JOIN n USING (lang) QUALIFY rank <= 2000"""
