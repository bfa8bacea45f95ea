"""SimHash near-duplicates with a Gray-order hierarchical index.

A fingerprint has 64 bits, a majority vote over the hashes of a text's word shingles. Fingerprints that differ in at
most 3 bits are linked, and components of links are the near-duplicate groups.

Search. If two fingerprints differ in at most 3 of some free bits and those are split into 4 blocks, they agree on
one block. Distinct fingerprints are therefore dealt into groups of equal block values; a group of more than
``GROUP`` members is dealt again by 4 blocks of the bits that are still free, so no task gets an unbounded group and
no link is lost. Each deal fixes a quarter of the free bits; after 7 of them at most 9 are free, and 9 bits allow no
more than 512 distinct members, so nothing is dealt more than 7 times. A group is sorted by Gray rank, which puts fingerprints of few differences next to each other. Runs
of 8 form nodes, 8 nodes an upper node; a node keeps the bits on which all below it agree (mask and pattern). Two
nodes are compared by their shared masked bits, and both groups below are pruned as soon as those differ in more than
3 places. A group returns a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.arrow import Columns, arrow_schema, map_batches, map_columns, slices
from lagloom.sources.shared import keep

GROUP, FAN, ALL = 512, 8, np.uint64(0xFFFFFFFFFFFFFFFF)
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
EDGES = "a long, b long"


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """As a signed 64-bit integer. ``bytes.split`` splits at exactly the white space of [\\x20\\x09-\\x0D]."""
    import xxhash

    own = (text or "").encode("utf-8").translate(_LOWER).split()
    if not own:
        return 0
    total, votes = 0, np.zeros(64, np.int64)
    for at in range(0, max(1, len(own) - words + 1), 1 << 15):
        part = own[at : at + (1 << 15) + words - 1]
        grams = map(b" ".join, zip(*(part[k:] for k in range(words)), strict=False)) if len(own) >= words else iter([b" ".join(own)])
        h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(seed)), np.uint64)
        total += len(h)
        votes += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def make():
        return lambda c: {"doc_id": c["doc_id"], "fp": [fingerprint(t, words) for t in c["text"]]}

    return map_columns(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), make, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code word in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def blocks(free: int) -> list[int]:
    """Four masks that split the free bits evenly."""
    bits = [i for i in range(64) if free >> i & 1]
    return [sum(1 << i for i in bits[k * len(bits) // 4 : (k + 1) * len(bits) // 4]) for k in range(4)]


def _pairs(first: np.ndarray, count: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of paired nodes, paired; a node with itself gives each pair of children once."""
    n = count[a] * count[b]
    which = np.repeat(np.arange(len(a)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    i, j = first[a[which]] + k // count[b[which]], first[b[which]] + k % count[b[which]]
    ok = (a[which] != b[which]) | (i <= j)
    return i[ok], j[ok]


def linked(key: np.ndarray, fp: np.ndarray, most: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each key. Rows are sorted by key and Gray rank; fp is unsigned."""
    n = len(fp)
    new = np.concatenate([[True], key[1:] != key[:-1]])
    pattern, mask, group = [fp], [np.full(n, ALL)], np.cumsum(new) - 1
    firsts, counts = [], []
    # Levels upwards: runs of FAN nodes of one key, until each key has one node.
    while len(group) and len(group) != group[-1] + 1:
        start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        pos = np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group))))
        first = np.flatnonzero(pos % FAN == 0)
        count = np.diff(np.append(first, len(group)))
        head = pattern[-1][first]
        same = ~(pattern[-1] ^ np.repeat(head, count)) & mask[-1]
        firsts.append(first)
        counts.append(count)
        pattern.append(head)
        mask.append(np.bitwise_and.reduceat(same, first))
        group = group[first]
    label = np.arange(n)
    if not firsts:
        return label[:0], label[:0]
    sizes = np.diff(np.append(np.flatnonzero(new), n)).astype(np.int64)
    work = np.cumsum(sizes * sizes)
    roots = np.arange(len(sizes))
    found_i, found_j = [], []
    for part in np.split(roots, np.searchsorted(work, np.arange(1 << 21, int(work[-1]), 1 << 21))):
        a = b = part
        for level in range(len(firsts) - 1, -1, -1):
            a, b = _pairs(firsts[level], counts[level], a, b)
            near = np.bitwise_count((pattern[level][a] ^ pattern[level][b]) & mask[level][a] & mask[level][b]) <= most
            a, b = a[near], b[near]
        found_i.append(a[a != b])
        found_j.append(b[a != b])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    while True:  # the smallest row number that is reachable
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == label).all():
            break
        label = low
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


_ROWS = "key long, free long, fp long, gray long"


def _deal(rows: DataFrame) -> DataFrame:
    """Each row of (key, free, fp) in the four groups of its blocks; keys of different paths differ by a hash."""
    schema = arrow_schema(_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1 << 15):
            key, free, fp = (np.asarray(piece.column(piece.schema.get_field_index(c))).view(np.uint64) for c in ("key", "free", "fp"))
            gray = (gray_rank(fp) ^ np.uint64(1 << 63)).view(np.int64)
            out = {"key": [], "free": [], "fp": [], "gray": []}
            for mask in np.unique(free):
                own = free == mask
                for k, block in enumerate(blocks(int(mask))):
                    b = np.uint64(block)
                    h = (key[own] + np.uint64(k + 1)) * np.uint64(0x9E3779B97F4A7C15)
                    h = ((h ^ (h >> np.uint64(29))) + (fp[own] & b)) * np.uint64(0xBF58476D1CE4E5B9)
                    out["key"].append((h ^ (h >> np.uint64(32))).view(np.int64))
                    out["free"].append(np.full(own.sum(), mask & ~b).view(np.int64))
                    out["fp"].append(fp[own].view(np.int64))
                    out["gray"].append(gray[own])
            yield pa.RecordBatch.from_pydict({c: np.concatenate(v) for c, v in out.items()}, schema=schema)

    return map_batches(rows, run, _ROWS)


def _within(groups: DataFrame) -> DataFrame:
    """Links within groups of bounded size; a task reads whole groups, one after the other."""
    schema = arrow_schema(EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            i, j = linked(keys, fps)
            x, y = fps[i].view(np.int64), fps[j].view(np.int64)
            return pa.RecordBatch.from_pydict({"a": np.maximum(x, y), "b": np.minimum(x, y)}, schema=schema)

        for batch in batches:
            keys = np.concatenate([keys, np.asarray(batch.column(0))])
            fps = np.concatenate([fps, np.asarray(batch.column(1)).view(np.uint64)])
            cut = np.searchsorted(keys, keys[-1]) if len(keys) else 0
            if cut > 1 << 16:
                yield edges(keys[:cut], fps[:cut])
                keys, fps = keys[cut:], fps[cut:]
        if len(keys):
            yield edges(keys, fps)

    return map_batches(groups.repartition("key").sortWithinPartitions("key", "gray").select("key", "fp"), run, EDGES)


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints at 3 bits or less."""
    rows, edges = distinct.select(F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("free"), "fp"), None
    while True:
        dealt = _deal(rows)
        sizes = dealt.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        sized = keep(dealt.join(sizes, "key").select(*dealt.columns, "n"), "groups")
        own = _within(sized.filter(F.col("n") <= GROUP))
        edges = own if edges is None else edges.unionByName(own)
        rows = sized.filter(F.col("n") > GROUP).select("key", "free", "fp")
        if rows.isEmpty():
            return keep(edges.distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every node that has an edge.

    Alternating large and small stars: every node tells its neighbours the smallest node it knows. Neighbours are
    never gathered in one row; minima are aggregated before the shuffle, and joins on a frequent node can be split.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = keep(large, "stars")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = keep(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        # Hashes by halves, so that the sums stay far from overflow.
        h = F.xxhash64("a", "b")
        now = tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF)))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable) for each row of ``docs``.

    Null and empty texts have the fingerprint zero and are linked like any other. A null id never names a component
    unless all ids of it are null; then component_id is null. Repeated rows stay. An empty table gives no rows. Other
    columns of ``docs`` are not read. Texts are whole.
    """
    prints = keep(fingerprints(docs, words, id_col, text_col), "prints")
    distinct = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(distinct))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = keep(named, "named")
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_print = keep(named.join(low, "root").select("fp", "component_id"), "components")
    out = prints.join(by_print, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
