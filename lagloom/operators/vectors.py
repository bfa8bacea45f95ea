"""A persistent vector index: coarse lists, product-quantised residuals, exact re-ranking.

Vectors of length one are dealt to the nearest of some hundred centroids; what is left of each, its residual, is cut into
``PARTS`` parts and each part named by the nearest of 256 code words. A table of Parquet, partitioned by chosen metadata
columns and by list, holds every row with its code. A search reads the codes of the lists nearest to a query and no other
partition, takes the cosines of the vectors that the codes stand for, and computes true distances for the best of those alone.

Centroids and code words are learnt from ``SAMPLE`` vectors at most; every row is indexed. How many lists to read is measured
when the index is built: as many as hold ``RECALL`` of the true ``NEAR`` neighbours of ``ASKED`` vectors. With ``exact``, a search takes the
true cosines in the ``FIRST`` nearest lists, and then in every list that may hold a nearer vector by the triangle inequality: a
list's radius is known, so nothing is missed. A task multiplies tiles of queries and rows and holds the best of each query alone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, DoubleType, IntegerType, StructField, StructType

from lagloom.functions.text import cosine_distance
from lagloom.sources.shared import keep

SAMPLE, PARTS, CODES, ROUNDS = 20_000, 8, 256, 15
MOST_LISTS, RECALL, NEAR, ASKED = 4096, 0.98, 10, 200
#: Rows that a list of a metadata partition holds on average, at least: each is a folder and a file.
LIST_ROWS = 256
#: Queries of one pass, candidates for each wanted neighbour that are re-ranked, candidates that a task holds, lists of an exact search's first pass.
BLOCK, RERANK, HELD, FIRST = 16_384, 20, 1 << 18, 2
#: Queries and rows of one product; candidates beyond the wanted, and what a cosine may be off by, in an exact search.
TILE, ROWS, SPARE, SLACK = 256, 1024, 6, 1e-9
_HITS = "query int, id long, score double"
_MODEL = "kind string, at int, values array<double>"


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are usable vectors of ``dim`` finite numbers, not all zero, and those as unit vectors."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
    with np.errstate(all="ignore"):
        norm = np.sqrt((x * x).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0)
    return rows[ok], x[ok] / norm[ok, None]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row."""
    half = (centres * centres).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[at : at + 4096] @ centres.T - half, axis=1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = ROUNDS) -> np.ndarray:
    """``k`` centres of the rows of ``x`` (fewer if there are fewer rows); a centre without rows moves to a row at random."""
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), len(centres))])
    return centres


def encode(x: np.ndarray, centroids: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, code (one byte a part) and distance to the centroid of each unit vector."""
    own = _nearest(x, centroids)
    rest = x - centroids[own]
    parts = np.array_split(np.arange(x.shape[1]), len(books))
    code = np.stack([_nearest(rest[:, p], b[:, : len(p)]) for p, b in zip(parts, books, strict=True)], axis=1).astype(np.uint8)
    return own, code, np.sqrt((rest * rest).sum(axis=1))


def decode(lists: np.ndarray, code: np.ndarray, centroids: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The vectors that lists and codes stand for."""
    out = centroids[lists]
    for m, p in enumerate(np.array_split(np.arange(centroids.shape[1]), len(books))):
        out[:, p] += books[m, code[:, m], : len(p)]
    return out


def _top(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row of ``scores`` (queries, ids), all that tie with the last included."""
    if scores.shape[1] > k:
        last = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
        i, j = np.nonzero((scores >= last[:, None]) & (scores > -np.inf))
    else:
        i, j = np.nonzero(scores > -np.inf)
    return query[i], ids[j], scores[i, j]


class _Best:
    """The k best rows of each query so far, and the score that a row must reach."""

    def __init__(self, q: np.ndarray, least: np.ndarray, k: int) -> None:
        self.bound, self.k, self.q = least.copy(), k, q
        # Products in single precision choose; what they may be off by is allowed for twice.
        self.short, self.slack = q.astype(np.float32), SLACK + 4 * (q.shape[1] + 2) * 2.0**-24
        self.parts, self.n, self.kept = [], 0, 0

    def add(self, query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((query, ids, scores))
        self.n += len(query)
        if self.n > 2 * max(HELD, self.kept):
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True)) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query)))
        full = place == self.k - 1
        self.bound[query[full]] = np.maximum(self.bound[query[full]], scores[full])
        kept = place < self.k
        self.parts = [(query[kept], ids[kept], scores[kept])]
        self.n = self.kept = int(kept.sum())
        return self.parts[0]


def _products(best: _Best, near: np.ndarray, wanted: np.ndarray | None, ids: np.ndarray, lists: np.ndarray, x: np.ndarray) -> None:
    """Rows into ``best``: each tile of queries meets the rows of the lists that it may want (``near``), or no more than each wants (``wanted``: its lists)."""
    short = x.astype(np.float32)
    for tile in range(len(near)):
        use = np.flatnonzero(near[tile][lists])
        if not len(use):
            continue
        at = slice(tile * TILE, (tile + 1) * TILE)
        s = best.short[at] @ (short if len(use) == len(x) else short[use]).T
        if wanted is not None:
            own = np.zeros((len(s), near.shape[1]), bool)
            np.put_along_axis(own, wanted[at], True, axis=1)
            s[~own[:, lists[use]]] = -np.inf
        bound = best.bound[at]
        new = np.flatnonzero(bound == -np.inf)
        if len(new) and s.shape[1] > best.k:
            bound[new] = np.partition(s[new], s.shape[1] - best.k, axis=1)[:, -best.k]
        i, j = np.nonzero(s >= np.maximum(bound - best.slack, -2)[:, None].astype(np.float32))
        for part in range(0, len(i), 1 << 15):
            a, b = i[part : part + (1 << 15)] + at.start, use[j[part : part + (1 << 15)]]
            # Again, row by row: equal vectors get equal scores wherever they stand in a tile.
            best.add(a, ids[b], (best.q[a] * x[b]).sum(axis=1))


class VectorIndex:
    """An index at ``path``: its model is in memory (a bounded number of centroids), its rows are a table."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        rows = spark.read.schema(_MODEL).parquet(f"{path}/model").collect()
        of = lambda kind: np.array([r["values"] for r in sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["at"])])
        self.centroids, self.probes = of("centroid"), int(of("probes")[0, 0])
        flat = of("words")
        self.books = flat.reshape(PARTS, -1, flat.shape[1]) if len(flat) else flat

    @property
    def rows(self) -> DataFrame:
        """id, the metadata, embedding, list, code, gap of every indexed row."""
        return stored(self.spark, self.path)

    def radius(self, rows: DataFrame | None = None) -> np.ndarray:
        """The largest distance of a row from its list's centroid, of rows added later too: a number for each list."""
        out = np.zeros(len(self.centroids))
        for r in (self.rows if rows is None else rows).groupBy("list").agg(F.max("gap").alias("r")).collect():
            out[r["list"]] = r["r"]
        return out + 1e-9

    def probed(self, queries: np.ndarray, probes: int) -> np.ndarray:
        """(queries, probes): the lists nearest to each query, nearest first."""
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")[:, :probes]

    def _scan(self, rows: DataFrame, q: np.ndarray, near: np.ndarray, wanted: np.ndarray | None, k: int, least: np.ndarray, coded: bool) -> DataFrame:
        """(query, id, score): the k best of each query by true cosines, or by codes; only of lists in ``near`` (tiles, lists) and ``wanted`` (queries, their lists)."""
        shared = self.spark.sparkContext.broadcast((q, near, wanted, least, self.centroids, self.books))
        schema = to_arrow_schema(self.spark.createDataFrame([], _HITS).schema)
        dim = q.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, near, wanted, least, centroids, books = shared.value
            best = _Best(q, least, k)
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    batch = whole.slice(at, ROWS)
                    ids, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                    if coded:
                        x = decode(lists, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1), centroids, books)
                    else:
                        usable, x = _unit(batch.column(2), dim)
                        ids, lists = ids[usable], lists[usable]
                    _products(best, near, wanted, ids, lists, x)
            found = best.cut()
            for at in range(0, len(found[0]), 1 << 15):
                query, ids, scores = (c[at : at + (1 << 15)] for c in found)
                yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())], schema=schema)

        hits = rows.select("id", "list", "code" if coded else "embedding").mapInArrow(run, _HITS)
        # Each task's best first: what crosses the shuffle is bounded by tasks and k.
        best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return hits.withColumn("_k", F.row_number().over(best)).filter(F.col("_k") <= k)

    def _ranked(self, found: DataFrame, rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        """True distances of candidates (query, id), and the k nearest of each query, ties by id."""
        # By a shuffle: a broadcast would take the index, or all candidates, through the driver for each block.
        met = rows.select("id", "embedding").join(found.select("query", "id").distinct().hint("shuffle_hash"), "id").join(F.broadcast(asked), "query")
        near = met.select("query", "id", cosine_distance(F.col("embedding"), F.col("asked")).alias("distance")).distinct()
        w = Window.partitionBy("query").orderBy("distance", "id")
        return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def search(self, queries: DataFrame, k: int = 10, where: Column | None = None, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(query_id, rank, id, distance) of the k nearest rows that meet ``where``, for each of ``queries`` (query_id, embedding).

        Queries that are null, zero, not finite or of another length get no rows; ``probes`` overrides what was measured, or ``FIRST``.
        Queries are dealt evenly into blocks of about ``BLOCK`` (fewer, where a task would hold more than ``HELD`` candidates), however many
        partitions they come in; each block is a pass over the lists it wants, or two, and only its vectors pass through the driver.
        """
        # Listed once for all blocks.
        rows = every = self.rows
        rows = rows if where is None else rows.filter(where)
        blocks = max(1, -(-queries.count() // max(1, min(BLOCK, HELD // (k + SPARE if exact else RERANK * k)))))
        asked = keep(queries.select("query_id", "embedding").withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))), "queries")
        radius = self.radius(every) if exact else None
        out = None
        for block in sorted(r[0] for r in asked.select("block").distinct().toLocalIterator()):
            one = asked.filter(F.col("block") == block).select("query_id", "embedding").toArrow()
            at, q = _unit(one.column("embedding"), self.centroids.shape[1])
            if not len(at):
                continue
            # Neighbours stand together: a tile wants few lists.
            order = np.argsort(_nearest(q, self.centroids), kind="stable")
            one, q = one.take(pa.array(at[order])), q[order]
            table = self.spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(at)), pa.int32()), "query_id": one.column("query_id"), "asked": one.column("embedding")}))
            found = self._block(rows, q, table, k, probes or (min(FIRST, self.probes) if exact else self.probes), radius).join(F.broadcast(table), "query").select("query_id", "rank", "id", "distance")
            out = found if out is None else out.unionByName(found)
        return out if out is not None else self.spark.createDataFrame([], f"query_id {dict(queries.dtypes)['query_id']}, rank int, id long, distance double")

    def _block(self, rows: DataFrame, q: np.ndarray, table: DataFrame, k: int, probes: int, radius: np.ndarray | None) -> DataFrame:
        asked, none = table.select("query", "asked"), np.full(len(q), -np.inf)
        tiles = [q[at : at + TILE] for at in range(0, len(q), TILE)]
        within = lambda near: rows.filter(F.col("list").isin(np.flatnonzero(near.any(axis=0)).tolist()))
        wanted = np.concatenate([self.probed(tile, probes).astype(np.int32) for tile in tiles])
        near = np.zeros((len(tiles), len(self.centroids)), bool)
        for i, to in enumerate(near):
            to[wanted[i * TILE : (i + 1) * TILE]] = True
        if radius is None:
            return self._ranked(self._scan(within(near), q, near, wanted, RERANK * k, none, True), within(near), asked, k)
        # The k-th score so far, or none: lists whose nearest possible vector is farther are done.
        first = self._scan(within(near), q, near, wanted, k, none, False).filter(F.col("_k") == k).select("query", "score").toArrow()
        least = none.copy()
        least[np.asarray(first.column("query"))] = np.asarray(first.column("score")) - SLACK
        for i, (to, tile) in enumerate(zip(near, tiles, strict=True)):
            to[:] = (tile @ self.centroids.T + radius >= least[i * TILE : (i + 1) * TILE, None]).any(axis=0)
        # A few more than wanted: where cosines are equal but for rounding, the distances below tell.
        return self._ranked(self._scan(within(near), q, near, None, k + SPARE, least, False), within(near), asked, k)


def build(rows: DataFrame, path: str, by: list[str] | None = None, lists: int | None = None, seed: int = 5) -> VectorIndex:
    """An index of ``rows`` (id, embedding, metadata) at ``path``, partitioned by ``by`` and list.

    Vectors that are null, zero, not finite or of another length than most are left out, as a cosine is not known for
    them. An empty table gives an index without rows.
    """
    spark, by = rows.sparkSession, by or []
    size = rows.filter(F.size("embedding") > 0).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = size["d"] if size else 1
    sample = rows.filter(F.size("embedding") == dim).select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()
    _, x = _unit(sample.column("embedding"), dim)
    rng = np.random.default_rng(seed)
    if not lists:
        n = size["count"] if size else 1
        apart = max(1, rows.select(*by).distinct().count()) if by else 1
        lists = int(np.clip(min(round(n**0.5), n // (apart * LIST_ROWS)), 1, MOST_LISTS))
    centroids = kmeans(x, lists, rng) if len(x) else np.zeros((1, dim))
    rest = x - centroids[_nearest(x, centroids)]
    parts = np.array_split(np.arange(dim), PARTS)
    words = [kmeans(rest[:, p], CODES, rng) if len(x) else np.zeros((1, len(p))) for p in parts]
    wide = max(len(p) for p in parts)
    books = np.stack([np.pad(w, ((0, 0), (0, wide - w.shape[1]))) for w in words])
    spark.createDataFrame([(_columns(rows).json(),)], "schema string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")
    add(rows, path, by, centroids, books)
    probes = _measured(stored(spark, path), x[:ASKED], centroids)
    model = [("centroid", i, c.tolist()) for i, c in enumerate(centroids)]
    model += [("words", i, w.tolist()) for i, w in enumerate(books.reshape(-1, wide))] + [("probes", 0, [float(probes)])]
    spark.createDataFrame(model, _MODEL).coalesce(1).write.mode("overwrite").parquet(f"{path}/model")
    return VectorIndex(spark, path)


def _columns(rows: DataFrame) -> StructType:
    return StructType([*rows.schema.fields, StructField("list", IntegerType()), StructField("code", BinaryType()), StructField("gap", DoubleType())])


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The index's table; its schema is kept beside it, as a table without rows has no file to tell it."""
    schema = StructType.fromJson(json.loads(spark.read.text(f"{path}/schema").first()[0]))
    return spark.read.schema(schema).parquet(f"{path}/vectors")


def add(rows: DataFrame, path: str, by: list[str], centroids: np.ndarray, books: np.ndarray) -> None:
    """Append ``rows`` to the index's table, coded by the model given."""
    schema = _columns(rows)
    model = rows.sparkSession.sparkContext.broadcast((centroids, books))
    names, dim = rows.columns, centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = to_arrow_schema(schema)
        for batch in batches:
            at, x = _unit(batch.column(names.index("embedding")), dim)
            own, code, gap = encode(x, *model.value)
            kept = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(own, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(gap)], schema=out)

    coded = rows.mapInArrow(run, schema)
    # A list's rows lie together; one above the advised size is split over tasks and files.
    coded.hint("rebalance", *[F.col(c) for c in [*by, "list"]]).write.mode("append").partitionBy(*by, "list").parquet(f"{path}/vectors")


def _measured(rows: DataFrame, asked: np.ndarray, centroids: np.ndarray) -> int:
    """How many of the lists nearest to a vector hold ``RECALL`` of its true neighbours, by brute force for ``asked``."""
    if not len(asked):
        return 1
    dim = asked.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _unit(batch.column(1), dim)
            i, j, s = _top(np.arange(len(asked)), at, asked @ x.T, NEAR)
            own = np.asarray(batch.column(0))[j]
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(own.astype(np.int64)), pa.array(s)], names=["query", "id", "score"])

    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    near = rows.select("list", "embedding").mapInArrow(run, _HITS).withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= NEAR).collect()
    order = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    place = sorted(int(order[r["query"], r["id"]]) + 1 for r in near)
    return place[min(len(place) - 1, int(np.ceil(RECALL * len(place))) - 1)] if place else 1


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(query_id, recall): the share of a query's true neighbours (query_id, id) among those found."""
    hit = true.join(found.select("query_id", "id").withColumn("_hit", F.lit(1)), ["query_id", "id"], "left")
    return hit.groupBy("query_id").agg((F.count("_hit") / F.count("*")).alias("recall"))
