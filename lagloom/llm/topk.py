"""Exact top-k by inner product with a pivot-distance index.

Vectors x get one more component sqrt(M^2 - |x|^2) (M: the largest length); queries are scaled to length M and get a
zero. Then the largest inner product is the smallest distance: d^2 = 2 M^2 - 2 M q.x / |q|. Each vector is keyed by its
nearest pivot and its distance to it. The index is sorted by that key and cut into annuli (same pivot, adjacent
distances), and annuli into groups. An annulus and a group know the least and the largest distance of their vectors to
every pivot. By the triangle inequality, a vector in them lies at least max over pivots of (low - D, D - high) from a
query at distances D, and at most |q| R above the pivot's own product, R the largest distance to it without the extra
component.

A search reads the index once, however many queries there are. Blocks of near queries go to the groups whose bound
reaches the k-th best score that a sample guarantees, and to no other; each group, in one task, expands its annuli in
the order of their bounds and stops at the first that cannot reach the k-th best score known.

Only pivots and first bounds come from a bounded sample; every vector is indexed, and no result depends on the sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.llm.arrow import arrow_schema, map_batches, slices
from lagloom.llm.decontaminate import small
from lagloom.sources.shared import keep

SCALE, ANNULUS = 1024.0, 512
#: Annuli of a group (one task holds a group: at 64 dimensions 16 MB), and groups whose bounds go to the tasks.
GROUP, CELLS = 64, 1 << 14
KEYED = "pivot int, dist double, vec_id long, vec binary"
#: Annuli (kind 0: ids, vectors, bounds) and blocks of queries (kind 1: ids, vectors, least scores) of a group.
PARTS = "grp long, kind int, ids binary, vecs binary, more binary"
#: Scores, and for each group and block a row without ids: products made, products there are.
FOUND = "query_id long, vec_id long, score long, made long, possible long"


def whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, embedding of the rows that take part: an id, and components that are all finite."""
    v = F.col(vec_col)
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & v.isNotNull() & ok)


def floored(rows: list[list[float]], width: int) -> np.ndarray:
    """floor(1024 x), a row each; shorter vectors end in zeros, which leave inner products alone; longer ones meet zeros beyond."""
    out = np.zeros((len(rows), width))
    for to, row in zip(out, rows, strict=True):
        to[: len(row)] = row[:width]
    return np.floor(SCALE * out)


def distances(x: np.ndarray, tail: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each x (with last component ``tail``) to each pivot (with its own)."""
    p, p_tail = pivots[:, :-1], pivots[:, -1]
    sq = (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T + (tail[:, None] - p_tail) ** 2
    return np.sqrt(np.maximum(sq, 0))


def choose_pivots(sample: np.ndarray, longest2: float, n: int, rounds: int = 4) -> np.ndarray:
    """Means of the sample's parts: first vectors far from each other, then Lloyd's steps."""
    full = np.hstack([sample, np.sqrt(np.maximum(longest2 - (sample * sample).sum(axis=1), 0))[:, None]])
    if not len(full):
        return np.zeros((1, full.shape[1]))
    # Each next pivot is drawn by its squared distance to those there are.
    rng = np.random.default_rng(5)
    chosen = [0]
    far = ((full - full[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(full)) and far.max() > 0:
        chosen.append(int(rng.choice(len(full), p=far / far.sum())))
        far = np.minimum(far, ((full - full[chosen[-1]]) ** 2).sum(axis=1))
    pivots = full[chosen].copy()
    for _ in range(rounds):
        near = distances(full[:, :-1], full[:, -1], pivots).argmin(axis=1)
        for k in range(len(pivots)):
            if (near == k).any():
                pivots[k] = full[near == k].mean(axis=0)
    return pivots


def best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k highest scores of each row number, ties to the smaller id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    first = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    rank = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
    return rows[rank < k], ids[rank < k], scores[rank < k]


class Index:
    """The annuli as a table in the shared folder, and what the tasks must know (arrays of bounded size)."""

    def __init__(self, parts: DataFrame, width: int, longest2: float, pivots: np.ndarray, known: np.ndarray, known_ids: np.ndarray) -> None:
        self.parts, self.width, self.longest2, self.pivots, self.known, self.known_ids = parts, width, longest2, pivots, known, known_ids

    def facts(self) -> dict:
        return {"width": self.width, "longest2": self.longest2, "pivots": self.pivots, "known": self.known, "known_ids": self.known_ids}


def build_index(vectors: DataFrame, pivots: int = 64, sample: int = 4096, id_col: str = "vec_id", vec_col: str = "embedding") -> Index:
    rows = whole(vectors, id_col, vec_col)
    width = int(rows.agg(F.max(F.size("embedding")).alias("width")).first()["width"] or 0)
    term = "floor(1024d * x)"
    square = f"aggregate(embedding, 0d, (s, x) -> s + cast({term} as double) * cast({term} as double))"
    longest2 = float(rows.agg(F.max(F.expr(square)).alias("m")).first()["m"] or 0.0)
    # At most 32 MB of sample, however wide the vectors are.
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(64, min(sample, (1 << 22) // max(1, width)))).collect()
    known = floored([r["embedding"] for r in got], width)
    index = Index(None, width, longest2, choose_pivots(known, longest2, pivots), known, np.asarray([r["vec_id"] for r in got], np.int64))
    index.parts = keep(map_batches(_sorted(rows, index), _annuli(index.facts()), PARTS), "annuli")
    return index


def _sorted(rows: DataFrame, index: Index, scaled: bool = False) -> DataFrame:
    """Rows by nearest pivot and distance; ``scaled`` as queries."""
    facts, schema = index.facts(), arrow_schema(KEYED)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 2048):
            c = piece.to_pydict()
            x = floored(c["embedding"], facts["width"])
            d = query_distances(x, facts) if scaled else distances(x, _tail(x, facts), facts["pivots"])
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_pydict({"pivot": near.astype(np.int32), "dist": d[np.arange(len(x)), near], "vec_id": c["vec_id"], "vec": [v.tobytes() for v in x]}, schema=schema)

    # Ranges over (pivot, distance, id): one frequent pivot, or one frequent vector, is spread over many ranges.
    return map_batches(rows, key, KEYED).repartitionByRange("pivot", "dist", "vec_id").sortWithinPartitions("pivot", "dist", "vec_id")


def _tail(x: np.ndarray, facts: dict) -> np.ndarray:
    return np.sqrt(np.maximum(facts["longest2"] - (x * x).sum(axis=1), 0))


def query_distances(q: np.ndarray, facts: dict) -> np.ndarray:
    """From each query, scaled to the largest length, to each pivot."""
    long = np.sqrt((q * q).sum(axis=1))
    return distances(q * (np.sqrt(facts["longest2"]) / np.maximum(long, 1e-300))[:, None], np.zeros(len(q)), facts["pivots"])


def highest(q: np.ndarray, far: np.ndarray, bounds: np.ndarray, facts: dict) -> np.ndarray:
    """A score that no vector within each of ``bounds`` exceeds, a row for each query.

    A row of bounds: the lows for all pivots, the highs, the number of the own pivot, the radius around that.
    """
    n, m2 = len(facts["pivots"]), facts["longest2"]
    long = np.sqrt((q * q).sum(axis=1))
    out = np.empty((len(q), len(bounds)))
    products = q @ facts["pivots"][:, :-1].T
    for k, b in enumerate(bounds):
        least = np.maximum(np.maximum(b[:n] - far, far - b[n : 2 * n]).max(axis=1), 0)
        by_distance = long * (2 * m2 - least * least) / max(2 * np.sqrt(m2), 1e-300)
        own = int(b[2 * n])
        out[:, k] = np.minimum(by_distance, products[:, own] + long * b[2 * n + 1]) if own >= 0 else by_distance
    # Room for rounding.
    return out + 1e-9 * np.abs(out) + 1e-6 * long[:, None] * np.sqrt(m2) + 1


def _annuli(facts: dict):
    schema, pivots = arrow_schema(PARTS), facts["pivots"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        grp, cut, held = TaskContext.get().partitionId() << 32, 0, []
        width = facts["width"]

        def ring(rows: list[tuple]) -> pa.RecordBatch:
            x = np.frombuffer(b"".join(r[3] for r in rows)).reshape(len(rows), width)
            d = distances(x, _tail(x, facts), pivots)
            own = rows[0][0]
            radius = np.sqrt(((x - pivots[own, :-1]) ** 2).sum(axis=1).max())
            bounds = np.concatenate([d.min(axis=0), d.max(axis=0), [own, radius]])
            return pa.RecordBatch.from_pydict({"grp": [grp], "kind": [0], "ids": [np.asarray([r[2] for r in rows], "<i8").tobytes()], "vecs": [x.tobytes()], "more": [bounds.tobytes()]}, schema=schema)

        for piece in slices(batches, 2048):
            for row in zip(*piece.to_pydict().values(), strict=True):
                new = held and row[0] != held[0][0]
                if new or len(held) == ANNULUS:
                    yield ring(held)
                    held, cut = [], cut + 1
                    if new or cut == GROUP:
                        grp, cut = grp + 1, 0
                held.append(row)
        if held:
            yield ring(held)

    return run


def _cells(index: Index) -> tuple[np.ndarray, list[np.ndarray]]:
    """The bounds of groups, and which groups they are; neighbours share bounds where there are more than ``CELLS``."""
    parts = index.parts.select("grp", "more")
    width = len(index.pivots)
    groups = parts.select("grp").distinct().count()
    span = -(-groups // CELLS)
    schema = "cell long, grps array<long>, bounds binary"
    out = arrow_schema(schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for piece in slices(batches, 4096):
                yield from zip(*piece.to_pydict().values(), strict=True)

        grps: list[int] = []
        bounds = None
        for grp, own in groupby(rows(), key=lambda r: r[0]):
            if len(grps) == span:
                yield pa.RecordBatch.from_pydict({"cell": [grps[0]], "grps": [grps], "bounds": [bounds.tobytes()]}, schema=out)
                grps, bounds = [], None
            for _, more in own:
                b = np.frombuffer(more)
                bounds = b.copy() if bounds is None else _joined(bounds, b, width)
            grps.append(grp)
        if grps:
            yield pa.RecordBatch.from_pydict({"cell": [grps[0]], "grps": [grps], "bounds": [bounds.tobytes()]}, schema=out)

    got = map_batches(parts.repartitionByRange("grp").sortWithinPartitions("grp"), merge, schema).toArrow().to_pydict()
    bounds = np.asarray([np.frombuffer(b) for b in got["bounds"]]).reshape(len(got["bounds"]), 2 * width + 2)
    return bounds, [np.asarray(g, np.int64) for g in got["grps"]]


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    own = a[2 * n] if a[2 * n] == b[2 * n] else -1.0
    return np.concatenate([np.minimum(a[:n], b[:n]), np.maximum(a[n : 2 * n], b[n : 2 * n]), [own, max(a[2 * n + 1], b[2 * n + 1])]])


def _sent(index: Index, k: int, block: int):
    """Blocks of queries for each group that may hold one of their k best."""
    facts, (bounds, grps), schema = index.facts(), _cells(index), arrow_schema(PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, block, 1 << 25):
            c = piece.to_pydict()
            ids = np.asarray(c["vec_id"], np.int64)
            q = np.frombuffer(b"".join(c["vec"])).reshape(len(ids), facts["width"])
            # Sampled vectors are rows like any other: their k-th best score bounds the result from below.
            limit = np.full(len(ids), -np.inf)
            if len(facts["known_ids"]) > k:
                s = np.where(facts["known_ids"][None, :] == ids[:, None], -np.inf, q @ facts["known"].T)
                limit = -np.partition(-s, k - 1, axis=1)[:, k - 1]
                limit -= 1e-9 * np.abs(limit)
            top = highest(q, query_distances(q, facts), bounds, facts)
            for cell in range(len(grps)):
                own = top[:, cell] >= limit
                if own.any():
                    n = len(grps[cell])
                    parts = {"grp": grps[cell], "kind": [1] * n, "ids": [ids[own].astype("<i8").tobytes()] * n, "vecs": [q[own].tobytes()] * n, "more": [limit[own].tobytes()] * n}
                    yield pa.RecordBatch.from_pydict(parts, schema=schema)

    return run


def _products(q: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (q @ x.T).astype(np.int64)
    whole_ = [[sum(int(m) * int(n) for m, n in zip(u, v, strict=True)) for v in x] for u in q]
    return np.asarray([[min(max(v, -(2**63)), 2**63 - 1) for v in row] for row in whole_], np.int64).reshape(len(q), len(x))


def _search(facts: dict, k: int):
    schema = arrow_schema(FOUND)
    width = facts["width"]

    def block(ids: np.ndarray, q: np.ndarray, limit: np.ndarray, annuli: list[tuple]) -> pa.RecordBatch:
        rows, vec, score = (np.zeros(0, np.int64) for _ in range(3))
        limit, made = limit.copy(), 0
        exact = np.sqrt((q * q).sum(axis=1).max() * facts["longest2"]) < 2**52
        top = highest(q, query_distances(q, facts), np.asarray([a[2] for a in annuli]), facts)
        for a in np.argsort(-top.max(axis=0), kind="stable"):
            if top[:, a].max() < limit.min():
                break
            mine = np.flatnonzero(top[:, a] >= limit)
            if not len(mine):
                continue
            own, x, _ = annuli[a]
            made += len(mine) * len(own)
            s = _products(q[mine], x, exact)
            i, j = np.nonzero((s >= limit[mine, None]) & (own[None, :] != ids[mine, None]))
            if not len(i):
                continue
            rows, vec, score = best(np.concatenate([rows, mine[i]]), np.concatenate([vec, own[j]]), np.concatenate([score, s[i, j]]), k)
            full = np.flatnonzero(np.bincount(rows, minlength=len(q)) >= k)
            limit[full] = np.maximum(limit[full], score[np.searchsorted(rows, full, side="right") - 1])
        n, all_of = len(rows), sum(len(a[0]) for a in annuli) * len(q)
        return pa.RecordBatch.from_pydict({"query_id": [*ids[rows].tolist(), None], "vec_id": [*vec.tolist(), None], "score": [*score.tolist(), None], "made": [*[None] * n, made], "possible": [*[None] * n, all_of]}, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grp, annuli = None, []
        for piece in slices(batches, 64, 1 << 25):
            for row in piece.to_pylist():
                if row["grp"] != grp:
                    grp, annuli = row["grp"], []
                ids, x, more = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vecs"]).reshape(-1, width) if width else None, np.frombuffer(row["more"])
                x = x if width else np.zeros((len(ids), 0))
                if row["kind"] == 0:
                    annuli.append((ids, x, more))
                else:
                    yield block(ids, x, more, annuli)

    return run


def search(index: Index, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """The table of what was found, a superset of the k best of each query, with the numbers of products made."""
    blocks = keep(map_batches(_sorted(queries, index, scaled=True), _sent(index, k, block), PARTS), "blocks")
    asked = index.parts.join(small(blocks.select("grp").distinct()), "grp", "left_semi")
    # Each vector is read and shuffled once, each query once for each group that may hold one of its best.
    both = asked.select(*blocks.columns).unionByName(blocks)
    return keep(map_batches(both.repartition("grp").sortWithinPartitions("grp", "kind"), _search(index.facts(), k), FOUND), "found")


def share_made(found: DataFrame, index: Index, queries: DataFrame) -> float:
    """Inner products made, as a share of all queries times all vectors."""
    made = found.agg(F.sum("made").alias("n")).first()["n"] or 0
    n = index.parts.filter("kind = 0").agg(F.sum(F.octet_length("ids") / 8).alias("n")).first()["n"] or 0
    return made / max(1, n * queries.count())


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, wave: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of floored vectors for each query.

    Ties go to the smaller id; with fewer candidates there are fewer rows. Rows of the query's own id are not its
    candidates. Null vectors, vectors with null or non-finite components, and rows without an id take no part; of
    queries that repeat an id the one with the smallest vector counts; shorter vectors count as ending in zeros;
    scores beyond 64 bits become the nearest 64-bit integer. An empty table gives no rows; other columns are not read.

    Queries travel in blocks of at most ``wave``. A task holds one group of annuli and one block at a time.
    """
    index = build_index(vectors, id_col=id_col, vec_col=vec_col)
    asked = keep(whole(queries, id_col, vec_col).groupBy("vec_id").agg(F.min("embedding").alias("embedding")), "queries")
    found = search(index, asked, k, wave).filter("query_id is not null")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
