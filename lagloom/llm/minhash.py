"""MinHash near-duplicates with sequential Bayesian verification.

A text's set of word shingles is hashed to 64 bits a shingle; sets that are equal (a digest of 128 bits over the sorted hashes)
are one node, so copies are never compared. A node has 128 min-hashes, of which 32 band keys of 4 are made and the lowest
bytes kept as its signature. Two sets of similarity s share no key with probability (1 - s^4)^32: 5e-8 at 0.8, less above.

Candidates are compared by signature, ``BATCH`` places at a time. After each batch, with m of k places equal, the posterior
probability that the similarity reaches the threshold is known (a uniform prior makes it a Beta's tail); a candidate is
pruned as soon as that falls below the chosen miss probability. Survivors are verified on their whole sets, so nothing below
the threshold is linked.

The members of a key are never all paired. In ``TURNS`` turns they are dealt into groups of about ``WHOLE``, which a task
compares at a high miss probability (``RASH``), and of what survives only a spanning forest of the most similar pairs leaves
the task: a large group of near copies becomes one component at one pair a member. Then, at the miss probability ``MISS`` and
by ``LONG`` places (made for nodes that share a key alone), the members outside a key's largest component are compared with
those of other components, which finds every link that is left. A pair that shares several keys leaves one task only. A key of more than ``WHOLE`` such members is dealt again by a second key: two sets that reach the threshold share about 13 keys,
and a single one with probability 1e-6. What is still larger is cut into blocks, of which a task holds two. No key is
left out, however common.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.arrow import Columns, arrow_schema, map_batches, map_columns, slices, small_batches
from lagloom.llm.collocations import SLOTS, bitmap
from lagloom.llm.simhash import EDGES, components
from lagloom.sources.shared import discard, keep

WORDS, BANDS, EACH, SEED = 4, 32, 4, 42
PLACES = BANDS * EACH
#: The threshold as a fraction.
NUM, DEN = 4, 5
MISS, RASH, BATCH, LONG = 1e-5, 0.05, 32, 768
TURNS, WHOLE = 2, 2048
#: Links of which one task makes stars.
EDGES_EACH = 1 << 17
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_rng = np.random.default_rng(13)
_FLIP, _ODD = (_rng.integers(0, 1 << 64, LONG, np.uint64)[:, None] | np.uint64(odd) for odd in (0, 1))
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
NODES = "node long, size long, keys array<long>, sketch binary"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its runs of ``words`` words; a shorter text is one run, one without words has none."""
    import xxhash

    own = [(t or "").encode("utf-8") for t in texts]
    first = np.cumsum([0, *[len(t) + 1 for t in own]])
    data = np.frombuffer(b"\n".join(own).translate(_LOWER), np.uint8)
    inside = np.concatenate([[False], ~_WHITE[data], [False]])
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    coded = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside[1:-1]])]).dictionary_encode()
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))[np.asarray(coded.indices)]
    at = np.searchsorted(start, first)
    run = h[: max(0, len(h) - words + 1)].copy()
    for k in range(1, words):
        run = run * _STEP + h[k : k + len(run)]
    run = _mixed(run)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= words:
            out.append(np.unique(run[a : b - words + 1]))
        else:
            whole = np.zeros(min(1, b - a), np.uint64)
            for x in h[a:b]:
                whole = whole * _STEP + x + np.uint64(b - a)
            out.append(_mixed(whole))
    return out


def least_hashes(own: np.ndarray, places: int) -> np.ndarray:
    """The least value of a set under each of the first ``places`` hash functions."""
    low, step = np.full(places, _NONE), 1 << 17
    for at in range(0, len(own), step // places):
        x = (own[at : at + step // places] ^ _FLIP[:places]) * _ODD[:places]
        x ^= x >> np.uint64(32)
        x *= _MIX
        low = np.minimum(low, x.min(axis=1))
    return low


def sketch(own: np.ndarray, places: int) -> bytes:
    # A minimum is small: its high bytes tell little, its lowest one is as good as random.
    return least_hashes(own, places).astype(np.uint8).tobytes()


def signature(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The band keys of a set, and the lowest bytes of its min-hashes."""
    low = least_hashes(own, PLACES)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for part in low.reshape(BANDS, EACH).T:
        key = (key ^ part) * _MIX
        key ^= key >> np.uint64(29)
    return key.view(np.int64), low.astype(np.uint8).tobytes()


def digest(own: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(own.tobytes())


def posterior(m: int, k: int, t: float = NUM / DEN) -> float:
    """The probability that the similarity is ``t`` or more when m of k places are equal, under a uniform prior."""
    return sum(comb(k + 1, j) * t**j * (1 - t) ** (k + 1 - j) for j in range(m + 1))


def least_equal(k: int, miss: float = MISS, t: float = NUM / DEN) -> int:
    """With fewer of k places equal than this, a candidate is pruned: the first m at which the posterior reaches ``miss``."""
    total = 0.0
    for m in range(k + 1):
        total += comb(k + 1, m) * t**m * (1 - t) ** (k + 1 - m)
        if total >= miss:
            return m
    return k


#: After so many places, so many must be equal. Lowest bytes are equal by chance too, which prunes less, not more.
_NEED, _RASH = ([(k, least_equal(k, miss)) for k in range(BATCH, most + 1, BATCH)] for miss, most in ((MISS, LONG), (RASH, PLACES)))


def survivors(x: np.ndarray, y: np.ndarray, needed: list[tuple[int, int]] = _NEED) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows whose signatures (n, places) are not pruned, batch after batch, and their equal places."""
    left, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
    for k, need in needed:
        equal = equal + (x[left, k - BATCH : k] == y[left, k - BATCH : k]).sum(axis=1)
        left, equal = left[equal >= need], equal[equal >= need]
    return left, equal


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold."""
    if DEN * min(len(a), len(b)) < NUM * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DEN * both >= NUM * (len(a) + len(b) - both)


def _pairs(x: np.ndarray, y: np.ndarray, size: np.ndarray, root: np.ndarray, sketch: np.ndarray, needed: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of members ``x`` with members ``y``, of different components and sizes that fit, the pairs that survive, and their equal places."""
    found = [(np.zeros(0, np.int64),) * 3]
    for at in range(0, len(x), 32):
        for to in range(0, len(y), 2048):
            i, j = x[at : at + 32], y[to : to + 2048]
            near = root[i][:, None] != root[j]
            near &= DEN * np.minimum(size[i][:, None], size[j]) >= NUM * np.maximum(size[i][:, None], size[j])
            p, q = np.nonzero(near)
            p, q = i[p], j[q]
            for part in range(0, len(p), 1 << 14):
                u, v = p[part : part + (1 << 14)], q[part : part + (1 << 14)]
                left, equal = survivors(sketch[u], sketch[v], needed)
                found.append((u[left], v[left], equal))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def forest(root: np.ndarray, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the pairs (i, j) of a spanning forest of greatest weight over the components ``root``."""
    order, label, taken = np.argsort(-weight, kind="stable"), np.unique(root, return_inverse=True)[1], []
    while True:
        a, b = label[i[order]], label[j[order]]
        order, a, b = (v[a != b] for v in (order, a, b))
        if not len(order):
            return np.array(sorted(taken), np.int64)
        up = list(range(int(label.max()) + 1))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = x = up[up[x]]
            return x

        # The heaviest pair of each component, the heaviest first.
        for k in np.unique(np.unique(np.stack([a, b], axis=1).ravel(), return_index=True)[1] // 2):
            x, y = sorted((top(int(a[k])), top(int(b[k]))))
            if x != y:
                up[y] = x
                taken.append(order[k])
        label = np.array([top(x) for x in range(len(up))])[label]


def spanning(side: np.ndarray, node: np.ndarray, size: np.ndarray, root: np.ndarray, sketch: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a group's likely pairs of different components a spanning forest."""
    every = np.arange(len(node))
    i, j, equal = _pairs(every, every, size, root, sketch, _RASH)
    once = i < j
    i, j, equal = i[once], j[once], equal[once]
    kept = forest(root, i, j, equal)
    a, b = node[i[kept]], node[j[kept]]
    return np.maximum(a, b), np.minimum(a, b)


def compared(side: np.ndarray, node: np.ndarray, size: np.ndarray, root: np.ndarray, sketch: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a group, of different components, that sizes and signatures do not exclude.

    Sides 0 and 1 are two blocks, compared with each other; side 2 is a block compared with itself. ``keys``: the group's
    band, its second band or -1, and for each member the bands of its keys that are dealt singly and of those dealt by two. What
    two members share shows in their signatures, so a pair that meets in several groups leaves the first alone.
    """
    if (side == 2).any():
        # Two members of the largest component have no more to tell each other.
        names, counts = np.unique(root, return_counts=True)
        x, y = np.flatnonzero(root != names[counts.argmax()]), np.arange(len(node))
    else:
        x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    i, j, _ = _pairs(x, y, size, root, sketch, _NEED)
    if len(i):
        band, second = keys[0, :2].tolist()
        bits = np.int64(1) << np.arange(BANDS, dtype=np.int64)
        shared = ((sketch[i, :PLACES] == sketch[j, :PLACES]).reshape(-1, BANDS, EACH).all(axis=2) * bits).sum(axis=1)
        single, double = (shared & keys[i, c] & keys[j, c] for c in (2, 3))
        before = lambda of, k: of & ((1 << k) - 1)
        first = before(single, band) == 0 if second < 0 else (single == 0) & (before(double | 1 << band, second) == 1 << band)
        i, j = i[first], j[first]
    return np.maximum(node[i], node[j]), np.minimum(node[i], node[j])


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose whole sets reach the threshold."""
    schema = arrow_schema(EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 1024):
            x, y = ([np.frombuffer(v.as_buffer(), np.uint64) for v in piece.column(k)] for k in (2, 3))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1)], schema=schema).filter(pa.array([similar(*p) for p in zip(x, y, strict=True)], pa.bool_()))

    of = lambda a, x: sets.select(F.col("node").alias(a), F.col("own").alias(x))
    return keep(map_batches(pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", "x", "y"), run, EDGES), "near")


def _mixed_keys(held: DataFrame) -> DataFrame:
    return held.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key", "n")


_GROUP = ["grp", "side", "node", "size", "root", "keys"]


def _dealt(held: DataFrame, sketches: DataFrame) -> DataFrame:
    """The members of keys with several components, in groups (grp, side, node, size, root, keys, sketch) that a task can hold."""
    members = keep(held.join(_mixed_keys(held), "key"), "members")
    common, bit = F.col("n") > WHOLE, F.expr("if(band < 32, shiftleft(1L, band), 0L)")
    masks = members.groupBy("node").agg(F.bit_or(F.when(~common, bit).otherwise(0)).alias("single"), F.bit_or(F.when(common, bit).otherwise(0)).alias("double"))
    one = members.filter(~common).withColumn("second", F.lit(-1))
    two = members.filter(common).select("node", "size", "root", "key", "band")
    two = two.join(two.select("node", F.col("key").alias("other"), F.col("band").alias("second")), "node").filter("band < second")
    two = two.withColumn("key", F.xxhash64("key", "other")).drop("other")
    two = two.join(_mixed_keys(two), "key")
    columns = ["node", "size", "root", "key", "band", "second", "n"]
    rows = one.select(*columns).unionByName(two.select(*columns)).join(masks, "node")
    blocks = F.ceil(F.col("n") / WHOLE)
    laid = rows.withColumn("i", F.pmod(F.xxhash64("node"), blocks)).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1)
    grp = F.struct("key", "second", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"))
    keys = F.array(*[F.col(c).cast("bigint") for c in ("band", "second", "single", "double")])
    groups = laid.select(grp.alias("grp"), side.alias("side"), "node", "size", "root", keys.alias("keys"))
    return groups.join(sketches, "node").select(*_GROUP, "sketch")


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not the smallest of its component under the edges (a, b)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            member = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[member], nodes[label[member]]
        label = low


def grouped(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for every other node of it.

    Tasks of ``EDGES_EACH`` edges first replace their edges by stars, which leaves little depth; where that is one task, it
    is the answer, else the stars of all are contracted by joins.
    """
    edges = keep(edges, "edges")
    tasks = max(1, -(-edges.count() // EDGES_EACH))
    schema = arrow_schema(EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches]
        a, b = (np.concatenate([np.zeros(0, np.int64), *(h[k] for h in held)]) for k in (0, 1))
        node, root = labelled(a, b)
        for at in range(0, len(node), 1 << 15):
            yield pa.RecordBatch.from_arrays([pa.array(node[at : at + (1 << 15)]), pa.array(root[at : at + (1 << 15)])], schema=schema)

    dealt = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks)
    stars = keep(map_batches(dealt, run, EDGES), "stars")
    discard(edges)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")) if tasks == 1 else components(stars)


def _turned(held: DataFrame, sketches: DataFrame, turn: int) -> DataFrame:
    """The members of keys with several components, once each, in groups of about ``WHOLE``, with the columns of ``_dealt``."""
    members = held.join(_mixed_keys(held), "key")
    block = F.pmod(F.xxhash64("node", "key", F.lit(turn)), F.ceil(F.col("n") / WHOLE))
    groups = members.select(F.struct("key", block.alias("i")).alias("grp"), F.lit(2).alias("side"), "node", "size", "root", F.array().cast("array<bigint>").alias("keys"))
    return groups.join(sketches, "node").select(*_GROUP, "sketch")


def _within(groups: DataFrame, find) -> DataFrame:
    """Pairs (a, b) that ``find`` gives for each group; a task reads one whole group after the other."""
    schema = arrow_schema(EDGES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []

        def pairs(rows: list[tuple]) -> pa.RecordBatch:
            _, side, node, size, root, keys, sketch = zip(*rows, strict=True)
            marks = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(rows), -1)
            a, b = find(np.asarray(side), np.asarray(node, np.int64), np.asarray(size), np.asarray(root, np.int64), marks, np.asarray(keys, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for piece in slices(batches, 1 << 13):
            for row in zip(*piece.to_pydict().values(), strict=True):
                if waiting and row[0] != waiting[0][0]:
                    yield pairs(waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield pairs(waiting)

    return map_batches(groups.repartition("grp").sortWithinPartitions("grp"), run, EDGES)


def linked(nodes: DataFrame, sets_of, more: DataFrame | None = None) -> DataFrame:
    """(node, root) for nodes that are linked. ``nodes``: node, size, keys, sketch; ``sets_of`` gives (node, own, long) for some nodes.

    ``more`` are further pairs (a > b) to verify, found another way.
    """
    rows = nodes.select("node", "size", F.posexplode("keys").alias("band", "key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    held = keep(rows.join(shared, "key").withColumn("root", F.col("node")), "bands")
    some = held.select("node") if more is None else held.select("node").unionByName(more.select(F.col("a").alias("node"))).unionByName(more.select(F.col("b").alias("node")))
    sets, edges = sets_of(some.distinct()), None
    for turn in range(TURNS):
        pairs = _within(_turned(held, nodes.select("node", "sketch"), turn), spanning)
        if more is not None and turn == 0:
            pairs = pairs.unionByName(more.select("a", "b"))
        pairs = keep(pairs.distinct(), "pairs")
        new = _verified(pairs, sets)
        edges = new if edges is None else edges.unionByName(new)
        named = grouped(edges)
        after = keep(held.drop("root").join(named, "node", "left").withColumn("root", F.coalesce("root", "node")), "bands")
        discard(held, pairs)
        held = after
    found = keep(_within(_dealt(held, sets.select("node", F.col("long").alias("sketch"))), compared).distinct(), "likely")
    whole = grouped(edges.unionByName(_verified(found, sets)))
    discard(held, found)
    return whole


def _sets(docs: DataFrame, nodes: DataFrame, words: int):
    """What gives the whole sets of some nodes; ``docs``: text; ``nodes``: node, digest, mark (a hash of one of its texts).

    Texts are read again, and only those that may be asked for are hashed: their marks are looked up in a bitmap of fixed
    size. A task hands on one of several copies.
    """

    def of(some: DataFrame) -> DataFrame:
        asked = keep(nodes.select("node", "digest", "mark").join(some, "node"), "asked")
        bits = docs.sparkSession.sparkContext.broadcast(bitmap(asked.select(F.col("mark").bitwiseAND(F.lit(SLOTS - 1)).alias("slot"))))
        form = "digest binary, own binary, long binary"
        schema = arrow_schema(form)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for piece in slices(batches, 256):
                slot = np.asarray(piece.column(0)).view(np.uint64) & np.uint64(SLOTS - 1)
                asks = (bits.value[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
                new = [t for t, m, ask in zip(piece.column(1).to_pylist(), piece.column(0).to_pylist(), asks, strict=True) if ask and not (m in seen or seen.add(m))]
                found = [s for s in shingle_sets(new, words) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([sketch(s, LONG) for s in found], pa.binary())], schema=schema)

        hashed = map_batches(docs.select(F.xxhash64("text").alias("mark"), "text"), run, form)
        met = hashed.join(asked.select("digest", "node"), "digest").select("node", "own", "long")
        return keep(met.groupBy("node").agg(F.first("own").alias("own"), F.first("long").alias("long")), "sets")

    return of


def sign(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, digest, size, keys, sketch) for each row of ``docs``; ``mark`` is a hash of the text."""

    def make():
        def f(c: Columns) -> Columns:
            sets = shingle_sets(c["text"], words)
            keys, sketches = zip(*map(signature, sets), strict=True)
            return {"id": c["id"], "mark": c["mark"], "digest": [digest(s) for s in sets], "size": [len(s) for s in sets], "keys": keys, "sketch": sketches}

        return f

    text = F.coalesce(F.col(text_col), F.lit(""))
    return map_columns(docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.alias("text")), make, "id long, mark long, digest binary, size long, keys array<long>, sketch binary")


def near_duplicates(docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable), kept for each row of ``docs``.

    A set is that of distinct shingles of ``words`` words, or of the whole sequence where there are fewer. Null, empty and
    blank texts have an empty set and are linked with nothing. Texts that share an id are judged apart; repeated rows
    stay. A null id never names a component unless all ids of it are null; then component_id is null and the rows are
    kept. Very long texts are whole. An empty table gives no rows. Other columns of ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    signed = keep(sign(docs, words, id_col, text_col), "signed")
    first = [F.first(c).alias(c) for c in ("mark", "size", "keys", "sketch")]
    nodes = keep(signed.filter("size > 0").groupBy("digest").agg(*first, F.min("id").alias("low")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    roots = linked(nodes.select("node", "size", "keys", "sketch"), _sets(texts, nodes, words))
    named = keep(nodes.select("digest", "node", "low").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    by_set = keep(named.join(lowest, "root").select("digest", "component_id"), "components")
    rows = signed.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), "digest")
    some = rows.filter("n_shingles > 0").join(by_set, "digest").select("doc_id", "n_shingles", "component_id")
    none = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.unionByName(none).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all ``documents``, four words to a shingle, at a similarity of 0.8."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
