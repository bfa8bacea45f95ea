"""Best-fit packing by minimum bin slack.

Documents become token pieces of at most ``capacity``; the number of pieces of each length (a table of at most
``capacity`` rows) goes to the driver. There the bins are planned: each bin takes the longest piece left, and a
bitset dynamic programme over the lengths still available finds the fullest sum that fits with it; that combination
is removed, as often as the lengths allow. The plan is a list of combinations with their multiplicities, so its size
depends on ``capacity`` and not on the number of pieces. Pieces get a rank among those of their length, and with it
their place in the plan, on the executors.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.llm.arrow import Columns, arrow_schema, map_batches, map_columns, slices
from lagloom.llm.pieces import encoder
from lagloom.sources.shared import keep

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def fullest(free: int, left: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths (length -> how many are left) with the largest sum of at most ``free``.

    Bit s of ``reach`` says that the sum s is feasible. A length with c pieces enters as 1, 2, 4, ... copies of it
    (binary splitting), so that a bitset shift serves many copies. The path is followed back through the bitsets.
    """
    mask = (1 << (free + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x in left if x <= free), reverse=True):
        most, copies = min(left[length], free // length), 1
        while most > 0:
            take = min(copies, most)
            grown = (reach | reach << (take * length)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            most -= take
            copies *= 2
        if reach >> free:
            break
    at, chosen = reach.bit_length() - 1, Counter()
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += take
            at -= length * take
    return chosen


def plan_bins(lengths: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of bins, [(length, how many in each bin), ...]), ...] that uses up ``lengths`` (length -> count)."""
    left = {n: c for n, c in lengths.items() if c > 0}
    plan = []
    while left:
        seed = max(left)
        left[seed] -= 1
        chosen = fullest(capacity - seed, {n: c for n, c in left.items() if c})
        left[seed] += 1
        chosen[seed] += 1
        bins = min(left[n] // c for n, c in chosen.items())
        plan.append((bins, sorted(chosen.items(), reverse=True)))
        for n, c in chosen.items():
            left[n] -= bins * c
            if not left[n]:
                del left[n]
    return plan


def _pieces(name: str, end_id: int, capacity: int, remembered: int):
    out = arrow_schema(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ranks, end = TaskContext.get().partitionId(), Counter(), np.asarray([end_id], "<u4").tobytes()
        for some in slices(batches, 1024):
            all_ids, at = encoder(name, remembered).encode_array(some.column(1))
            rows = []
            for doc, i, j in zip(some.column(0).to_pylist(), at[:-1], at[1:], strict=True):
                ids = all_ids[i:j].tobytes() + end
                for k, start in enumerate(range(0, len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + capacity)]
                    n = len(own) // 4
                    rows.append((doc, k, start, n, zlib.crc32(own), part, ranks[n]))
                    ranks[n] += 1
            yield pa.RecordBatch.from_pydict(dict(zip(out.names, map(list, zip(*rows, strict=True)), strict=True)), schema=out)

    return run


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by ranges of rank: first rank, first sequence, pieces of this length in a bin, offset of the first."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    used, sequence = Counter(), 0
    for bins, chosen in plan:
        offset = 0
        for n, c in chosen:
            rows.setdefault(n, []).append((used[n], sequence, c, offset))
            used[n] += bins * c
            offset += n * c
        sequence += bins
    return {n: tuple(np.asarray(x, np.int64) for x in zip(*r, strict=True)) for n, r in rows.items()}


def _place(places: dict[int, tuple[np.ndarray, ...]]):
    def place(c: Columns) -> Columns:
        length, rank = np.asarray(c["length"]), np.asarray(c.pop("rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        order = np.argsort(length, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            n = int(length[own[0]])
            first, base, each, at = places[n]
            k = np.searchsorted(first, rank[own], side="right") - 1
            past = rank[own] - first[k]
            sequence[own] = base[k] + past // each[k]
            offset[own] = at[k] + past % each[k] * n
        return c | {"sequence_id": sequence, "offset": offset}

    return lambda: place


def pack(docs: DataFrame, name: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", remembered: int = 400_000) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty: one piece with the end id alone. Only documents of more than ``capacity`` tokens are cut.
    Repeated rows and repeated or null ids are packed like any other row. An empty table gives no rows. Other columns
    of ``docs`` are not read. Which of two pieces of equal length goes into which bin is left to the order of input.
    ``remembered`` bounds the words whose ids a worker remembers: fewer take less memory and more time.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = keep(map_batches(texts, _pieces(name, end_id, capacity, remembered), PIECES), "pieces")
    # How many pieces of a length the tasks before held: one row a task and length, however many documents there are.
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    base = counts.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("base"))
    lengths = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = _places(plan_bins(lengths, capacity))
    ranked = pieces.join(base.hint("merge"), ["part", "length"], "left").select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    # The plan travels in the task's closure: at most a few times capacity rows.
    return map_columns(ranked, _place(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", rows=1 << 16)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "word_bpe_49k.json")
