"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>) over the distinct hashed terms of a text. The pair
terms see combinations (an insult with a mention of a group) that additive weights miss. The model is fitted on the
driver on at most ``sample`` labelled rows (a documented bound); every whole text is scored on the executors.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagloom.llm.arrow import Columns, map_batches, map_columns, slices

BUCKETS = 1 << 18
_TERM = re.compile(r"[^\W_]+")


def _bucket(term: str) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % BUCKETS


def _often(buckets: np.ndarray, n: int) -> np.ndarray:
    """The buckets of beginnings that ``n`` distinct words of a text share."""
    return (buckets * 0x9E3779B1 + n * 0x85EBCA77) % BUCKETS


def term_buckets(text: str | None, known: dict[str, tuple[int, ...]]) -> np.ndarray:
    """Sorted buckets of the distinct lower-cased words, and of their beginnings (4 to 7 letters of a longer word).

    Beginnings carry a stem across its endings; they differ from a word that is as long. A beginning of two distinct
    words, and of four, has further buckets: one such word may be chance. ``known`` remembers at most 50,000 words.
    """
    own: list[int] = []
    for word in set(_TERM.findall((text or "").lower())):
        at = known.get(word)
        if at is None:
            at = (_bucket(word), *(_bucket(word[:k] + "-") for k in range(4, min(8, len(word)))))
            if len(known) < 50_000:
                known[word] = at
        own += at
    met, counts = np.unique(np.asarray(own, np.int64), return_counts=True)
    if len(met) == len(own):
        return met
    return np.unique(np.concatenate([met, _often(met[counts >= 2], 2), _often(met[counts >= 4], 4)]))


def hashed_terms(text: str | None, known: dict[str, tuple[int, ...]]) -> set[int]:
    return set(term_buckets(text, known).tolist())


@dataclass
class Machine:
    """Bias, linear weights and factors of the buckets seen in fitting; ``place`` maps a bucket to its row or -1."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray
    place: np.ndarray

    def score(self, terms: list) -> np.ndarray:
        """Of texts as arrays or sets of buckets."""
        out = np.zeros(len(terms))
        for i, t in enumerate(terms):
            rows = self.place[t if isinstance(t, np.ndarray) else np.fromiter(t, np.int64, len(t))]
            rows = rows[rows >= 0]
            v = self.factors[rows]
            s = v.sum(axis=0)
            out[i] = self.bias + self.weights[rows].sum() + 0.5 * ((s * s).sum() - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(terms: list[np.ndarray], labels: np.ndarray, features: int = 2048, rank: int = 8, steps: int = 1500, rate: float = 0.1, l2: float = 1e-4, drop: float = 0.5, seed: int = 7) -> Machine:
    """Fit by AdaGrad on the log loss. Every bucket that occurs takes part, in the linear and in the pair terms.

    The ``features`` buckets of largest chi-square with the label (above 6.63, in 3 texts at least) learn at the full
    rate. The others may still matter in pairs: they learn at a rate that falls with their number in a text, as many
    small steps would otherwise drown the rest; up to 16 a text they too learn at the full rate. In each step a share
    ``drop`` of a text's terms is left out, so that one insult must tell what mostly several do together. ``rank`` 0
    gives an additive model.
    """
    n, y = len(terms), np.asarray(labels, np.float64)
    place = np.full(BUCKETS, -1, np.int64)
    if n == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (n + 1)
        return Machine(float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, rank)), place)
    df, pos = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for t, label in zip(terms, y, strict=True):
        df[t] += 1
        pos[t] += label
    expect = df * y.mean()
    chi = np.where(df >= 3, (pos - expect) ** 2 / np.maximum(expect * (1 - y.mean()) * (1 - df / n), 1e-9), 0)
    seen = np.flatnonzero(df)
    place[seen] = np.arange(len(seen))
    told = np.argsort(-chi, kind="stable")[:features]
    told = told[chi[told] > 6.63]
    others = (df.sum() - df[told].sum()) / n
    rates = np.full(len(seen), rate * min(1.0, 16 / max(others, 1e-9)))
    rates[place[told]] = rate
    # The sample as one array of places, row after row.
    values = np.concatenate([place[t].astype(np.int32) for t in terms])
    sizes = np.asarray([len(t) for t in terms])
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(seed)
    # Factors lie by rank first, so that each is one contiguous array.
    w = np.zeros(len(seen))
    v = np.stack([rng.normal(0, 0.02, len(seen)) * np.sqrt(rates / rate) for _ in range(rank)]).astype(np.float32) if rank else np.zeros((0, len(seen)), np.float32)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    gw, gv, gb = np.full(len(w), 1e-4), np.full(v.shape, 1e-4, np.float32), 1e-2
    at = np.zeros(len(seen), np.int64)
    for _ in range(steps):
        own = rng.integers(0, n, 128)
        cols = np.concatenate([values[starts[i] : starts[i] + sizes[i]] for i in own])
        row = np.repeat(np.arange(len(own)), sizes[own])
        if drop:
            stay = rng.random(len(cols)) >= drop
            cols, row = cols[stay], row[stay]
        mark = np.zeros(len(seen), bool)
        mark[cols] = True
        met = np.flatnonzero(mark)
        at[met] = np.arange(len(met))
        c = at[cols]
        vm = v[:, met]
        s = np.stack([np.bincount(row, x[c], len(own)) for x in vm]) if rank else np.zeros((0, len(own)))
        z = bias + np.bincount(row, (w[met] - 0.5 * (vm * vm).sum(axis=0))[c], len(own)) + 0.5 * (s * s).sum(axis=0)
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]) / len(own)
        lin = np.bincount(c, err[row], len(met))
        dw = lin + l2 * w[met]
        dv = (np.stack([np.bincount(c, x[row], len(met)) for x in err * s]) if rank else vm) - vm * lin + l2 * vm
        gw[met] += dw * dw
        gv[:, met] += dv * dv
        gb += err.sum() ** 2
        w[met] -= rates[met] * dw / np.sqrt(gw[met])
        v[:, met] = vm - rates[met] * dv / np.sqrt(gv[:, met])
        bias -= rate * err.sum() / np.sqrt(gb)
    # Together the terms of a whole text give twice (at drop 0.5) the linear part that training saw, and four times the
    # pairs: scaled so that both grow alike.
    v *= np.sqrt(1 - drop)
    return Machine(bias, w.astype(np.float32), v.T.astype(np.float32), place.astype(np.int32))


def crc_mod(col: str, n: int) -> F.Column:
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % n


def fit(docs: DataFrame, labels: DataFrame, sample: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", label_id: str = "doc_id") -> Machine:
    """A machine from at most ``sample`` labelled documents, those of the smallest hashed ids.

    Labels that are null, or of a null id, teach nothing; of several labels of a document the mean counts, 0.5 as
    toxic; of several texts with one id the smallest counts. Without labels the score is the same for every text.
    """
    known = labels.select(F.col(label_id).cast("long").alias("doc_id"), F.col(label_col).cast("double").alias("y")).dropna()
    chosen = known.groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers: a proven bound for the broadcast.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def make():
        seen: dict[str, tuple[int, ...]] = {}

        def terms(c: Columns) -> Columns:
            return {"doc_id": c["doc_id"], "y": c["y"], "terms": [term_buckets(t, seen) for t in c["text"]]}

        return terms

    rows = map_columns(texts, make, "doc_id long, y int, terms array<int>").groupBy("doc_id", "y").agg(F.min("terms").alias("terms"))
    # Arrays stay in Arrow's buffers: as Python lists the terms of the sample would take ten times the memory.
    got = rows.orderBy("doc_id").toArrow()
    # Views into Arrow's own buffers, a chunk after the other.
    own = [(np.asarray(c.values), np.asarray(c.offsets)) for c in got.column("terms").chunks]
    return train([values[i:j] for values, at in own for i, j in zip(at[:-1], at[1:], strict=True)], np.asarray(got.column("y")))


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= 0.5) for each row of ``docs``.

    Null and empty texts get the score of a text without known terms. Null ids and repeated rows stay; an empty table
    gives no rows; other columns of ``docs`` are not read. Texts are whole.
    """

    def make():
        seen: dict[str, tuple[int, ...]] = {}

        def score(c: Columns) -> Columns:
            p = machine.score([term_buckets(t, seen) for t in c["text"]])
            return {"doc_id": c["doc_id"], "score": p, "predicted": (p >= 0.5).astype(np.int32)}

        return score

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_columns(texts, make, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, machine: Machine, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Null and empty texts stay unless texts without known terms count as toxic. A machine that was given no labels, or
    those of one kind, knows no difference, and rejects nothing.
    """
    if not len(machine.weights):
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, ...]] = {}
        for piece in slices(batches, 256):
            texts = piece.column(piece.schema.get_field_index(text_col)).to_pylist()
            yield piece.filter(pa.array(machine.score([term_buckets(t, seen) for t in texts]) < 0.5))

    return map_batches(docs, run, docs.schema)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    machine = fit(docs, labels.filter(crc_mod("doc_id", 5) != 0))
    scored = score_toxicity(docs, machine)
    return scored.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")
