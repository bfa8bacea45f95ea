"""Language ID with a blended-spectrum string kernel.

Texts are compared by the character n-grams (n = 1..3, one hashed space) that occur in both, presence only, scaled to
unit length: k(x, z) = |G(x) and G(z)| / sqrt(|G(x)| |G(z)|). Nyström landmarks z_1..z_m give features
K(x, Z) K(Z, Z)^(-1/2); one-versus-rest kernel ridge regression on them gives a weight for each language. As the
kernel is an inner product of presence vectors, landmarks and weights multiply out to one matrix, and a batch of texts
is scored by one matrix product. Fitting uses at most ``sample`` labelled texts; every whole text is scored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lagloom.llm.arrow import Columns, map_columns
from lagloom.llm.decontaminate import small
from lagloom.llm.toxicity import crc_mod

DIMS, GRAMS = 1 << 14, 3
_ODD = np.asarray([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether a character is a letter by Unicode's category; numbers of any form, marks and signs are none."""
    return text is not None and any(map(str.isalpha, text))


def presence(texts: list[str]) -> np.ndarray:
    """A row per text with 1 where a hashed n-gram occurs; what is not a letter counts as a space."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for row, text in zip(out, texts, strict=True):
        # Pieces overlap by GRAMS - 1 characters, so that long texts need little memory and lose no n-gram.
        for at in range(0, len(text), 1 << 18):
            piece = text[at : at + (1 << 18) + GRAMS - 1].lower()
            piece = " " * (at == 0) + piece + " " * (at + (1 << 18) >= len(text))
            c = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
            c = np.where((c < 97) | ((c > 122) & (c < 170)), np.uint32(32), c)
            h = np.zeros(len(c), np.uint32)
            for n in range(min(GRAMS, len(c))):
                h = h[: len(c) - n] * np.uint32(31) + c[n:] * _ODD[n]
                g = h * _ODD[0]
                row[(g ^ (g >> np.uint32(15))) % np.uint32(DIMS)] = 1
    return out


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))


class Classifier:
    def __init__(self, langs: list[str], weights: np.ndarray) -> None:
        self.langs, self.weights = langs, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        own = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        if own:
            f = 6 * (unit(presence([texts[i] for i in own])) @ self.weights)
            p = np.exp(f - f.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, best, row in zip(own, p.argmax(axis=1), p, strict=True):
                names[i], scores[i] = self.langs[best], float(row[best])
        return names, scores


def train(texts: list[str], labels: list[str], landmarks: int = 256, ridge: float = 1e-2) -> Classifier:
    """Landmarks are the first texts of each language in turn."""
    langs = sorted(set(labels))
    if not langs:
        return Classifier([], np.zeros((DIMS, 0), np.float32))
    by = {x: [i for i, y in enumerate(labels) if y == x] for x in langs}
    turns = [by[x][k] for k in range(max(map(len, by.values()))) for x in langs if k < len(by[x])]
    chosen = turns[:landmarks]
    z = unit(presence([texts[i] for i in chosen]))
    k_zz = (z @ z.T).astype(np.float64)
    values, vectors = np.linalg.eigh(k_zz)
    keep = values > 1e-8 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    gram, right = np.zeros((keep.sum(), keep.sum())), np.zeros((keep.sum(), len(langs)))
    for at in range(0, len(texts), 256):
        phi = (unit(presence(texts[at : at + 256])) @ z.T).astype(np.float64) @ root
        y = np.asarray([[1.0 if x == lang else -1.0 for lang in langs] for x in labels[at : at + 256]])
        gram += phi.T @ phi
        right += phi.T @ y
    w = np.linalg.solve(gram + ridge * len(texts) / 100 * np.eye(len(gram)), right)
    return Classifier(langs, (z.T @ (root @ w)).astype(np.float32))


def fit(docs: DataFrame, sample: int = 2_000, most_chars: int = 20_000_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Classifier:
    """A classifier from at most ``sample`` labelled texts, as many of each language as there are or as fit.

    Of each language those of the smallest hashes are taken (from a share by hash of about twice ``sample``), in turn with those of the others, so that a rare language
    is not missing. Rows without a label or without a letter teach nothing. A text that would bring the sample above
    ``most_chars`` characters in all is passed over, which bounds the driver's memory.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))

    def make():
        return lambda c: {"lang": c["lang"], "key": c["key"], "size": [len(t) if has_letter(t) else 0 for t in c["text"]]}

    # Hashes are spread evenly: those under a bound that falls with a language's rows leave about twice ``sample`` of
    # them, whatever their number, before anything is read or ranked.
    many = small(rows.groupBy("lang").agg(F.count("*").alias("n")))
    few = rows.join(many, "lang").filter(F.pmod("key", F.lit(1 << 31)) / (1 << 31) * F.col("n") < 2 * sample)
    # First which texts, by numbers only; then the texts of those rows alone cross to the driver.
    sizes = map_columns(few.select("lang", "key", "text"), make, "lang string, key long, size long").filter("size > 0")
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    ranked = sizes.withColumn("turn", turn).filter(F.col("turn") <= sample)
    keys, held = set(), 0
    for r in ranked.orderBy("turn", "lang").limit(sample).collect():
        if held + r["size"] <= most_chars and (r["key"], r["lang"]) not in keys:
            held += r["size"]
            keys.add((r["key"], r["lang"]))
    if not keys:
        return train([], [])
    wanted = docs.sparkSession.createDataFrame(sorted(keys), "key long, lang string")
    got = rows.join(F.broadcast(wanted), ["key", "lang"]).groupBy("key", "lang").agg(F.min("text").alias("text")).collect()
    got = sorted(got, key=lambda r: (r["key"], r["lang"]))
    return train([r["text"] for r in got], [r["lang"] for r in got])


def identify(docs: DataFrame, model: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) for each row of ``docs``.

    Null texts and texts without a letter are ``und`` with score 0, as is every text if nothing was learned. Null ids
    and repeated rows stay; an empty table gives no rows; other columns of ``docs`` are not read.
    """

    def make():
        def predict(c: Columns) -> Columns:
            names, scores = model.predict(c["text"])
            return {"doc_id": c["doc_id"], "lang_pred": names, "score": scores}

        return predict

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_columns(texts, make, "doc_id long, lang_pred string, score double", rows=128)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(crc_mod("doc_id", 4) != 2))
    return identify(docs, model).select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
