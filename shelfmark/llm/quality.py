"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's features are its lower-cased words and word pairs, hashed into ``2 ** bits`` slots, each occurrence with weight
1 / sqrt(number of occurrences), how large a share of the word pairs occurs 1, 2-3, 4-7, ... times, and a bias. The model is trained on a bounded sample of labelled rows (``max_rows``):
the rows are dealt over ``shards`` tasks, each runs the per-coordinate updates in a fixed order, and the weights are
averaged. Scores are sparse dot products.

Defined cases: null and empty texts have the bias only; a document with several labels has their rounded mean; null
labels and labels without document are not used; with no label at all every score is 0.5; repeated rows are scored
each; an empty table gives no rows; columns named like an output column are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import append, hash_share, texts


@dataclass(frozen=True)
class Settings:
    bits: int = 18
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.01
    l2: float = 0.0005
    epochs: int = 4
    shards: int = 1
    max_rows: int = 16_384


def length(settings: Settings) -> int:
    return (1 << settings.bits) + 1 + REPEATS


def slots(text: str | None, bits: int) -> np.ndarray:
    """Hash slots of all words and word pairs of a text."""
    words = (text or "").lower().encode().split()
    one = np.fromiter(map(crc32, words), np.uint32, len(words)).astype(np.uint64)
    two = one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = np.concatenate((one * np.uint64(0x9E3779B97F4A7C15), two ^ (two >> np.uint64(29))))
    return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - bits)).astype(np.int64)


REPEATS = 8  # classes of how often a word pair occurs, by powers of two


def repeats(found: np.ndarray) -> np.ndarray:
    """Shares of the word pairs of a result of :func:`slots` by how often they occur."""
    pairs = found[(len(found) + 1) // 2 :]
    if not len(pairs):
        return np.zeros(REPEATS)
    times = np.unique(pairs, return_counts=True)[1]
    return np.bincount(np.minimum(np.log2(times).astype(np.int64), REPEATS - 1), weights=times, minlength=REPEATS) / len(pairs)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Leader:
    """State of the per-coordinate updates; behind the hash slots come the bias and the classes of repeats."""

    def __init__(self, settings: Settings):
        self.s = settings
        self.z = np.zeros(length(settings))
        self.n = np.zeros_like(self.z)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        w = (np.sign(z) * s.l1 - z) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) > s.l1, w, 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, y: float):
        w = self.weights(at)
        g = (sigmoid(w @ x) - y) * x
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.s.alpha * w
        self.n[at] = grown


def example(found: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    at, times = np.unique(found, return_counts=True)
    more = np.arange((1 << bits), (1 << bits) + 1 + REPEATS)
    return np.append(at, more), np.concatenate((times / np.sqrt(max(1, len(found))), [1.0], repeats(found)))


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, settings: Settings = Settings(), doc: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Weights learned from the labelled documents for which ``allowed`` (an expression over the id) holds."""
    marked = labels.filter(F.col(label).isNotNull() & allowed).groupBy(F.col(doc).alias("_id"))
    marked = marked.agg(F.round(F.avg(label)).cast("double").alias("_y"))
    n = marked.count()
    # a sample by hash of the id; the limit makes the bound of the broadcast strict
    marked = marked.filter(hash_share("_id", 8) < 0.95 * settings.max_rows / max(1, n)).limit(settings.max_rows)
    rows = docs.select(F.col(doc).alias("_id"), F.col(text).alias("text")).join(F.broadcast(marked), "_id")
    rows = rows.withColumn("_order", F.xxhash64("_id", "text"))

    def hashed():
        kind = pa.list_(pa.int32())
        return lambda piece: [pa.array([slots(t, settings.bits).astype(np.int32) for t in texts(piece, "text")], kind)]

    rows = append(rows, [T.StructField("_slots", T.ArrayType(T.IntegerType()))], hashed, "text", keep=["_y", "_order"])
    rows = rows.withColumn("_shard", F.pmod("_order", F.lit(settings.shards)))

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_order", "_y"])
        rows = [(*example(np.asarray(s, np.int64), settings.bits), y) for s, y in zip(frame["_slots"], frame["_y"], strict=True)]
        leader = Leader(settings)
        for epoch in range(settings.epochs):
            for i in np.random.default_rng(epoch).permutation(len(rows)):
                leader.update(*rows[i])
        return pd.DataFrame({"rows": [len(rows)], "w": [leader.weights().astype(np.float32).tobytes()]})

    trained = rows.groupBy("_shard").applyInPandas(train, "rows long, w binary").collect()  # one row per shard
    if not trained:
        return np.zeros(length(settings), np.float32)
    shares = np.array([r["rows"] for r in trained], float)
    return np.average([np.frombuffer(r["w"], np.float32) for r in sorted(trained, key=lambda r: r["w"])], axis=0, weights=shares[np.argsort([r["w"] for r in trained])]).astype(np.float32)


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score, the probability of label 1, and predicted (1 from 0.5 on)."""
    bits = len(weights).bit_length() - 1
    bias, classes = float(weights[1 << bits]), weights[(1 << bits) + 1 :].astype(np.float64)

    def scorer():
        def run(piece):
            logits = []
            for t in texts(piece, text):
                at = slots(t, bits)
                hashed = weights[at].sum(dtype=np.float64) / np.sqrt(max(1, len(at)))
                logits.append(bias + hashed + repeats(at) @ classes)
            p = sigmoid(np.array(logits, np.float64))
            return [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32())]

        return run

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return append(docs, fields, scorer, text, keep)
