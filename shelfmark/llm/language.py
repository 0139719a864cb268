"""Language identification with string kernels.

The kernel of two texts is the number of n-grams (all lengths up to ``order``) that both contain, divided by the root
of the product of their own numbers of n-grams: a blended-spectrum presence kernel over lower-cased letters, with every
run of other characters as one gap. Landmark texts give the Nyström approximation; one ridge regression per language is
solved on it; scoring is two matrix products per batch: presence by landmark n-grams, kernel by coefficients.

The model is fitted on a bounded sample: ``landmarks`` texts and about ``max_rows`` labelled texts, spread evenly over
the languages; copies of a text count once in it, so a large group of copies cannot swell it. Letters beyond the ``alphabet`` most common ones of the landmarks count as one letter.

Defined cases: null texts and texts without a letter are ``und`` with score 0; ties go to the first language by name;
with no labelled row everything is ``und``; repeated rows are scored each; an empty table gives no rows; columns named
like an output column are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.llm.common import append, hash_share, texts

UNKNOWN = "und"
GAP = 1  # code point that stands for a run of other characters


@dataclass(frozen=True)
class Settings:
    order: int = 3
    landmarks: int = 96
    max_rows: int = 4096
    alphabet: int = 250
    ridge: float = 1e-3


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def code_points(text: str) -> np.ndarray:
    """Lower-cased letters, runs of other characters as one gap, with a gap at both ends."""
    points = np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(letters()[points], points, GAP)
    return points[np.append(True, (points[1:] != GAP) | (points[:-1] != GAP))]


def grams(points: np.ndarray, order: int) -> np.ndarray:
    """Distinct n-grams as numbers of 21 bits per code point; a single gap is none."""
    points, out = points.astype(np.int64), []
    for n in range(1, order + 1):
        if len(points) >= n:
            code = points[: len(points) - n + 1]
            for i in range(1, n):
                code = (code << 21) | points[i : len(points) - n + 1 + i]
            out.append(np.unique(code))
    found = np.concatenate(out)
    return found[found != GAP]


@dataclass
class Model:
    classes: list[str]
    order: int
    alphabet: np.ndarray  # code points of letters 2, 3, ...; 0 is the gap, 1 any other letter
    column: np.ndarray  # compact n-gram number -> column of the landmarks' n-grams, the last column for none
    landmarks: np.ndarray  # n-grams x landmarks
    norms: np.ndarray
    coefficients: np.ndarray  # landmarks x classes

    @property
    def size(self) -> int:
        return len(self.alphabet) + 2

    def starts(self) -> np.ndarray:
        return np.concatenate(([0], np.cumsum([self.size**n for n in range(1, self.order + 1)])))


class Kernel:
    """Kernel rows of texts against the landmarks."""

    def __init__(self, model: Model):
        self.m, self.starts = model, model.starts()
        self.code = np.where(letters(), 1, 0).astype(np.uint8)
        self.code[model.alphabet] = np.arange(2, model.size)
        self.stamp = np.full(self.starts[-1], -1, np.int32)

    def rows(self, batch: list) -> tuple[np.ndarray, np.ndarray]:
        """Kernel (texts x landmarks), and whether each text has a letter."""
        m = self.m
        presence = np.zeros((len(batch), len(m.landmarks) + 1), np.float32)
        norms, some = np.ones(len(batch)), np.zeros(len(batch), bool)
        for row, text in enumerate(batch):
            if not text:
                continue
            ids = self.code[np.frombuffer(f" {text} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
            ids = ids[np.append(True, (ids[1:] != 0) | (ids[:-1] != 0))].astype(np.int32)
            if not ids.any():
                continue
            some[row], distinct = True, -1  # the single gap is no n-gram
            code = ids
            for n in range(1, m.order + 1):
                if n > 1:
                    code = code[: len(ids) - n + 1] * m.size + ids[n - 1 :]
                at = code + self.starts[n - 1]
                order = np.arange(len(at), dtype=np.int32)
                self.stamp[at] = order
                first = at[self.stamp[at] == order]
                distinct += len(first)
                presence[row, m.column[first]] = 1
            norms[row] = max(1, distinct)
        kernel = presence[:, :-1] @ m.landmarks
        return kernel / np.sqrt(norms[:, None] * m.norms[None, :]), some


def _landmark_grams(order):
    def make():
        kind = pa.list_(pa.int64())
        return lambda piece: [pa.array([grams(code_points(t or ""), order) for t in texts(piece, "text")], kind)]

    return make


def _empty_model(settings: Settings) -> Model:
    none = np.zeros((0, 0), np.float32)
    return Model([], settings.order, np.zeros(0, np.int64), np.zeros(1, np.int32), none, np.zeros(0), none)


def build_landmarks(classes: list[str], sets: list[np.ndarray], settings: Settings) -> Model:
    """A model without coefficients from the n-gram sets of the landmark texts."""
    common = Counter(int(g) for s in sets for g in s[(s < (1 << 21)) & (s != GAP)])
    chosen = sorted(sorted(common, key=lambda c: (-common[c], c))[: settings.alphabet])
    alphabet = np.array(chosen, np.int64)
    code = np.where(letters(), 1, 0).astype(np.int64)
    code[alphabet] = np.arange(2, len(alphabet) + 2)
    model = Model(classes, settings.order, alphabet, np.zeros(0), np.zeros(0), np.zeros(0), np.zeros(0))
    starts, compact = model.starts(), []
    for s in sets:
        parts = []
        for n in range(1, settings.order + 1):
            own = s[(s >= (1 << (21 * (n - 1)))) & ((s < (1 << (21 * n))) if n < 3 else True)]
            number = np.zeros(len(own), np.int64)
            for i in range(n):
                number = number * model.size + code[(own >> (21 * (n - 1 - i))) & ((1 << 21) - 1)]
            parts.append(np.unique(number) + starts[n - 1])
        compact.append(np.concatenate(parts))
    used = np.unique(np.concatenate(compact))
    model.column = np.full(starts[-1], len(used), np.int32)
    model.column[used] = np.arange(len(used))
    model.landmarks = np.zeros((len(used), len(sets)), np.float32)
    for i, s in enumerate(compact):
        model.landmarks[model.column[s], i] = 1
    model.norms = model.landmarks.sum(axis=0, dtype=np.float64)
    return model


def solve(model: Model, kernel: np.ndarray, targets: np.ndarray, ridge: float) -> np.ndarray:
    """Coefficients of one ridge regression per class on the Nyström features."""
    between = (model.landmarks.T @ model.landmarks) / np.sqrt(np.outer(model.norms, model.norms))
    values, vectors = np.linalg.eigh(between.astype(np.float64))
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    gram = features.T @ features + ridge * len(features) * np.eye(features.shape[1])
    return root @ np.linalg.solve(gram, features.T @ targets)


def fit(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    """A model from the rows of ``docs`` with text and language. Rows are chosen by a hash of their text."""
    if settings.order > 3:
        raise ValueError("n-grams have at most three letters")
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    # the number of different texts, estimated so that nothing but one sketch per language is shuffled
    distinct = F.approx_count_distinct(F.xxhash64("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(distinct.alias("n")).collect()}
    if not counts:
        return _empty_model(settings)
    classes = sorted(counts)
    each = settings.max_rows / len(classes)
    share = F.create_map(*[F.lit(x) for c in classes for x in (c, min(1.0, each / counts[c]))])
    sample = rows.withColumn("_share", hash_share("text", 1)).filter(F.col("_share") < share[F.col("lang")])
    # equal texts are chosen together: they are reduced in the tasks before the few left are shuffled
    sample = sample.distinct()
    # landmarks: the first rows of each language in hash order, a few times what is needed, then cut
    wanted = max(1, settings.landmarks // len(classes))
    first = F.create_map(*[F.lit(x) for c in classes for x in (c, min(1.0, 3.0 * (wanted + 3) / counts[c]))])
    gram_field = [T.StructField("_grams", T.ArrayType(T.LongType()))]
    heads = append(sample.filter(F.col("_share") < first[F.col("lang")]), gram_field, _landmark_grams(settings.order), "text", ["lang", "_share"])
    of = {c: [] for c in classes}
    for r in sorted(heads.collect(), key=lambda r: (r["_share"], r["lang"])):
        if len(of[r["lang"]]) < wanted and r["_grams"]:
            of[r["lang"]].append(np.array(r["_grams"], np.int64))
    sets = [s for c in classes for s in of[c]]
    if not sets:
        return _empty_model(settings)
    model = build_landmarks(classes, sets, settings)

    def kernels():
        kernel = Kernel(model)
        return lambda piece: [pa.array(list(kernel.rows(texts(piece, "text"))[0]), pa.list_(pa.float64()))]

    field = [T.StructField("_kernel", T.ArrayType(T.DoubleType()))]
    found = append(sample, field, kernels, "text", ["lang", "_share"]).collect()  # about max_rows rows
    found.sort(key=lambda r: (r["_share"], r["lang"]))
    targets = np.array([[r["lang"] == c for c in classes] for r in found], float)
    model.coefficients = solve(model, np.array([r["_kernel"] for r in found]), targets, settings.ridge)
    return model


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with lang_pred and score (the regression's value for it, cut to 0 .. 1)."""

    def make():
        kernel = Kernel(model) if model.classes else None

        def run(piece):
            batch = texts(piece, text)
            if kernel is None:
                return [pa.array([UNKNOWN] * len(batch), pa.string()), pa.array([0.0] * len(batch), pa.float64())]
            langs, scores = [], []
            for start in range(0, len(batch), 128):
                rows, some = kernel.rows(batch[start : start + 128])
                values = rows @ model.coefficients
                best = values.argmax(axis=1)
                langs += [model.classes[b] if s else UNKNOWN for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                scores.append(np.where(some, np.clip(values.max(axis=1), 0, 1), 0.0))
            return [pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64())]

        return run

    return append(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], make, text, keep)


