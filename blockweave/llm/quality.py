"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader (FTRL-proximal)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, need
from .labelled import training_rows
from .text import LOWER, Words, mix, ngram_hashes, word_batches

#: Size of the hashed feature space, longest n-gram, passes over the sample.
BITS, LONGEST, EPOCHS = 18, 2, 4
#: FTRL: learning rate, its offset, L1 and L2.
ALPHA, BETA, L1, L2 = 0.2, 1.0, 0.05, 0.5


@dataclass
class Model:
    weights: bytes  # float32, 2^BITS
    bias: float


#: Classes of bytes: letters are a or A, digits 0; the rest stays.
_CLASS = np.array([97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint64)


def grams(w: Words) -> list[np.ndarray]:
    """Hashed features of each text: n-grams of its words, and of the classes of the words' first and last three characters."""
    chars = _CLASS[w.data]
    ends = chars[w.starts]
    for back in (1, 2, 3):
        ends = ends * np.uint64(256) + np.where(w.ends - back > w.starts, chars[np.maximum(w.ends - back, 0)], np.uint64(0))
    ends = mix(ends + np.uint64(1 << 40))
    out = []
    for i, j in w.texts():
        parts = [ngram_hashes(h[i:j], n) + np.uint64(n) for h in (w.hashes, ends) for n in range(1, LONGEST + 1)]
        out.append((np.concatenate(parts) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS)).astype(np.int64))
    return out


def features(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features and their values: counts over the square root of all."""
    index, count = np.unique(found, return_counts=True)
    return index, count / np.sqrt(max(len(found), 1))


def train(rows: list[tuple[bytes, int]]) -> Model:
    """FTRL over the rows, in their order, EPOCHS times. Without rows, every score is 0.5."""
    z, n, w = np.zeros(1 << BITS), np.zeros(1 << BITS), np.zeros(1 << BITS, np.float32)
    bias, grad_sq = 0.0, 1.0
    found = [g for _, w in word_batches(pa.array([t for t, _ in rows], pa.binary()), LOWER) for g in grams(w)]
    seen = [(*features(g), y) for g, (_, y) in zip(found, rows, strict=True)]
    for _ in range(EPOCHS):
        for index, value, y in seen:
            zi, ni = z[index], n[index]
            wi = np.where(np.abs(zi) <= L1, 0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(ni)) / ALPHA + L2))
            p = 1 / (1 + np.exp(-np.clip(8 * float(wi @ value) + bias, -30, 30)))
            g = 8 * (p - y) * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[index] += g - sigma * wi
            n[index] += g * g
            bias -= 0.3 * (p - y) / np.sqrt(grad_sq)
            grad_sq += (p - y) ** 2
    w[:] = np.where(np.abs(z) <= L1, 0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return Model((8 * w).astype(np.float32).tobytes(), float(bias))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row's whole text; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 MB, whatever the data's size

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w = np.frombuffer(shared.value.weights, np.float32)
        raw = []
        for _, words in word_batches(batch.column(1), LOWER):
            for found in grams(words):
                raw.append(float(w[found].sum()) / max(len(found), 1) ** 0.5 + shared.value.bias)
        p = 1 / (1 + np.exp(-np.clip(np.array(raw, float), -30, 30)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    return map_batches(need(docs, "doc_id", "text"), run, "doc_id long, score double")


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Learns from a bounded sample of labels (doc_id, quality) outside the held-out fold; scores see the text only. A null
    doc_id is not held out. Very long texts are scored whole; rows that repeat are scored each. Other columns, whatever their names,
    are ignored. An empty table gives an empty result; without labels every
    score is 0.5.
    """
    scored = score(docs, train(training_rows(docs, labels, "quality")))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
