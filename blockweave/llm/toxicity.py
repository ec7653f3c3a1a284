"""Toxicity by compression distance.

zstandard trains one dictionary on ordinary and one on toxic text. Most of a toxic document is ordinary text, so plain
dictionaries of the two tell little apart. What is trained on is therefore the text of a class reduced to the words and
beginnings of words that lean to it: those that are significantly commoner in its windows than in the other's. Both
dictionaries also hold the same content that zstandard trains on whole ordinary windows, so that ordinary words cost the
same in either; words that lean to toxic text are left out there. A window of a text is compressed with both; the bytes that the toxic dictionary saves are its gain. A
document's gains, with its length, give a probability by a logistic curve, and the cut is calibrated on the same rows.
"""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_batches, need
from .labelled import training_rows

#: Words of a window; bytes of the shared content and of a class's own.
WINDOW, COMMON_BYTES, OWN_BYTES = 12, 8192, 2048
#: Bytes of the segments that training picks, and of the runs that it counts, for the shared content and for a class's own.
COMMON_SEGMENT, OWN_SEGMENT, RUN = 48, 24, 6
#: Matches have 6 bytes at least, so that a word's fragments don't count as the word. A window's literals are too few for
#: zstandard to compress them by themselves, so a match saves nearly its length.
PARAMETERS = {"window_log": 15, "hash_log": 15, "chain_log": 15, "search_log": 5, "min_match": 6, "target_length": 16, "strategy": zstandard.STRATEGY_LAZY2}
#: A beginning leans to a class if it is in so many of its documents at least, commoner in its windows than in the other's by so
#: many standard errors and by this factor; a beginning has so many bytes, from and to.
LEAST_DOCUMENTS, SIGNIFICANCE, FACTOR, STEM = 5, 8.0, 4.0, (4, 15)
#: A longer beginning stands for a shorter one if it is nearly as significant.
NEARLY = 0.8
#: Parts what training must not join. No text holds it: a zero byte is white space here, as is all ASCII punctuation.
BREAK = b"\0"
#: zstandard doesn't index a dictionary's last bytes.
END = b" " * 16
#: Orders of the samples that training is tried in.
ORDERS = 6
#: Gains of fewer bytes are noise.
NOISE = 2
#: The score from which a document counts as toxic, the share of ordinary rows of the sample that may reach it, and the least and
#: greatest probability that the cut may stand for.
THRESHOLD, FALSE_SHARE, CUTS = 0.7, 0.004, (0.2, 0.7)
_BARE = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


@dataclass
class Model:
    dictionaries: tuple[bytes, bytes]
    weights: tuple[float, ...] = (0.0,) * 7
    shift: float = 0.0


def lowered(texts: pa.Array) -> list[bytes]:
    """Texts in lower case as UTF-8 bytes; null is empty."""
    return [x or b"" for x in pc.utf8_lower(texts.cast(pa.large_string())).cast(pa.large_binary()).to_pylist()]


def windows(text: bytes) -> list[bytes]:
    """Windows of a text's words, in order, each word between blanks."""
    words = text.translate(_BARE).split()
    return [b" %b " % b" ".join(words[i : i + WINDOW]) for i in range(0, len(words), WINDOW)]


def _beginnings(word: bytes) -> list[bytes]:
    """From short to long, after a blank."""
    return [b" " + word[:k] for k in range(STEM[0], min(len(word), STEM[1]) + 1)]


def _of_window(window: bytes) -> set[bytes]:
    return {b for w in set(window.split()) for b in _beginnings(w)}


def leaning(texts: list[list[bytes]], labels: list[int], label: int) -> dict[bytes, float]:
    """Beginnings that lean to a class, and by how many standard errors. texts: windows of each."""
    inside, outside, documents, totals = Counter(), Counter(), Counter(), [0, 0]
    for found, y in zip(texts, labels, strict=True):
        totals[y] += len(found)
        if y == label:
            each = [_of_window(w) for w in found]
            documents.update(set().union(*each))
            for x in each:
                inside.update(x)
    known = {b for b, c in documents.items() if c >= LEAST_DOCUMENTS}
    for found, y in zip(texts, labels, strict=True):
        if y != label:
            for w in found:
                outside.update(_of_window(w) & known)
    n, m = max(totals[label], 1), max(totals[1 - label], 1)
    out = {}
    for b in known:
        c, o = inside[b], outside[b]
        share = (c + o) / (n + m)
        z = (c / n - o / m) / math.sqrt(max(share * (1 - share), 1e-9) * (1 / n + 1 / m))
        if z > SIGNIFICANCE and (c + 0.5) / (n + 1) > FACTOR * (o + 0.5) / (m + 1):
            out[b] = z
    return out


def reduced(texts: list[list[bytes]], lean: dict[bytes, float]) -> list[bytes]:
    """The texts' words that begin in a way that leans, cut to that beginning. Of alike beginnings one stands for all: the longest
    that is nearly as significant as any."""
    best = {}
    for short in (b for b in lean if not any(b[:k] in lean for k in range(STEM[0] + 1, len(b)))):
        alike = [b for b in lean if b.startswith(short)]
        most = max(lean[b] for b in alike)
        best[short] = max((b for b in alike if lean[b] >= NEARLY * most), key=lambda b: (len(b), b))
    out = []
    for found in texts:
        kept = []
        for word in (x for w in found for x in w.split()):
            short = next((b for b in _beginnings(word) if b in best), None)
            if short:
                stem = best[short] if (b" " + word).startswith(best[short]) else short
                kept.append(stem + (b" " if len(stem) == len(word) + 1 else b"") + BREAK)
        if kept:
            out.append(b"".join(kept))
    return out


def _trained(samples: list[bytes], size: int, segment: int) -> bytes:
    """A dictionary of zstandard's own training; of too few samples to train on, their end."""
    try:
        return zstandard.train_dictionary(size, [s.ljust(8) for s in samples], k=segment, d=RUN).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Compressors:
    """The two compressors of a model, in one task."""

    def __init__(self, model: Model):
        self.model, self.pair = model, []
        for content in model.dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own = zstandard.ZstdCompressionParameters(**PARAMETERS, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=own)
            self.pair.append(zstandard.ZstdCompressor(dict_data=d, compression_params=own))

    def features(self, text: bytes) -> tuple[float, ...]:
        """One, how many windows gain (up to 6 and by logarithm), the logarithm of all gains and of the words, and gains per word."""
        ordinary, toxic = self.pair
        gains = [g for w in windows(text) if (g := len(ordinary.compress(w)) - len(toxic.compress(w))) >= NOISE]
        n, words = len(gains), len(text.translate(_BARE).split())
        return (1.0, min(n, 6) / 3, math.log1p(n), math.log1p(sum(gains)) / 3, math.log(max(words, 30)) / 4, n * 10 / max(words, 30), sum(gains) * 2 / max(words, 30))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Scores of lower-cased texts."""
        x = np.array([self.features(t) for t in texts], float).reshape(len(texts), len(self.model.weights))
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.model.weights) + self.model.shift, -30, 30)))


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton's method, with a slight ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.1 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def _without(window: bytes, lean: dict[bytes, float]) -> bytes:
    """A window without the words that begin in a way that leans."""
    return b" %b " % b" ".join(w for w in window.split() if not any(b in lean for b in _beginnings(w)))


def _calibrated(model: Model, texts: list[bytes], y: np.ndarray) -> tuple[float, Model]:
    """The model with weights and shift, and the share of toxic rows that it finds."""
    c = Compressors(model)
    x = np.array([c.features(t) for t in texts], float).reshape(len(texts), len(model.weights))
    w = _fitted(x, y)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    ordinary = np.sort(p[y == 0])[::-1]
    cut = float(np.clip(ordinary[int(FALSE_SHARE * len(ordinary))] + 1e-9, *CUTS)) if 0 < y.sum() < len(y) else THRESHOLD
    shift = math.log(THRESHOLD / (1 - THRESHOLD)) - math.log(cut / (1 - cut))
    return float((p[y == 1] >= cut).mean()) if y.any() else 0.0, Model(model.dictionaries, tuple(w.tolist()), shift)


def train(rows: list[tuple[bytes, int]]) -> Model:
    """A model from (text, label) rows, whatever their order; with one class or none, every score is about the share of toxic rows.

    What zstandard's training picks depends on the samples' order, so it is done in several orders, and the model that finds most
    of the sample's toxic rows is kept.
    """
    rows = sorted(rows, key=lambda r: (zlib.crc32(r[0]), r))
    texts, y = lowered(pa.array([t for t, _ in rows], pa.binary())), np.array([y for _, y in rows], float)
    found = [windows(t) for t in texts]
    if not 0 < y.sum() < len(y):
        common = _trained([w for ws in found for w in ws], COMMON_BYTES, COMMON_SEGMENT)
        return _calibrated(Model((common + END,) * 2), texts, y)[1]
    lean = [leaning(found, y.astype(int).tolist(), label) for label in (0, 1)]
    own = [reduced([ws for ws, z in zip(found, y, strict=True) if z == label], lean[label]) for label in (0, 1)]
    plain = [_without(w, lean[1]) for ws, z in zip(found, y, strict=True) if not z for w in ws]
    best = (-1.0, Model((b"", b"")))
    for seed in range(ORDERS):
        order = random.Random(seed)
        for samples in (plain, *own):
            order.shuffle(samples)
        common, parts = _trained(plain, COMMON_BYTES, COMMON_SEGMENT), [_trained(x, OWN_BYTES, OWN_SEGMENT) for x in own]
        width = max(map(len, parts))
        best = max(best, _calibrated(Model(tuple(common + x.rjust(width) + END for x in parts)), texts, y), key=lambda b: b[0])
    return best[1]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of each row's whole text; null and empty texts have no window and score as a short text without gains."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(Compressors(model).scores(lowered(batch.column(1))))], ["doc_id", "score"])

    return map_batches(need(docs, "doc_id", "text"), run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs.

    Learns from a bounded sample of labels (doc_id, toxic) outside the held-out fold; scores see the text only. A null
    doc_id is not held out. Very long texts are scored window by window, all of them; rows that repeat are scored each. Other
    columns, whatever their names, are ignored. An empty table gives an empty result; without labels every score is 0.5.
    """
    model = train(training_rows(docs, labels, "toxic"))
    scored = score(docs, model)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores under the threshold; null and empty texts stay."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = Compressors(model).scores(lowered(batch.column(batch.schema.get_field_index("text"))))
        yield batch.filter(pa.array(p < THRESHOLD))

    return map_batches(docs, run, docs.schema)
