"""Languages by multinomial naive Bayes over hashed character n-grams; log-probabilities are whole numbers, so sums are exact."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, need, small_batches

#: Longest n-gram, size of the hashed space, what is added to every count, units of a log-probability.
LONGEST, BITS, SMOOTHING, UNIT = 4, 16, 0.5, 1 << 16
#: Characters that are hashed at once, whatever a text's length.
STEP = 1 << 18
#: Log-probabilities in the broadcast matrix at most (4 bytes each): with more languages the hashed space is smaller.
CELLS = 1 << 24
#: A label column with more values than this names no languages.
LANGUAGES = 1 << 14
#: Buckets whose counts travel together.
SEGMENT = 1 << 12


def held_out(doc_id: Column) -> Column:
    """The fold that languages are never learned from; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Of each code point: 2 for letters, 1 for marks, which go on with a word, 0 for all else."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def grams(texts: list[str | None], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of every n-gram of lower-cased words, with the blanks around a word, some texts at a time."""
    lower = [(t or "").lower() for t in texts]
    codes = np.frombuffer((" " + " ".join(lower) + " ").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lower], dtype=np.int64)])
    for begin in range(0, len(codes), STEP):
        part = codes[begin : begin + STEP + LONGEST - 1]
        inside = _classes()[part] > 0
        part = np.where(inside, part, np.uint32(32))
        here = np.searchsorted(starts, begin, "right") - 1
        edges = np.append(starts[here + 1 :][: int(np.searchsorted(starts[here + 1 :], begin + STEP))], begin + STEP) - begin
        text = np.repeat(np.arange(here, here + len(edges)), np.diff(edges, prepend=0))
        h = np.zeros(len(part), np.uint32)
        for n in range(1, LONGEST + 1):
            size = min(STEP, len(part) - n + 1)
            if size <= 0:
                break
            h = h[:size] * np.uint32(0x01000193) + part[n - 1 : n - 1 + size] * np.uint32(0x85EBCA6B)
            if n == 1:
                kept = inside[:size]
            elif n == 2:
                kept = inside[:size] | inside[1 : size + 1]
            else:
                kept = inside[1 : size + 1].copy()
                for k in range(2, n - 1):
                    kept &= inside[k : k + size]
            x = h[kept] + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
            yield text[:size][kept], ((x ^ (x >> np.uint32(12))) * np.uint32(0x297A2D39) >> np.uint32(32 - bits)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]  # sorted
    bits: int
    weights: bytes  # int32, languages x 2^bits
    priors: list[int]

    def matrix(self) -> np.ndarray:
        return np.frombuffer(self.weights, np.int32).reshape(len(self.languages), 1 << self.bits)


def counts(docs: DataFrame, bits: int) -> DataFrame:
    """lang, segment, counts (int64s of SEGMENT buckets), texts: n-grams of all rows of docs (lang, text), summed by Spark."""
    width, small = 1 << bits, min(SEGMENT, 1 << bits)
    schema = "lang string, segment int, counts binary, texts long"

    def of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, c in held.items():
                parts = [c[k : k + small].tobytes() for k in range(0, width, small)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([texts[lang]] * len(parts), pa.int64())], ["lang", "segment", "counts", "texts"])
            held.clear()
            texts.clear()

        for batch in batches:
            langs = batch.column(0).to_pylist()
            known = {lang: k for k, lang in enumerate(dict.fromkeys(langs))}
            if (len(held) + len(known)) * width > CELLS:
                yield from flush()
            for lang in langs:
                texts[lang] = texts.get(lang, 0) + 1
            number = np.array([known[lang] for lang in langs], np.int64)
            for text, bucket in grams(batch.column(1).to_pylist(), bits):
                cell, n = np.unique(number[text] * width + bucket, return_counts=True)
                for lang, k in known.items():
                    a, b = np.searchsorted(cell, [k * width, (k + 1) * width])
                    held.setdefault(lang, np.zeros(width, np.int64))[cell[a:b] - k * width] += n[a:b]
            for lang in known:
                held.setdefault(lang, np.zeros(width, np.int64))
        yield from flush()

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, texts = np.zeros(small, np.int64), 0
        for batch in batches:
            for c in batch.column("counts").to_pylist():
                total += np.frombuffer(c, np.int64)
            texts += sum(batch.column("texts").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([texts], pa.int64())], ["lang", "segment", "counts", "texts"])

    small_batches(docs.sparkSession)
    return need(docs, "lang", "text").mapInArrow(of_part, schema).groupBy("lang", "segment").applyInArrow(add, schema)


def train(docs: DataFrame) -> Model:
    """Counts over all rows of docs (doc_id, text, lang) outside the held-out fold; null ids, texts and languages are left out.

    The driver gets the sums alone: up to CELLS of them, whatever the number of rows.
    """
    rows = need(docs, "doc_id", "text", "lang").filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    languages = rows.agg(F.count_distinct("lang")).first()[0]
    if languages > LANGUAGES:
        raise ValueError(f"{languages} values of lang are no languages")
    bits = min(BITS, max(1, CELLS // max(languages, 1)).bit_length() - 1)
    found = sorted(counts(rows, bits).toLocalIterator(), key=lambda r: (r["lang"], r["segment"])) if languages else []
    langs = sorted({r["lang"] for r in found})
    texts = [next(r["texts"] for r in found if r["lang"] == lang) for lang in langs]
    weights = np.empty((len(langs), 1 << bits), np.int32)
    for k, lang in enumerate(langs):
        n = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in found if r["lang"] == lang]) + SMOOTHING
        weights[k] = np.rint(np.log(n / n.sum()) * UNIT)
    priors = [round(float(np.log(t / sum(texts))) * UNIT) for t in texts]
    return Model(langs, bits, weights.tobytes(), priors)


def totals(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(log-probabilities with every language in units, numbers of n-grams) of texts."""
    w, sums, n = model.matrix(), np.zeros((len(model.languages), len(texts))), np.zeros(len(texts), np.int64)
    for text, bucket in grams(texts, model.bits):
        n += np.bincount(text, minlength=len(texts))[: len(texts)]
        for k in range(len(w)):
            sums[k] += np.bincount(text, w[k][bucket], len(texts))[: len(texts)]
    return sums + np.array(model.priors, float)[:, None], n


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 64 MB at most, by CELLS

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        model, texts = shared.value, batch.column(1).to_pylist()
        if model.languages:
            sums, n = totals(texts, model)
            best = sums.argmax(0)
            # n-grams overlap and hang together, so what they say together counts as that of the root of their number.
            odds = (sums - sums.max(0)) / UNIT / np.sqrt(np.maximum(n, 1))
            score = 1 / np.exp(odds).sum(0)
        letters = [bool(model.languages) and any(c.isalpha() for c in t or "") for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.languages[best[i]] if ok else "und" for i, ok in enumerate(letters)], pa.string()), pa.array([float(score[i]) if ok else 0.0 for i, ok in enumerate(letters)])], ["doc_id", "lang_pred", "score"])

    return map_batches(need(docs, "doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; learn_from (doc_id, text, lang) is docs unless given.

    lang_pred is the language of the greatest probability, of equal ones the first by name; score, 0 to 1, is what the
    probabilities, tempered by the root of the number of n-grams, give it. A text that is null, empty or without a letter is ``und``
    with score 0, and so is every text where no row can be learned from. A null doc_id is not held out and not learned from.
    Very long texts are read whole, in steps; rows that repeat count and are judged each. Other columns, whatever their names,
    are ignored. An empty table gives an empty result.
    """
    found = predict(docs, train(docs if learn_from is None else learn_from))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
