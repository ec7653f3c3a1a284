"""Benchmark decontamination by latent semantic retrieval.

Passages of all documents are TF-IDF vectors over hashed words. A randomised singular value decomposition gives a latent
space: one pass over the passages multiplies a random test matrix by the passages' Gram matrix and counts in how many
passages each word stands; what the tasks add up has a fixed size. The second pass folds every window of every document,
and the benchmark's items, into that space. Windows and items of a high cosine are candidates, and a candidate counts if
the longest common subsequence of words covers the item, and its answer too. Items of a few words are looked up as they are.

The space is in whole numbers, so that a window's vector, its cosine and with them the result are the same however the
documents are dealt out to tasks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, small_batches, stage
from .text import BARE, find_words, mix, ngram_hashes, word_batches

#: Hashed words, columns of the test matrix, leading directions that are left out (they tell languages and styles apart, not
#: passages), words of a passage in the fit, and items searched at a time.
BUCKETS, TEST, LEADING, PASSAGE, BLOCK = 8192, 96, 16, 16, 2000
#: Least cosine of a candidate: low enough for items of which SHARE of the words is left, as a window that fits such an item has
#: a cosine of about SHARE, or less by noise and by words of its own that are heavy.
COSINE = 0.4
#: Least share of an item's words in common, with and without the answer's; and of the answer's.
SHARE, ALONE, ANSWER = 0.6, 0.8, 0.5
#: Items of fewer words have too few for a cosine: their words must stand in a document side by side.
LEAST_WORDS = 8
#: Words that a task adds up at once; rows of STEP words that it searches at once; items compared at once.
FIT_SPAN, SPAN, ITEMS = 1 << 20, 1 << 15, 256
#: Windows begin at every so many words, or a multiple.
STEP = 4
#: Largest whole number in the space: STEP of them still fit in 16 bits.
LARGEST = 8191


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def in_rows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the texts' words in rows of width, every text from a row of its own and filled up with BUCKETS; each text's first row."""
    n = np.diff(first)
    row = np.concatenate([[0], np.cumsum(-(-n // width))])
    out = np.full(row[-1] * width, BUCKETS, np.int64)
    out[np.arange(len(hashes)) + np.repeat(row[:-1] * width - first[:-1], n)] = _buckets(hashes)
    return out.reshape(-1, width), row


@dataclass
class Space:
    """fold: a word's place in the latent space, for each bucket (16-bit whole numbers), and a row of zeros."""

    fold: np.ndarray
    singular: np.ndarray


def _whole(fold: np.ndarray) -> np.ndarray:
    most = float(np.abs(fold).max()) or 1.0
    return np.concatenate([np.rint(fold * (LARGEST / most)), np.zeros((1, fold.shape[1]))]).astype(np.int16)


def _test_matrix() -> tuple[np.ndarray, np.ndarray]:
    """A sparse random test matrix: each bucket's column and sign; the filling has neither."""
    h = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64))
    column, sign = (h % np.uint64(TEST)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)
    return np.append(column, 0), np.append(sign, 0.0)


def gram_times_test(b: np.ndarray, column: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """For passages b (n x PASSAGE buckets): the Gram matrix of their counts times the test matrix, and passage counts of words."""
    total = np.zeros((BUCKETS + 1) * TEST)
    for d in range(PASSAGE):
        other = np.roll(b, d, axis=1).ravel()
        total += np.bincount(b.ravel() * TEST + column[other], weights=sign[other], minlength=len(total))
    ordered = np.sort(b, axis=1)
    first = np.diff(ordered, axis=1, prepend=-1) != 0
    return np.concatenate([total.reshape(-1, TEST), np.bincount(ordered[first], minlength=BUCKETS + 1)[:, None]], axis=1)[:BUCKETS]


def fit(docs: DataFrame) -> Space:
    """The latent space of all passages of all documents, by a randomised decomposition of their TF-IDF matrix A.

    The tasks add up the Gram matrix of word counts times the test matrix, in whole numbers. Weighted by inverse document
    frequencies that is B = A'A W, and A'A is about B (W'B)^-1 B'. A text's last passage may be a short one; null and empty
    texts have none.
    """
    small_batches(docs.sparkSession)
    column, sign = _test_matrix()
    slices, width = 16, BUCKETS // 16

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, passages, held, words = np.zeros((BUCKETS, TEST + 1)), 0, [], 0
        for batch in batches:
            for _, w in word_batches(batch.column(0), BARE):
                held.append(in_rows(w.hashes, w.first, PASSAGE)[0])
                words += held[-1].size
                if words >= FIT_SPAN:
                    total += gram_times_test(np.concatenate(held), column, sign)
                    passages, held, words = passages + words // PASSAGE, [], 0
        if words:
            total += gram_times_test(np.concatenate(held), column, sign)
            passages += words // PASSAGE
        if passages:
            yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([passages] * slices, pa.int64()), pa.array([total[i * width : (i + 1) * width].tobytes() for i in range(slices)], pa.binary())], ["slice", "passages", "part"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(width * (TEST + 1))
        for x in pdf["part"]:
            out += np.frombuffer(x)
        return pd.DataFrame({"slice": pdf["slice"][:1], "passages": [pdf["passages"].sum()], "part": [out.tobytes()]})

    schema = "slice int, passages long, part binary"
    parts = docs.select("text").mapInArrow(partial, schema)
    parts = parts.withColumn("salt", F.spark_partition_id() % 8).groupBy("slice", "salt").applyInPandas(added, schema)
    got = {r["slice"]: r for r in parts.groupBy("slice").applyInPandas(added, schema).collect()}  # 6 MB, whatever the data's size
    test = np.zeros((BUCKETS, TEST))
    test[np.arange(BUCKETS), column[:-1]] = sign[:-1]
    if not got:
        return Space(_whole(test), np.ones(TEST))
    total = np.concatenate([np.frombuffer(got[i]["part"]).reshape(width, TEST + 1) for i in range(slices)])
    idf = np.log(1 + got[0]["passages"] / (1 + total[:, TEST]))
    b, omega = total[:, :TEST] * idf[:, None], test / idf[:, None]
    core = omega.T @ b
    value, vector = np.linalg.eigh((core + core.T) / 2)
    value = np.maximum(value, value.max() * 1e-9)
    v, s, _ = np.linalg.svd(b @ (vector / np.sqrt(value)) @ vector.T, full_matrices=False)
    return Space(_whole((idf[:, None] * v / np.maximum(s, s.max() * 1e-6))[:, LEADING:]), s)


@dataclass
class Item:
    item_id: int
    words: list[int]
    answer: list[int]


def _hashes(text: str) -> list[int]:
    raw = np.frombuffer(text.encode(), np.uint8)
    return find_words(raw, np.array([0, len(raw)]), BARE).hashes.tolist()


def items(rows: list[tuple[int, str | None]]) -> list[Item]:
    """Benchmark items with words; the answer is an item's last sentence, or of a single one the last third."""
    out = []
    for item_id, text in rows:
        words = _hashes(text or "")
        if item_id is None or not words:
            continue
        sentences = [h for h in map(_hashes, re.split(r"[.?!\n]", text)) if h]
        out.append(Item(item_id, words, sentences[-1] if len(sentences) > 1 else words[-max(1, len(words) // 3) :]))
    return out


def common_subsequence(pattern: list[int], text: list[int]) -> int:
    """Length of the longest common subsequence, with a bit for each word of the pattern."""
    where: dict[int, int] = {}
    for i, w in enumerate(pattern):
        where[w] = where.get(w, 0) | 1 << i
    v = full = (1 << len(pattern)) - 1
    for w in text:
        if w in where:
            u = v & where[w]
            v = (v + u) | (v - u)
    return len(pattern) - (v & full).bit_count()


def _window(n: int) -> int:
    """The window for an item of n words: two or three times a power of two, 16 at least, and nearly n."""
    step = 8
    while step * 4 <= n:
        step *= 2
    return max(16, (n + step // 2) // step * step)


class Group:
    """Items that are searched by the same window, some at a time."""

    def __init__(self, window: int, items: list[Item], fold: np.ndarray, known: np.ndarray):
        self.window, self.items = window, items
        self.sums = np.stack([fold[_buckets(np.array(i.words, np.uint64))].sum(0, dtype=np.int64) for i in items])
        self.lengths = np.sqrt((self.sums * self.sums).sum(1).astype(float))
        self.vectors = (self.sums / np.maximum(self.lengths, 1e-9)[:, None]).astype(np.float32)
        own = np.searchsorted(known, np.unique(np.array([h for i in items for h in i.words], np.uint64)))
        #: A known word's column in weights, which says how often an item has it; the last column is of all others.
        self.column = np.full(len(known) + 1, len(own), np.int32)
        self.column[own] = np.arange(len(own))
        self.weights = np.zeros((len(items), len(own) + 1), np.int16)
        for j, i in enumerate(items):
            for h, c in Counter(i.words).items():
                self.weights[j, self.column[np.searchsorted(known, np.uint64(h))]] = min(c, 1 << 14)
        self.least = np.array([SHARE * len(i.words) for i in items])


class Search:
    """One block of items in one task."""

    def __init__(self, space: Space, block: list[Item]):
        self.fold = space.fold
        by: dict[int, list[Item]] = {}
        self.short: dict[int, dict[int, list[Item]]] = {}
        for item in block:
            n = len(item.words)
            if n < LEAST_WORDS:
                self.short.setdefault(n, {}).setdefault(int(ngram_hashes(np.array(item.words, np.uint64), n)[0]), []).append(item)
            else:
                by.setdefault(_window(n), []).append(item)
        self.known = np.unique(np.array([h for group in by.values() for i in group for h in i.words], np.uint64))
        self.groups = [Group(w, group[i : i + ITEMS], self.fold, self.known) for w, group in sorted(by.items()) for i in range(0, len(group), ITEMS)]
        self.longest = max(by, default=0) // STEP

    def exact(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, Item]]:
        """(text, short item) where the item's words stand side by side in one text."""
        for n, wanted in self.short.items():
            found = ngram_hashes(hashes, n)
            at = np.flatnonzero(np.isin(found, np.array(list(wanted), np.uint64)))
            text = np.searchsorted(first, at, "right") - 1
            for i, k in zip(at.tolist(), text.tolist(), strict=True):
                for item in wanted[int(found[i])]:
                    if i + n <= first[k + 1] and hashes[i : i + n].tolist() == item.words:
                        yield k, item

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number among the known, or their number, and where the same known word stood before."""
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        place[self.known[place] != hashes] = len(self.known)
        at = np.flatnonzero(place < len(self.known))
        at = at[np.argsort(place[at], kind="stable")]
        before = np.full(len(place), -1, np.int64)
        same = place[at][1:] == place[at][:-1]
        before[at[1:][same]] = at[:-1][same]
        return place, before

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, Item, float]]:
        """(text, begin, end, item, cosine) of stretches of one text around windows that are close to an item, and that hold words
        enough of it for a common subsequence."""
        b, row = in_rows(hashes, first, STEP)
        text = np.repeat(np.arange(len(first) - 1), np.diff(row))
        rel, last = np.arange(len(b)) - row[text], row[text + 1]
        place, before = self.places(hashes)
        for at in range(0, len(b), SPAN):
            part = b[at : at + SPAN + self.longest]
            rows = self.fold[part[:, 0]]
            for i in range(1, STEP):
                rows += self.fold[part[:, i]]
            sums = np.zeros((len(rows) + 1, rows.shape[1]), np.int32)
            np.cumsum(rows, axis=0, dtype=np.int32, out=sums[1:])
            own = slice(at, min(at + SPAN, len(b)))
            for g in self.groups:
                n, step = g.window // STEP, max(1, g.window // (4 * STEP))
                size = last[own] - row[text[own]]
                begin = np.flatnonzero((rel[own] % step == 0) & ((rel[own] == 0) | (rel[own] < size - n + step)))
                end = np.minimum(begin + n, last[own][begin] - at)
                x = (sums[end] - sums[begin]).astype(np.float32)
                length = np.sqrt(np.einsum("ij,ij->i", x, x))
                j, i = np.nonzero(g.vectors @ x.T >= (COSINE - 1e-3) * np.maximum(length, 1e-9))
                if not len(j):
                    continue
                k = text[at + begin[i]]
                a, z = first[k] + rel[at + begin[i]] * STEP, first[k] + (end[i] + at - row[k]) * STEP
                margin = (z - a) // 2 + STEP
                a, z = np.maximum(first[k], a - margin), np.minimum(first[k + 1], z + margin)
                enough = np.zeros(len(j), bool)
                for s in range(0, len(j), SPAN):
                    t = slice(s, s + SPAN)
                    enough[t] = _present(g, j[t], a[t], z[t], place, before) >= g.least[j[t]]
                for c in np.flatnonzero(enough).tolist():
                    v = sums[end[i[c]]].astype(np.int64) - sums[begin[i[c]]]
                    cosine = float(v @ g.sums[j[c]]) / max(float(np.sqrt(float(v @ v))) * g.lengths[j[c]], 1e-9)
                    if cosine >= COSINE:
                        yield int(k[c]), int(a[c]), int(z[c]), g.items[j[c]], cosine

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(text, item_id) -> (share, answer, cosine) of the best hit, in texts of which each has the words first[i]:first[i + 1]."""
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for k, item in self.exact(hashes, first):
            best[k, item.item_id] = (1.0, 1.0, 1.0)
        for k, begin, end, item, cosine in self.candidates(hashes, first) if self.groups else ():
            near = hashes[begin:end].tolist()
            share = common_subsequence(item.words, near) / len(item.words)
            if share >= SHARE:
                answer = common_subsequence(item.answer, near) / len(item.answer)
                if share >= ALONE or answer >= ANSWER:
                    best[k, item.item_id] = max(best.get((k, item.item_id), (0, 0, 0)), (share, answer, cosine))
        return best


def _present(g: Group, j: np.ndarray, begin: np.ndarray, end: np.ndarray, place: np.ndarray, before: np.ndarray) -> np.ndarray:
    """How many of item j's words stand between begin and end, for each of many stretches."""
    at = begin[:, None] + np.arange(int((end - begin).max()))
    inside = at < end[:, None]
    at = np.minimum(at, len(place) - 1)
    new = inside & (before[at] < begin[:, None])
    return (g.weights[j[:, None], g.column[place[at]]] * new).sum(1, dtype=np.int64)


def contaminated(docs: DataFrame, benchmark: DataFrame, space: Space | None = None) -> DataFrame:
    """doc_id, item_id, cosine, share, answer of each pair of a document and a benchmark item that it holds.

    share and answer are the parts of the item's and its answer's words that a common subsequence covers. An item of fewer than
    LEAST_WORDS words must stand in a document as it is. Null texts, texts without words and items with a null id or no word are
    in no pair; words are what stands between white space or ASCII punctuation, so text without either is one word. Very long
    texts are searched whole, in spans. Repeated rows are reported each, in either table. Other columns, whatever their names,
    are ignored. An empty table gives an empty result.

    The benchmark is searched in blocks of items, each in one pass over the documents; where there are several, each block's
    pairs are written before the next is collected, so the driver and the tasks hold one block.
    """
    space = space or fit(docs)
    spark = docs.sparkSession
    small_batches(spark)
    blocks = max(1, -(-benchmark.count() // BLOCK))
    names, found = ["doc_id", "item_id", "cosine", "share", "answer"], None
    for k in range(blocks):
        rows = need(benchmark, "item_id", "text").filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        shared = spark.sparkContext.broadcast((space, items([tuple(r) for r in rows])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            search = Search(*shared.value)
            for batch in batches:
                ids, rows = batch.column(0).to_pylist(), []
                for i, w in word_batches(batch.column(1), BARE):
                    rows.extend((ids[i + k], item, c, s, a) for (k, item), (s, a, c) in search.hits(w.hashes, w.first).items())
                columns = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], names)

        part = need(docs, "doc_id", "text").mapInArrow(run, "doc_id long, item_id long, cosine double, share double, answer double")
        if blocks > 1:
            part = stage(part, "pairs")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return found
