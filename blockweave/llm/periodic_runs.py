"""Periodic runs of words: seeds on diagonals, extended once each.

A run of smallest period q and at least max(6, 4 q) words agrees with itself, q words on, over at least max(6, 4 q) - q words in
sequence. Lags are taken in classes from 2^j to 2^(j + 1) - 1, and each class has an index of k-grams, k being the least overlap
that its runs guarantee: 5 for a lag of one, 3 * 2^j above. As k is at least the lag, a k-gram within a run stands next q words on
and not before (else two periods would meet over so many words that a smaller one divides q). So the pairs of consecutive
occurrences, at most one for each position and class, hold a seed of every run, and every seed's lag is the smallest period where it is.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_batches, need, utf8

#: A run has at least so many words, and at least so many times its period.
LEAST, TIMES = 6, 4


@dataclass(frozen=True)
class Run:
    start: int
    length: int
    period: int


def _named(names: np.ndarray, at: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, names) of the grams of names[i] and names[i + shift] that occur more than once, for i in at; -1 names none."""
    at = at[at + shift < len(names)]
    at = at[(names[at] >= 0) & (names[at + shift] >= 0)]
    _, name, n = np.unique(names[at] * np.int64(len(names) + 1) + names[at + shift], return_inverse=True, return_counts=True)
    again = n[name] > 1
    return at[again], name[again]


def _seeds(words: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, lags) of consecutive occurrences of k-grams, a class of lags at a time. words: equal numbers are equal words."""
    names = np.where(np.bincount(words, minlength=len(words))[words] > 1, words, -1)
    at, lag, length = np.flatnonzero(names >= 0), 1, 1  # names: of the grams of so many words that occur again
    while len(at):
        q = max(lag, least // times)  # from here on the overlap only grows with the lag
        k = min(max(least, times * q) - q, max(least, times * (q + 1)) - q - 1)
        while 2 * length <= k and len(at):
            at, name = _named(names, at, length)
            names = np.full(len(words), -1, np.int64)
            names[at] = name
            length *= 2
        if len(at):
            i, gram = (at, names[at]) if k == length else _named(names, at, k - length)
            order = np.argsort(gram, kind="stable")
            i, gram = i[order], gram[order]
            far = i[1:] - i[:-1]
            near = (gram[1:] == gram[:-1]) & (far >= lag) & (far < 2 * lag)
            yield i[:-1][near], far[near]
        lag *= 2


def _agreement(words: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """The longest stretch [a, b) around at in which every word is the one lag words on."""
    a, b, step = at, at, 16
    while b + lag < len(words):
        stop = min(b + step, len(words) - lag)
        differ = np.flatnonzero(words[b:stop] != words[b + lag : stop + lag])
        if len(differ):
            b += int(differ[0])
            break
        b, step = stop, 2 * step
    step = 16
    while a > 0:
        begin = max(0, a - step)
        differ = np.flatnonzero(words[begin:a] != words[begin + lag : a + lag])
        if len(differ):
            a = begin + int(differ[-1]) + 1
            break
        a, step = begin, 2 * step
    return a, b


def find_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs, by start, then period. words: numbers from 0 to under their own count; equal numbers are equal words.

    times must be 3 or more, so that the least overlap of a class of lags covers every lag in it.
    """
    found, covered = [], {}  # covered: of each lag how far its diagonal is known
    for at, lag in _seeds(words, least, times):
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        first = np.ones(len(at), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)
        for i, q in zip(at[first].tolist(), lag[first].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            a, b = _agreement(words, i, q)
            covered[q] = b
            if b - a + q >= max(least, times * q):
                found.append(Run(a, b - a + q, q))
    return sorted(found, key=lambda r: (r.start, r.period))


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, list[int]]:
    """(word numbers of all texts, where each begins): words of different texts have different numbers, and a number that occurs once stands between them."""
    out, begins, base = [], [], 0
    for words in texts:
        known: dict[bytes, int] = {}
        begins.append(base)
        out.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)) + base)
        out.append(np.array([base + len(words)]))
        base += len(words) + 1
    return np.concatenate(out) if out else np.empty(0, np.int64), begins


def runs_of(texts: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[Run]]:
    """The runs of each text, found together."""
    words, begins = numbered(texts)
    found: list[list[Run]] = [[] for _ in texts]
    for r in find_runs(words, least, times) if len(words) else ():
        k = int(np.searchsorted(begins, r.start, "right")) - 1
        found[k].append(Run(r.start - begins[k], r.length, r.period))
    return found


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each word stays: one goes that any run holds after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs:
        edge[r.start + r.period] += 1
        edge[r.start + r.length] -= 1
    return np.cumsum(edge)[:n] == 0


def altered(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query's contract: a tenth of the documents go over into a repeated stretch, by their id alone."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapse(docs: DataFrame) -> DataFrame:
    """All columns of docs, with runs of repeated words in text collapsed to their first period; words are then joined by a blank.

    A text without runs stays as it is, and so does a null one.
    """
    names = docs.columns
    at = names.index("text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        split = [t.split() for t in utf8(batch.column(at))]
        text = batch.column(at).to_pylist()
        for i, (words, found) in enumerate(zip(split, runs_of(split), strict=True)):
            if found:
                text[i] = b" ".join(w for w, keep in zip(words, kept_words(len(words), found), strict=True) if keep).decode()
        columns = list(batch.columns)
        columns[at] = pa.array(text, pa.string())
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema.set(at, pa.field("text", pa.string())))

    return map_batches(docs, run, docs.schema)


def runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, start, length, period: a row for each run of each row's text (words, numbered from 0)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = runs_of([t.split() for t in utf8(batch.column(1))], least, times)
        ids = batch.column(0).to_pylist()
        rows = [(ids[i], r.start, r.length, r.period) for i, of in enumerate(found) for r in of]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)] or [pa.array([], pa.int64())] * 4, ["doc_id", "start", "length", "period"])

    return map_batches(need(docs, "doc_id", "text"), run, "doc_id long, start long, length long, period long")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 for each row of docs.

    Of the run with the greatest length / period, of equal ones the first by start and then period, the row has start, length,
    period and the floor of 1000 * length / period; nulls where there is no run. Words are compared as UTF-8 bytes, whole. A null,
    empty or blank text has no words, no run and the digests of nothing. A null doc_id alters nothing. Very long texts are
    searched whole: a class of lags costs a sort of the words whose grams still recur. Rows that repeat are judged each. Other
    columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0).to_pylist()
        split = [altered(i, t.split()) for i, t in zip(ids, utf8(batch.column(1)), strict=True)]
        rows = []
        for i, words, found in zip(ids, split, runs_of(split), strict=True):
            best = None
            for r in found:
                if best is None or r.length * best.period > best.length * r.period:
                    best = r
            digits = (best.start, best.length, best.period, 1000 * best.length // best.period) if best else (None,) * 4
            listed = "".join(f"{r.start},{r.length},{r.period}\n" for r in found)
            left = [w for w, keep in zip(words, kept_words(len(words), found).tolist(), strict=True) if keep] if found else words
            rows.append((i, len(found), *digits, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k < 6 else pa.string()) for k, x in enumerate(columns)], names)

    return map_batches(need(docs, "doc_id", "text"), run, ", ".join(f"{n} {'long' if k < 6 else 'string'}" for k, n in enumerate(names)))
