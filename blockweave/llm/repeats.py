"""Removal of passages that an earlier document has too, with sharded Aho-Corasick automata.

1. Documents are written in packs of a bounded size. Each pack posts the 64-bit hashes of its windows of consecutive words, once
   each, with the least and the greatest document that has it, into one of many buckets. The number of buckets grows with the
   corpus; a window of very many documents is posted once by a pack, not by each of them.
2. A bucket confirms which windows recur, and replies to every pack that has one in a document later than the least that has it.
3. Every pack takes the passages that were confirmed, each from the first place where its documents have it, and compiles them into
   automata, in shards of a bounded size. All documents of the pack are streamed through each shard to locate every occurrence.
   The automata hold seeds: a passage's pieces of SEED words, side by side, so that any window within a passage holds a whole one.
   From a seed that is found the match is extended word by word. A document loses what matches a passage by a window's words or
   more, if the passage is of a lesser document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import need, small_batches, stage
from .text import AS_IS, Words, find_words, mix, ngram_hashes

#: Words of a window; windows of a bucket, about; bytes of a pack's texts, about; words of the passages in an automaton, about.
WINDOW, PER_BUCKET, PACK, SHARD = 13, 2_000_000, 4_000_000, 200_000
#: Bytes of a hash that are posted; the bucket is told from others.
POSTED = 7
_PACK = "pack long, blob binary"
_POST = "bucket int, pack long, docs binary, counts binary, hashes binary, wide binary, greatest binary"
_REPLY = "pack long, docs binary, counts binary, keys binary"


def _packed(docs: DataFrame, size: int) -> DataFrame:
    """(pack, blob): the rows of docs, some at a time, compressed. A pack's number is a hash of its content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as writer:
                for b in held:
                    writer.write_batch(b)
            raw = sink.getvalue().to_pybytes()
            numbers = np.frombuffer(raw + b"\0" * (-len(raw) % 8), np.uint64)
            key = int(mix((numbers * (2 * mix(np.arange(len(numbers), dtype=np.uint64)) + np.uint64(1))).sum(keepdims=True)).astype(np.int64)[0])
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([zstandard.ZstdCompressor(level=6).compress(raw)], pa.binary())], ["pack", "blob"])

        for batch in batches:
            for i in range(0, len(batch), 16):
                held.append(batch.slice(i, 16))
                total += held[-1].nbytes
                if total >= size:
                    yield flush()
                    held, total = [], 0
        if held:
            yield flush()

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, _PACK)


class Pack:
    """The rows of a pack: ids, and words of the texts; rows with a null id have no windows."""

    def __init__(self, blob: bytes, window: int):
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(blob)).read_all()
        self.window, self.ids = window, table["doc_id"].to_pylist()
        column = table["text"].cast(pa.large_binary()).fill_null(b"").combine_chunks()
        column = column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)
        self.texts = column
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        self.words: Words = find_words(data, offsets - offsets[0], AS_IS)

    def starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window of the rows with an id: where it begins, and the row."""
        n = np.maximum(np.diff(self.words.first) - self.window + 1, 0)
        n[[i is None for i in self.ids]] = 0
        row = np.repeat(np.arange(len(n)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.words.first[:-1][row], row

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of the windows, where they begin, and the documents."""
        at, row = self.starts()
        of = np.array([i if i is not None else 0 for i in self.ids], np.int64)[row]
        return ngram_hashes(self.words.hashes, self.window)[at] if len(at) else np.empty(0, np.uint64), at, of


def _runs(new: np.ndarray) -> zip:
    """(begin, end) of the runs that begin where new is true; its first place always does."""
    edges = np.flatnonzero(new) if len(new) else np.empty(0, np.int64)
    return zip(edges.tolist(), np.append(edges[1:], len(new)).tolist() if len(new) else [], strict=True)


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before; true for the first."""
    return np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """By the uppermost bits, which tell what isn't posted: from 256 buckets on, a bucket and a posted hash are all 64 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _short(hashes: np.ndarray) -> bytes:
    """The lower POSTED bytes of each hash."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :POSTED]).tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // POSTED, 8), np.uint8)
    out[:, :POSTED] = np.frombuffer(raw, np.uint8).reshape(-1, POSTED)
    return out.view("<u8").ravel().astype(np.uint64)


def _posts(packs: DataFrame, window: int, buckets: int) -> DataFrame:
    """A row for each pack and bucket: documents, how many hashes each is the least document of, the hashes, and for those that
    several of the pack's documents have their numbers and the greatest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                h, _, of = Pack(blob, window).windows()
                order = np.lexsort((of, h))
                h, of = h[order], of[order]
                edges = np.flatnonzero(_changes(h))
                least, most, h = of[edges], of[np.append(edges[1:], len(of)) - 1] if len(h) else of, h[edges]
                b = _bucket(h, buckets)
                order = np.lexsort((least, b))
                h, least, most, b = h[order], least[order], most[order], b[order]
                rows = []
                for i, j in _runs(_changes(b)):
                    new = np.flatnonzero(_changes(least[i:j]))
                    wide = np.flatnonzero(most[i:j] != least[i:j])
                    rows.append((int(b[i]), key, least[i:j][new].tobytes(), np.diff(new, append=j - i).astype(np.int32).tobytes(), _short(h[i:j]), wide.astype(np.int32).tobytes(), most[i:j][wide].tobytes()))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                types = [pa.int32(), pa.int64()] + [pa.binary()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["bucket", "pack", "docs", "counts", "hashes", "wide", "greatest"])

    return packs.mapInArrow(run, _POST)


def _replies(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: the keys that recur, for each pack with a later document, by least documents."""
    hashes = [_long(x) for x in pdf["hashes"]]
    least = np.concatenate([np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, np.int32)) for d, c in zip(pdf["docs"], pdf["counts"], strict=True)])
    most, begin = least.copy(), np.cumsum([0, *map(len, hashes)])
    for at, wide, greatest in zip(begin[:-1], pdf["wide"], pdf["greatest"], strict=True):
        most[at + np.frombuffer(wide, np.int32)] = np.frombuffer(greatest, np.int64)
    pack, h = np.repeat(np.arange(len(hashes)), np.diff(begin)), np.concatenate(hashes)
    order = np.lexsort((least, h))
    h, least, most, pack = h[order], least[order], most[order], pack[order]
    first = _changes(h)
    least = least[np.flatnonzero(first)[np.cumsum(first) - 1]]
    hit = np.flatnonzero(most > least)
    hit = hit[np.lexsort((least[hit], pack[hit]))]
    h, least, pack = h[hit], least[hit], pack[hit]
    rows = []
    for i, j in _runs(_changes(pack)):
        new = np.flatnonzero(_changes(least[i:j]))
        rows.append((pdf["pack"].iloc[pack[i]], least[i:j][new].tobytes(), np.diff(new, append=j - i).astype(np.int32).tobytes(), _short(h[i:j])))
    return pd.DataFrame(rows, columns=["pack", "docs", "counts", "keys"]).astype({"pack": "int64"})


def _passages(pack: Pack, replied: pa.Table) -> list[tuple[int, int, int]]:
    """(begin, end, least document) of the passages that were confirmed, each where the pack has it first."""
    read = lambda c, t: np.frombuffer(b"".join(replied[c].to_pylist()), t)
    keys, least = _long(b"".join(replied["keys"].to_pylist())), np.repeat(read("docs", np.int64), read("counts", np.int32))
    order = np.argsort(keys)
    keys, least = keys[order], least[order]
    h, at, _ = pack.windows()
    if not len(keys) or not len(h):
        return []
    h = _long(_short(h))
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    hit = np.flatnonzero(keys[place] == h)
    hit = np.sort(hit[np.unique(place[hit], return_index=True)[1]])
    of = least[place[hit]]
    return [(int(at[hit[i]]), int(at[hit[j - 1]]) + pack.window, int(of[i])) for i, j in _runs(_changes(at[hit] - np.arange(len(hit))) | _changes(of))]


def _string(numbers: np.ndarray) -> str:
    """A code point for each number under a million; surrogates are left out."""
    return np.where(numbers < 0xD000, numbers + 0x100, numbers + 0x10000).astype("<u4").tobytes().decode("utf-32-le")


class Shard:
    """An automaton over the seeds of some passages. Word 0 is any that no passage has.

    A state of the automaton looks for the next letter among all its own, one after the other. So there a word is three letters, of
    three small alphabets, and of a document only the runs of words that passages have are looked at, where they fill a seed.
    """

    def __init__(self, hashes: np.ndarray, passages: list[tuple[int, int, int]], window: int):
        self.window, self.seed = window, (window + 1) // 2
        self.known = np.unique(np.concatenate([hashes[a:z] for a, z, _ in passages]))
        self.base = int(np.ceil((len(self.known) + 1) ** (1 / 3))) + 1
        words = [self.numbers(hashes[a:z]) for a, z, _ in passages]
        self.texts = [_string(w) for w in words]
        self.least = [d for *_, d in passages]
        self.places: list[list[tuple[int, int]]] = []
        numbers: dict[str, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, word in enumerate(words):
            letters = self.letters(word)
            for k in range(0, len(word) - self.seed + 1, self.seed):
                key = letters[3 * k : 3 * (k + self.seed)]
                n = numbers.setdefault(key, len(numbers))
                if n == len(self.places):
                    self.places.append([])
                    self.automaton.add_word(key, n)
                self.places[n].append((p, k))
        self.automaton.make_automaton()

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[place] == hashes, place + 1, 0)

    def letters(self, numbers: np.ndarray) -> str:
        b = self.base
        return np.stack([numbers // (b * b) + 0x100, numbers // b % b + 0x1000, numbers % b + 0x2000], 1).astype("<u4").tobytes().decode("utf-32-le")

    def found(self, letters: str, runs: list[tuple[int, int]], begin: int) -> Iterator[tuple[int, int]]:
        """(end, seed) of each seed in runs of a document's words; the document begins at a word of the letters."""
        for i, j in runs:
            for last, n in self.automaton.iter(letters[3 * i : 3 * j]):
                yield i - begin + (last + 1) // 3, n

    def matches(self, text: str, letters: str, runs: list[tuple[int, int]], begin: int, doc_id: int) -> Iterator[tuple[int, int]]:
        """(begin, end) of what a document's words have in common with passages of lesser documents, a window's words at least."""
        done: dict[tuple[int, int], int] = {}
        a, z, seed, reach = 0, 0, self.seed, self.window - self.seed
        for end, n in self.found(letters, runs, begin):
            if a <= max(0, end - seed - reach) and z >= min(len(text), end + reach):
                continue  # any window with this seed lies in what is matched already
            for p, k in self.places[n]:
                line = p, end - k
                if self.least[p] >= doc_id or done.get(line, 0) >= end:
                    continue
                passage = self.texts[p]
                after = _common(text, end, passage, k + seed, 1)
                before = _common(text, end - seed - 1, passage, k - 1, -1)
                done[line] = end + after
                if before + seed + after >= self.window:
                    i, j = end - seed - before, end + after
                    a, z = (min(a, i), max(z, j)) if i <= z else (i, j)
                    yield i, j


def _common(x: str, i: int, y: str, j: int, way: int) -> int:
    """How many characters of x from i on and of y from j on are the same, forwards or backwards."""
    most = min(len(x) - i, len(y) - j) if way > 0 else min(i, j) + 1
    n, step = 0, 16
    while n < most:
        step = min(step, most - n)
        same = x[i + n : i + n + step] == y[j + n : j + n + step] if way > 0 else x[i - n - step + 1 : i - n + 1] == y[j - n - step + 1 : j - n + 1]
        if same:
            n, step = n + step, step * 2
        elif step == 1:
            break
        else:
            most, step = n + step - 1 if step > 1 else most, max(1, step // 2)
    return n


def _removed(pack: Pack, passages: list[tuple[int, int, int]], size: int) -> np.ndarray:
    """Which of the pack's words go: those that the shards' automata locate, for documents greater than the passage's."""
    hashes, edge = pack.words.hashes, np.zeros(len(pack.words.hashes) + 1, np.int32)
    pieces = [(i, min(i + size, z), d) for a, z, d in passages for i in range(a, max(a + 1, z - pack.window + 1), size - pack.window + 1)]  # long ones are cut, with all but a word of a window in common
    held, total = [], 0
    for k, piece in enumerate(pieces):
        held.append(piece)
        total += piece[1] - piece[0]
        if total < size and k < len(pieces) - 1:
            continue
        shard = Shard(hashes, held, pack.window)
        numbers = shard.numbers(hashes)
        new = _changes(numbers == 0)
        new[pack.words.first[:-1][pack.words.first[:-1] < len(new)]] = True
        runs = [(i, j) for i, j in _runs(new) if numbers[i] and j - i >= shard.seed]  # within one document
        text, letters, at = _string(numbers), shard.letters(numbers), 0
        for doc_id, (a, z) in zip(pack.ids, pack.words.texts(), strict=True):
            own = at
            while at < len(runs) and runs[at][0] < z:
                at += 1
            if doc_id is not None and at > own:
                for i, j in shard.matches(text[a:z], letters, runs[own:at], a, doc_id):
                    edge[a + i] += 1
                    edge[a + j] -= 1
        held, total = [], 0
    return np.cumsum(edge)[:-1] > 0


def without_repeats(docs: DataFrame, window: int = WINDOW, per_bucket: int = PER_BUCKET, pack: int = PACK, shard: int = SHARD) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, joined by one blank) for each row of docs.

    A word goes if a window of consecutive words of its document covers it that also begins in a document with a lesser
    doc_id. Null and empty texts have no words. A row with a null doc_id keeps all its words and takes none from others. Rows
    that share a doc_id do not take words from each other. A very long text is a pack of its own, and its time grows with its
    words, however often they repeat. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    packs = stage(_packed(need(docs, "doc_id", "text"), pack), "packs")
    windows = packs.agg(F.sum(F.length("blob"))).first()[0] or 0  # compressed, a window takes some two bytes
    buckets = max(1, -(-windows // (2 * per_bucket)))
    replies = _posts(packs, window, buckets).repartition(buckets, "bucket").groupBy("bucket").applyInPandas(_replies, _REPLY)

    def locate(key: tuple, rows: pa.Table, replied: pa.Table) -> pa.Table:
        ids, totals, gone, kept = [], [], [], []
        for blob in rows["blob"].to_pylist():
            p = Pack(blob, window)
            drop = _removed(p, _passages(p, replied), shard)
            for doc_id, text, (a, z) in zip(p.ids, p.texts.to_pylist(), p.words.texts(), strict=True):
                stay = ~drop[a:z]
                ids.append(doc_id)
                totals.append(z - a)
                gone.append(z - a - int(stay.sum()))
                kept.append(b" ".join(compress(text.split(), stay.tolist()) if gone[-1] else text.split()))
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(totals, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept": pa.array(kept, pa.binary()).cast(pa.string())})

    return packs.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(locate, "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
