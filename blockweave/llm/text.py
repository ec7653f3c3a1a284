"""Words and 64-bit hashes of word n-grams, by numpy over whole Arrow batches of UTF-8."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
#: Bytes that are hashed at once; a longer text is cut at a blank.
PIECE = 1 << 20

#: Byte tables: words as they are, and in lower case (A-Z); white space is 0x20 and 0x09-0x0D.
AS_IS = np.array([32 if b == 32 or 9 <= b <= 13 else b for b in range(256)], np.uint8)
LOWER = np.array([b + 32 if 65 <= b <= 90 else AS_IS[b] for b in range(256)], np.uint8)
#: Lower case, with ASCII punctuation as white space.
BARE = np.array([32 if b < 128 and not chr(b).isalnum() else LOWER[b] for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, and a random number for each byte."""
    up, down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(PIECE, b, np.uint64))]) for b in (_BASE, _BASE_INVERSE))
    return up, down, mix(np.arange(1, 257, dtype=np.uint64))


@dataclass
class Words:
    """The words of some texts: hashes, first and end bytes in data, and where each text's words begin (one more at the end)."""

    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def texts(self) -> Iterator[tuple[int, int]]:
        return zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)


def _hash_piece(chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words [start, end) by a polynomial over their bytes, modulo 2^64, taken from running sums."""
    up, down, of_byte = _powers()
    sums = np.empty(len(chars) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(of_byte[chars] * up[: len(chars)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Words:
    """Words of the texts data[offsets[i]:offsets[i + 1]]."""
    chars = table[data]
    inside = chars != 32
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    hashes, done = np.empty(len(starts), np.uint64), 0
    while done < len(starts):
        begin = starts[done]
        stop = max(done + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        if ends[stop - 1] - begin > PIECE:  # one word longer than a piece
            parts = [_hash_piece(chars[i : min(i + PIECE, ends[done])], np.array([0]), np.array([min(PIECE, ends[done] - i)]))[0] for i in range(begin, ends[done], PIECE)]
            h = np.zeros(1, np.uint64)
            for p in parts:
                h = mix(h * _ODD + p)
            hashes[done] = h[0]
        else:
            hashes[done:stop] = _hash_piece(chars[begin : ends[stop - 1]], starts[done:stop] - begin, ends[done:stop] - begin)
        done = stop
    return Words(data, hashes, starts, ends, np.searchsorted(starts, offsets))


def binary_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow column of texts; null is empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def word_batches(column: pa.Array, table: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, Words]]:
    """(number of the first text, words) of some texts at a time, of about ``size`` bytes together, whole texts always."""
    data, offsets = binary_column(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, find_words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], table)
        i = j


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive words; empty if there are fewer."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for i in range(1, n):
        out *= _ODD
        out += hashes[i : len(hashes) - n + 1 + i]
    return mix(out)


def shingle_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of n-word shingles; a shorter text is one shingle, an empty one has none."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(ngram_hashes(hashes, min(n, len(hashes))))
