"""Spelling variants: words one letter apart, found by PartEnum signatures of their letter multisets.

A word's multiset of letters is a binary vector: component (letter, k) is set if the word has the letter k times or more. A replaced
letter changes two components, an inserted or deleted one changes one. Components are dealt into PARTS parts by hash. Vectors that
differ in two components agree in two of the four parts at least, and such that differ in one in one half of them, so choices of
parts are signatures, and near words have one in common. One edit also leaves the first half of a word or the rest of it as it is; a signature takes that half along, so
that anagrams and words of like letters don't all meet. Signatures are joined for equality, and what meets is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import need, stage
from .text import mix

#: A word has at least so many letters and occurrences; a form occurs so many times as often as its variant, at least.
LETTERS, OCCURRENCES, FACTOR = 7, 2, 10
#: Parts of the components, and bits of a part's hash.
PARTS, PART_BITS = 4, 16
#: Of the query's contract: one run of so many loses a letter.
ALTERED = 31
RUN = r"[A-Za-zÀ-ÿ]"
_UPPER, _LOWER = (bytes(range(first, first + 26)).decode() for first in (65, 97))


def occurrences(docs: DataFrame, least: int = LETTERS) -> DataFrame:
    """doc_id, word: every maximal run of letters of at least ``least`` of them, A-Z in lower case."""
    found = F.regexp_extract_all(F.translate("text", _UPPER, _LOWER), F.lit(f"({RUN}{{{least},}})"), F.lit(1))
    return need(docs, "doc_id", "text").select("doc_id", F.explode(found).alias("word"))


def altered(rows: DataFrame) -> DataFrame:
    """The runs of the query's contract: some lose a letter, by their document and themselves alone. A null doc_id alters nothing."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    at = (h % F.length("word")).cast("int")
    less = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
    return rows.select("doc_id", F.when(h % ALTERED == 0, less).otherwise(F.col("word")).alias("word"))


def vocabulary(rows: DataFrame, letters: int = LETTERS, least: int = OCCURRENCES) -> DataFrame:
    """word, n of the words of rows that have enough letters and occurrences."""
    return rows.filter(F.length("word") >= letters).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def part_hashes(words: list[str]) -> np.ndarray:
    """Of each word the hashes of its PARTS parts, PART_BITS bits each, in one number: sums over the components that are set."""
    size = np.array([len(w) for w in words], np.int64)
    codes, word = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64), np.repeat(np.arange(len(words)), size)
    order = np.lexsort((codes, word))
    codes = codes[order]
    first = np.ones(len(codes), bool)
    first[1:] = (codes[1:] != codes[:-1]) | (word[1:] != word[:-1])
    at = np.arange(len(codes))
    k = at - np.maximum.accumulate(np.where(first, at, 0))
    h = mix(codes + (k.astype(np.uint64) + np.uint64(1) << np.uint64(32)))
    sums = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(sums, (word, (h % np.uint64(PARTS)).astype(np.int64)), mix(h))
    cut = mix(sums) >> np.uint64(64 - PART_BITS)
    return (cut << (np.arange(PARTS, dtype=np.uint64) * np.uint64(PART_BITS))).sum(1, dtype=np.uint64)


def _mask(parts: tuple[int, ...]) -> int:
    """The bits of some parts, as a signed number."""
    m = sum((1 << PART_BITS) - 1 << i * PART_BITS for i in parts)
    return m - (1 << 64) if m >= 1 << 63 else m


#: Masks of the signatures for vectors that differ in one and in two components. One difference leaves one half of the parts as it
#: is; two leave two of the four parts.
ONE = [_mask(c) for c in ((0, 1), (2, 3))]
TWO = [_mask(c) for c in combinations(range(PARTS), PARTS - 2)]


def signatures(words: DataFrame, size: Column, masks: list[int]) -> DataFrame:
    """word, n, parts, side, sig and key of words (word, n, parts), for pairs of which the shorter has ``size`` letters.

    side is 0 for the first half of a word, 1 for the rest, sig the number of the mask; a key is a hash of all that must be equal.
    """
    half = (size / 2).cast("int")
    end = F.when(F.col("side") == 0, F.col("word").substr(F.lit(1), half)).otherwise(F.col("word").substr(F.length("word") - (size - half) + 1, size - half))
    rows = words.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).select("word", "n", "parts", "side", end.alias("end"), size.alias("size"))
    rows = rows.select("*", F.posexplode(F.array(*map(F.lit, masks))).alias("sig", "mask"))
    return rows.select("word", "n", "parts", "side", "sig", F.xxhash64("size", "side", "sig", F.col("parts").bitwiseAND(F.col("mask")), "end").alias("key"))


def _meet(a: DataFrame, b: DataFrame, masks: list[int]) -> DataFrame:
    """Near pairs of two sets of signatures, each pair once: at the first signature that both have. a has the shorter words."""
    a = a.select("key", "sig", "side", *(F.col(c).alias(f"{c}_a") for c in ("word", "n", "parts")))
    b = b.select("key", *(F.col(c).alias(f"{c}_b") for c in ("word", "n", "parts")))
    differ = F.col("parts_a").bitwiseXOR(F.col("parts_b"))
    agree = [differ.bitwiseAND(F.lit(m)) == 0 for m in masks]
    first = F.lit(False)
    for i, same in enumerate(agree):
        here = (F.col("sig") == i) & same
        for earlier in agree[:i]:
            here &= ~earlier
        first |= here
    half = (F.length("word_a") / 2).cast("int")
    first &= (F.col("side") == 0) | (F.col("word_a").substr(F.lit(1), half) != F.col("word_b").substr(F.lit(1), half))
    return a.join(b, "key").filter(first & (F.levenshtein("word_a", "word_b", 1) == 1)).select("word_a", "n_a", "word_b", "n_b")


def near_pairs(words: DataFrame) -> DataFrame:
    """word_a, n_a, word_b, n_b of all words (word, n) that differ by one inserted, deleted or replaced letter, each pair once."""
    ship(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(part_hashes(batch.column(0).to_pylist()).view(np.int64))], ["word", "n", "parts"])

    words = stage(need(words, "word", "n").mapInArrow(run, "word string, n long, parts long"), "parts")
    own, less = F.length("word"), F.length("word") - 1
    same = signatures(words, own, TWO)
    replaced = _meet(same, same, TWO).filter("word_a < word_b")
    inserted = _meet(signatures(words, own, ONE), signatures(words, less, ONE), ONE)
    return replaced.unionByName(inserted)


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): where following forms ends. A form occurs FACTOR times as often as its word, so there
    is no circle, and 19 steps lead from any count of 64 bits to a root. Each round doubles the steps."""
    state = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = state.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = stage(state.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        state = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return state


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of words (word, n)."""
    words = stage(need(words, "word", "n"), "words")
    side = lambda w, x: F.struct(F.col(f"word_{w}").alias("word"), F.col(f"n_{w}").alias("n"), F.col(f"word_{x}").alias("near"), F.col(f"n_{x}").alias("near_n"))
    both = near_pairs(words).select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near"))).alias("best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    near = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), (-F.col("best.less")).alias("form_n"), F.col("best.near").alias("form"))
    ok = F.col("form_n") >= factor * F.col("n")
    near = stage(near.withColumns({"form": F.when(ok, F.col("form")), "form_n": F.when(ok, F.col("form_n"))}), "forms")
    found = roots(near.filter("form IS NOT NULL").select("word", "form"))
    return near.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spellings(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n: a row for each word of docs (doc_id, text).

    Words are told apart by their code points. Null, empty and letterless texts have none; a null doc_id alters no word. Very long
    texts and words are read whole. Rows that repeat count each. Of near words with equal n the smallest in code-point order is
    the form. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    return variants(vocabulary(altered(occurrences(docs))))
