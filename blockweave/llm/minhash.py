"""MinHash near-duplicate detection by an inverted join on signature coordinates.

Every document posts each of its K minima under the key (coordinate, value). Two documents that share at least M keys are
candidates, and candidates are confirmed on their full shingle sets. Shared keys are counted as in a T-occurrence merge:

* prefix: keys are ordered by how many documents post them, rarest first. Two documents with M common keys have one in
  common among the first (keys - M + 1) of either, so only that prefix is merged;
* skip: the rest, the long postings, are never merged. The whole signatures of a merged pair are probed instead.

Equal sets are one class from the start. In a long posting the most central class is compared with all others first; what
it links is one component. Only classes that stay in different components are then compared pair by pair, so a large group
of near copies costs one comparison for each member, and no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, need, stage
from .components import connected_components
from .text import LOWER, mix, shingle_set, word_batches

#: Coordinates of a signature, and how many must agree. At a Jaccard index of 0.85, fewer than 16 of 32 agree with
#: probability 2e-6.
COORDINATES, MATCHES = 32, 16
#: Words of a shingle, and the least Jaccard index of a link in percent.
WORDS, PERCENT = 5, 85
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(101, COORDINATES + 101, dtype=np.uint64))


def signature(shingles: np.ndarray) -> list[int]:
    return [int((shingles * a + b).min() >> np.uint64(33)) for a, b in zip(_SEEDS, _SHIFTS, strict=True)]


def _bits(x: np.uint64) -> int:
    return int(np.uint64(x).astype(np.int64))


def signatures(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, sig): size, 128-bit digest and signature of each document's shingle set."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = []
        for _, w in word_batches(batch.column(1), LOWER):
            for i, j in w.texts():
                s = shingle_set(w.hashes[i:j], n)
                rows.append((len(s), _bits(mix(s).sum()), _bits(mix(s ^ _SEEDS[0]).sum()), signature(s) if len(s) else None))
        size, hi, lo, sig = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "n_shingles", "hi", "lo", "sig"])

    return map_batches(need(docs, "doc_id", "text"), run, "doc_id long, n_shingles long, hi long, lo long, sig array<int>")


def shingle_sets(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(id, shingles): the full sets, as sorted 64-bit hashes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        sets = [shingle_set(w.hashes[i:j], n).tobytes() for _, w in word_batches(batch.column(1), LOWER) for i, j in w.texts()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "shingles"])

    return map_batches(need(docs, "doc_id", "text"), run, "id long, shingles binary")


def agreeing(a: str, b: str) -> F.Column:
    """How many coordinates of two signatures agree."""
    return sum((F.get(F.col(a), F.lit(i)) == F.get(F.col(b), F.lit(i))).cast("int") for i in range(COORDINATES))


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """(key, id, weight): the prefix of each class's keys that others post too; weight: how central the class is."""
    keys = classes.select("id", F.posexplode("sig").alias("i", "v")).select("id", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("v")).alias("key"))
    common = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    own = keys.join(common, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys")).filter(F.size("keys") >= matches)
    prefix = F.slice("keys", F.lit(1), F.size("keys") - matches + 1)
    weight = F.aggregate("keys", F.lit(0).cast("long"), lambda s, k: s + k["n"])
    return own.select("id", weight.alias("weight"), F.explode(F.transform(prefix, lambda k: k["key"])).alias("key"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose full sets reach the Jaccard index."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = []
        for x, y in zip(left, right, strict=True):
            s, t = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if 100 * min(len(s), len(t)) < percent * max(len(s), len(t)):
                keep.append(False)
                continue
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(both > 0 and 100 * both >= percent * (len(s) + len(t) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    return map_batches(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "y"), run, "a long, b long")


def remaining_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of (id, component, shingles) in different components that may still be linked.

    Of sets x and y, |x| >= |y|, with a Jaccard index of p percent, at least p (|x| + |y|) / (100 + p) shingles are common.
    So in an order from rare to common shingles, the first |x| - ceil(p |x| / 100) + 1 of x and the first
    |y| - ceil(2 p |y| / (100 + p)) + 1 of y have one in common. What sets near-copies apart is rare, so few pairs meet.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, c, raw in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            s = np.frombuffer(raw, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i)), pa.array(np.full(len(s), c)), pa.array(np.full(len(s), len(s))), pa.array(s)], ["id", "component", "size", "shingle"])

    rows = stage(map_batches(sets.select("id", "component", "shingles"), each, "id long, component long, size long, shingle long"), "shingles")
    common = rows.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1")
    own = rows.join(common, "shingle").groupBy("id", "component", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    alone = F.col("size") - F.size("s")  # the rarest, which no other has
    probe = F.greatest(F.expr(f"size - ({percent} * size + 99) div 100 + 1") - alone, F.lit(0)).cast("int")
    index = F.greatest(F.expr(f"size - ({2 * percent} * size + {99 + percent}) div {100 + percent} + 1") - alone, F.lit(0)).cast("int")
    posts = own.select("id", "component", "size", (F.col("size") - alone).alias("left"), index.alias("index"), F.posexplode(F.slice("s", F.lit(1), probe)).alias("at", "x"))
    posts = posts.select("id", "component", "size", (F.col("left") - F.col("at")).alias("left"), F.col("x.shingle").alias("shingle"), (F.col("at") < F.col("index")).alias("indexed"))
    posts = stage(posts, "prefixes")
    x = posts.select("shingle", F.col("id").alias("a"), F.col("component").alias("c"), F.col("size").alias("m"), F.col("left").alias("i"))
    y = posts.filter("indexed").select("shingle", F.col("id").alias("b"), F.col("component").alias("d"), F.col("size").alias("n"), F.col("left").alias("j"))
    # Where they first meet, no more than what is left from there on can be common.
    meet = f"c != d AND (n < m OR n = m AND b < a) AND 100 * n >= {percent} * m AND {100 + percent} * least(i, j) >= {percent} * (m + n)"
    return x.join(y, "shingle").filter(meet).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text; more columns are ignored).

    Links are of at least ``percent`` Jaccard index on sets of n-word shingles, words lower-cased in A-Z. A null or empty
    text has an empty set and is linked with nothing. Rows that repeat a doc_id are one document with several texts: its
    links are those of all its texts. A null doc_id can't name a component: such a row is linked with nothing and gets
    component_id and kept null. Very long texts are one set as any other. An empty table gives an empty result.
    """
    sigs = stage(signatures(docs, n), "signatures")
    of_set = sigs.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("hi", "lo")
    of_set = stage(of_set.agg(F.min("doc_id").alias("id"), F.any_value("sig").alias("sig")), "classes")
    classes = of_set.select("id", "sig")
    posted = stage(postings(classes, matches), "postings")

    sets = need(docs, "doc_id", "text").join(posted.select(F.col("id").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id")
    sets = stage(shingle_sets(sets, n), "sets")
    signs = stage(classes.join(posted.select("id").distinct(), "id"), "signs")
    left, right = signs.select(F.col("id").alias("a"), F.col("sig").alias("s")), signs.select(F.col("id").alias("b"), F.col("sig").alias("t"))

    pivots = posted.groupBy("key").agg(F.max_by("id", F.struct("weight", -F.col("id"))).alias("b"))
    first = posted.join(pivots, "key").filter("id != b").select(F.col("id").alias("a"), "b").distinct()
    first = first.join(left, "a").join(right, "b").filter(agreeing("s", "t") >= matches)
    links = stage(confirmed(first, sets, percent), "links")
    found = connected_components(links)

    grouped = posted.join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    split = grouped.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y")
    open_ = grouped.join(split.select("key"), "key").select("id", "component").distinct()
    rest = remaining_pairs(stage(sets.join(open_, "id"), "open"), percent)
    more = stage(confirmed(rest, sets, percent), "links")
    # Rows that share a doc_id are one document.
    again = sigs.filter("n_shingles > 0").groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id")
    same = sigs.join(again, "doc_id").join(of_set.select("hi", "lo", "id"), ["hi", "lo"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    found = stage(connected_components(links.union(more).union(same)), "components")

    known = of_set.join(found, "id", "left").select("hi", "lo", F.coalesce("component", "id").alias("component"))
    out = sigs.drop("sig").join(known, ["hi", "lo"], "left")
    linked = F.col("n_shingles") > 0
    component = F.when(F.col("doc_id").isNull(), None).when(linked, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))
