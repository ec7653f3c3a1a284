"""Exact top-k by inner product with an M-tree in pages, searched best first.

The greatest inner product is the least distance once every vector x gets one more component, sqrt(M - |x|^2), M being the
greatest |x|^2, and every query a zero there. That distance is a metric, and the tree is over it:

* the root has routing objects from a bounded sample. Every vector belongs to the nearest, and a cell is cut by a hash into
  shards of a bounded size, so copies of one vector spread too;
* a shard is a subtree of paged nodes, each a row: an inner node has its children's routing objects, their covering radii and
  their distances from the node's own routing object (parent distances); a leaf has vectors with theirs, in that order.

A query searches a shard best first: a queue has nodes by the least distance that anything in them can have, d(q, r) - radius.
The nearest is opened, and the search ends when the nearest is further than the k-th result so far. Where |d(q, r) - p|, p being a
stored parent distance, is beyond that already, no distance is computed, by the triangle inequality. Each query first goes to the
nearest shards that together hold k vectors or more, and then, with the bound found there, to the shards that it leaves. Nodes
come to a task ahead of the queries, which stream past them, so a task holds one shard whatever the number of queries.

Scores are integers, exact in double precision as long as squared lengths are under EXACT. What takes part in a longer vector's
scores is compared one by one in Python's whole numbers instead, queries in blocks: long vectors with all queries, and all
vectors with long queries. The others stay in the tree.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_batches, need, small_batches, stage

#: Routing objects of the root at most and rows for each; vectors of a shard, about, entries of a leaf, and children of a node.
ROOT, PER_OBJECT, SHARD, PAGE, FANOUT = 256, 2000, 65_536, 256, 32
#: Queries that one task searches a shard for, and that the driver sends to all tasks where vectors are long.
QUERIES, LONG_QUERIES = 65_536, 256
#: A child that would get more of a node's vectors than this share, of copies say, is cut by the parent distance instead.
LARGEST = 0.9
#: Vector components are scaled and cut to integers.
SCALE = 1024
#: Inner products under this are whole numbers in double precision, partial sums too.
EXACT = 2.0**53
#: Bytes of a whole number that sorts as bytes; no score of finite doubles needs as many. Scores are given as far as a long goes.
DIGITS, MOST = 264, 2**63 - 1
_EXACT = "query_id long, q binary, vec_id long, score long, order binary"
_NODES = "cell int, part long, node long, leaf boolean, ids binary, vectors binary, parents binary, radii binary"
_VISITS = "query_id long, q binary, cell int, d double, least double, parts long, own long"
_FOUND = "query_id long, q binary, vec_id long, score long"


def finite(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) with doubles, of the rows that take part."""
    ok = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return need(embeddings, "vec_id", "embedding").filter(ok).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(1024 x) of each component, for vectors of finite components only; too large ones stay so."""
    return finite(embeddings).select("vec_id", _whole_vector().alias("v"))


def _whole_vector() -> Column:
    return F.transform("embedding", lambda x: F.when(F.abs(x) < 2.0**42, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(len(column), -1)


def _extra(x: np.ndarray, most: float) -> np.ndarray:
    """The component that brings every vector to the same length."""
    return np.sqrt(np.maximum(most - (x * x).sum(1), 0))


def _apart(x: np.ndarray, extra: np.ndarray, objects: np.ndarray, extras: np.ndarray, most: float) -> np.ndarray:
    """Distances of vectors to routing objects, extra components included."""
    return np.sqrt(np.maximum(2 * (most - x @ objects.T - extra[:, None] * extras[None]), 0))


def _slack(squares: float) -> float:
    """How much two stored distances may be off by rounding, for a sum of squared lengths. Squares are off by a few units in the last place."""
    return math.sqrt(64 * np.finfo(float).eps * squares) + 1e-6


def bulk_load(ids: np.ndarray, x: np.ndarray, routing: np.ndarray, most: float, page: int, fanout: int) -> Iterator[tuple]:
    """Nodes (node, leaf, ids, vectors, parents, radii) of the subtree over vectors under a routing object; the ids of an inner node
    are its children's, and node 0 is the top one. Any vectors, copies too: every child is smaller than its node."""
    extra = _extra(x, most)
    top = routing.reshape(1, -1)
    todo, made = [(0, np.arange(len(ids)), top, _extra(top, most))], 1
    while todo:
        node, rows, own, own_extra = todo.pop()
        parents = _apart(x[rows], extra[rows], own, own_extra, most)[:, 0]
        order = np.lexsort((ids[rows], parents))
        rows, parents = rows[order], parents[order]
        if len(rows) <= page:
            yield node, True, ids[rows], x[rows], parents, np.zeros(0)
            continue
        count = min(fanout, -(-len(rows) // page))
        at = np.linspace(0, len(rows) - 1, count).astype(int)
        child = _apart(x[rows], extra[rows], x[rows[at]], extra[rows[at]], most).argmin(1)
        if np.bincount(child).max() > LARGEST * len(rows):
            child = np.arange(len(rows)) * count // len(rows)
            at = np.searchsorted(child, np.arange(count))
        children, radii, kept = [], [], []
        for c in np.unique(child):
            members, seed = rows[child == c], rows[at[c] : at[c] + 1]
            radii.append(_apart(x[members], extra[members], x[seed], extra[seed], most).max())
            children.append(made)
            kept.append(at[c])
            todo.append((made, members, x[seed], extra[seed]))
            made += 1
        yield node, False, np.array(children, np.int64), x[rows[kept]], parents[kept], np.array(radii)


def best_first(nodes: dict[int, tuple], q: np.ndarray, own: int, d: float, k: int, most: float, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the k best of a subtree for a query at distance d from its routing object, best first, ties to the lesser id;
    only those that score least or more, and none with the query's own id."""
    square = float(q @ q)
    slack = _slack(square + most)
    reach = lambda s: math.sqrt(max(square + most - 2 * s, 0.0)) + slack if s > -math.inf else math.inf
    within, scores, found = reach(least), np.zeros(0), np.zeros(0, np.int64)
    queue = [(0.0, 0, d)]
    while queue:
        low, node, d = heapq.heappop(queue)
        if low > within:
            break
        leaf, ids, x, parents, radii = nodes[node]
        if not leaf:
            near = np.flatnonzero(np.abs(d - parents) - radii <= within)  # of the others no distance is computed
            to = np.sqrt(np.maximum(square + most - 2 * (x[near] @ q), 0))
            for low, child, far in zip(np.maximum(to - radii[near], 0).tolist(), ids[near].tolist(), to.tolist(), strict=True):
                if low <= within:
                    heapq.heappush(queue, (low, child, far))
            continue
        a, b = np.searchsorted(parents, d - within), np.searchsorted(parents, d + within, "right")
        score = x[a:b] @ q
        good = np.flatnonzero((score >= least) & (ids[a:b] != own))
        if len(good):
            scores, found = np.concatenate([scores, score[good]]), np.concatenate([found, ids[a:b][good]])
            order = np.lexsort((found, -scores))[:k]
            scores, found = scores[order], found[order]
            if len(scores) == k and scores[-1] > least:
                least = float(scores[-1])
                within = reach(least)
    return scores, found


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 10, page: int = PAGE, root: int = ROOT, fanout: int = FANOUT, shard: int = SHARD, block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best other vectors, ties to the lesser vec_id.

    Both frames have vec_id and embedding. Vectors that are null or hold a null or non-finite component take no part, nor do
    rows with a null vec_id. Vectors are compared within the same number of components only. Equal rows of a query count once;
    equal rows of other vectors are each a result, and a query's own vec_id is none. Ranks go by exact inner products; a score
    beyond a long is given as the greatest or least long. Other columns, whatever their names, are ignored. Empty tables give an
    empty result.
    """
    spark = embeddings.sparkSession
    small_batches(spark)
    parted = lambda df: df.withColumns({"dim": F.size("v"), "short": F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x) < EXACT})
    data = stage(parted(whole_vectors(embeddings)), "vectors")
    asked = stage(parted(whole_vectors(queries).distinct()), "queries")
    long_asked = {r["dim"] for r in asked.filter("NOT short").groupBy("dim").count().collect()}
    squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    found = None
    for dim, n, most, long_data in sorted((tuple(r) for r in data.groupBy("dim").agg(F.count_if("short"), F.max(F.when(F.col("short"), squares)), F.count_if(~F.col("short"))).collect()), key=lambda r: r[0]):
        here = F.col("dim") == dim
        part = _top_k(data.filter(here & F.col("short")), asked.filter(here & F.col("short")), k, most, n, page, root, fanout, shard, block) if n else None
        if long_data or dim in long_asked:
            own = lambda df: parted(finite(df).filter(F.size("embedding") == dim).withColumn("v", _whole_vector()))  # noqa: B023, E731
            x, q = own(embeddings), own(queries)
            q = q.filter("short").dropDuplicates(["vec_id", "v"]).unionByName(q.filter("NOT short").dropDuplicates(["vec_id", "embedding"]))
            exact = _one_by_one(x.filter("NOT short"), q, k).unionByName(_one_by_one(x.filter("short"), q.filter("NOT short"), k))
            exact = exact if part is None else exact.unionByName(map_batches(part.select("query_id", "q", "vec_id", "score"), _with_order, _EXACT))
            ranked = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.col("order").desc(), "vec_id"))
            part = exact.withColumn("rank", ranked.cast("int")).filter(F.col("rank") <= k)
        part = part.select("query_id", "rank", "vec_id", "score")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in x], pa.binary())


def _array(content: bytes | None, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(content, kind) if content else np.zeros(0, kind)


def _batch(rows: list[tuple], schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, schema, strict=True)], [name for name, _ in schema])


def _tree(data: DataFrame, routing: np.ndarray, k: int, most: float, page: int, fanout: int, shard: int) -> tuple[DataFrame, dict[int, tuple[int, float, int]]]:
    """The nodes of all shards, and of each cell the number of vectors, the covering radius and the number of shards."""
    objects = data.sparkSession.sparkContext.broadcast((routing, _extra(routing, most)))

    def place(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _matrix(batch.column(1))
        d = _apart(x, _extra(x, most), *objects.value, most)
        cell = d.argmin(1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), _bytes(x), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], ["vec_id", "copies", "x", "cell", "parent"])

    once = data.groupBy("vec_id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))  # no more of equal rows can be results
    placed = stage(map_batches(once, place, "vec_id long, copies long, x binary, cell int, parent double"), "placed")
    cells = {r["cell"]: (r["n"], r["radius"], -(-r["n"] // shard)) for r in placed.groupBy("cell").agg(F.sum("copies").alias("n"), F.max("parent").alias("radius")).collect()}  # root rows

    def load(pdf: pd.DataFrame) -> pd.DataFrame:
        cell, part = int(pdf["cell"].iloc[0]), int(pdf["part"].iloc[0])
        x = _array(b"".join(pdf["x"])).reshape(len(pdf), -1)
        nodes = bulk_load(pdf["vec_id"].to_numpy(np.int64), x, objects.value[0][cell], most, page, fanout)
        rows = [(cell, part, node, leaf, *(c.tobytes() for c in columns)) for node, leaf, *columns in nodes]
        return pd.DataFrame(rows, columns=["cell", "part", "node", "leaf", "ids", "vectors", "parents", "radii"])

    parts = F.create_map(*(F.lit(v) for c, (_, _, p) in cells.items() for v in (c, p)))
    spread = placed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("part", F.pmod(F.xxhash64("x", "vec_id", "copy"), parts[F.col("cell")]))
    return stage(spread.select("cell", "part", "vec_id", "x").groupBy("cell", "part").applyInPandas(load, _NODES), "nodes"), cells


def _top_k(data: DataFrame, asked: DataFrame, k: int, most: float, n: int, page: int, root: int, fanout: int, shard: int, block: int) -> DataFrame:
    """(query_id, q, rank, vec_id, score) of short vectors of one number of components."""
    spark = data.sparkSession
    sample = data.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(max(1, min(root, n // PER_OBJECT))).collect()  # bounded by root
    routing = np.array([r["v"] for r in sample], np.float64).reshape(len(sample), -1)
    nodes, cells = _tree(data, routing, k, most, page, fanout, shard)
    known = np.array(sorted(cells), int)
    sizes, radii, parts = (np.array([cells[c][i] for c in known]) for i in range(3))
    objects = spark.sparkContext.broadcast(routing[known])
    blocks = max(1, -(-asked.count() // block))
    visit = [("query_id", pa.int64()), ("q", pa.binary()), ("cell", pa.int32()), ("d", pa.float64()), ("least", pa.float64()), ("parts", pa.int64()), ("own", pa.int64())]

    def visits(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The cells that a query goes to; own is the shard of the first round, -1 if the cell isn't in it."""
        q = _matrix(batch.column(1))
        squares, products, rows = (q * q).sum(1), q @ objects.value.T, []
        for i, query_id in enumerate(batch.column(0).to_pylist()):
            d = np.sqrt(np.maximum(squares[i] + most - 2 * products[i], 0))
            order = np.lexsort((d, np.maximum(d - radii, 0)))
            first = set(order[: int(np.searchsorted(np.cumsum(sizes[order] // parts[order]), k + 1)) + 1].tolist())
            least = batch.column(2)[i].as_py() if batch.num_columns > 2 else None
            if batch.num_columns == 2:
                chosen = sorted(first)
            else:
                within = math.inf if least is None else math.sqrt(max(squares[i] + most - 2 * least, 0)) + _slack(squares[i] + most)
                chosen = np.flatnonzero(d - radii <= within).tolist()
            rows += [(query_id, q[i].tobytes(), int(known[c]), float(d[c]), least, int(parts[c]), query_id % int(parts[c]) if c in first else -1) for c in chosen]
            if len(rows) >= 4096:
                yield _batch(rows, visit)
                rows = []
        yield _batch(rows, visit)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a shard come together, its nodes first."""
        here, held = None, {}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                shard_ = (row["cell"], row["part"], row["block"])
                if row["node"] is not None:
                    if shard_ != here:
                        here, held = shard_, {}
                    ids = _array(row["ids"], np.int64)
                    held[row["node"]] = (row["leaf"], ids, _array(row["vectors"]).reshape(len(ids), -1), _array(row["parents"]), _array(row["radii"]))
                elif shard_ == here:  # a hash may leave a shard without vectors
                    least = -math.inf if row["least"] is None else row["least"]
                    scores, ids = best_first(held, _array(row["q"]), row["query_id"], row["d"], k, most, least)
                    out += [(row["query_id"], row["q"], i, int(s)) for s, i in zip(scores.tolist(), ids.tolist(), strict=True)]
            yield _batch(out, [("query_id", pa.int64()), ("q", pa.binary()), ("vec_id", pa.int64()), ("score", pa.int64())])

    every = nodes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def results(queries: DataFrame, part: Column) -> DataFrame:
        """(query_id, q, vec_id, score): the k best of each shard that a query goes to."""
        to = map_batches(queries, visits, _VISITS).withColumn("part", part).filter("part >= 0").drop("parts", "own")
        rows = every.unionByName(to.withColumn("block", F.pmod(F.xxhash64("query_id", "q"), F.lit(blocks))), allowMissingColumns=True)
        at = ["cell", "part", "block"]
        return rows.repartition(*at).sortWithinPartitions(*at, F.col("node").asc_nulls_last()).mapInArrow(search, _FOUND)

    ranked = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id"))
    best = lambda df: df.withColumn("rank", ranked).filter(F.col("rank") <= k)
    first = stage(best(results(asked.select("vec_id", "v"), F.col("own"))), "first")
    bound = first.filter(F.col("rank") == k).select("query_id", "q", F.col("score").cast("double").alias("score"))
    again = map_batches(asked.select("vec_id", "v"), _with_bytes, "query_id long, v array<double>, q binary").join(bound, ["query_id", "q"], "left").select("query_id", "v", "score")
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: p != F.col("own")))
    return best(first.drop("rank").unionByName(results(again, others))).select("query_id", "q", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _whole(x: float) -> int:
    """floor(1024 x), whatever the size."""
    return math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE


def _order(score: int) -> bytes:
    """A score as bytes that sort as it does."""
    return ((1 << 8 * DIGITS - 1) + score).to_bytes(DIGITS, "big")


def _with_order(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([_order(s) for s in batch.column(3).to_pylist()], pa.binary())], ["query_id", "q", "vec_id", "score", "order"])


def _one_by_one(data: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The k best of each batch of vectors for each query, in whole numbers of any size: (query_id, q, vec_id, score, order)."""
    spark = data.sparkSession
    blocks = max(1, -(-asked.count() // LONG_QUERIES))
    found = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)) == b).collect()
        # A short query is named as the tree names it, a long one by its components as they are.
        named = [(r["vec_id"], np.array(r["v"] if r["short"] else r["embedding"], np.float64).tobytes(), r["embedding"]) for r in rows]
        shared = spark.sparkContext.broadcast([(i, name, np.array([_whole(x) for x in v], object)) for i, name, v in named])

        def each(batch: pa.RecordBatch, shared=shared) -> Iterator[pa.RecordBatch]:
            ids = batch.column(0).to_pylist()
            x = np.array([[_whole(c) for c in v] for v in batch.column(1).to_pylist()], object).reshape(len(ids), -1)
            out = []
            for query_id, name, q in shared.value:
                best = sorted((-s, i) for s, i in zip((x @ q).tolist() if x.shape[1] else [0] * len(ids), ids, strict=True) if i != query_id)[:k]
                out += [(query_id, name, i, max(-MOST - 1, min(MOST, -s)), _order(-s)) for s, i in best]
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()], strict=True)], ["query_id", "q", "vec_id", "score", "order"])

        part = map_batches(data.select("vec_id", "embedding"), each, _EXACT)
        found = part if found is None else found.unionByName(part)
    return found


def _with_bytes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _bytes(_matrix(batch.column(1)))], ["query_id", "v", "q"])


def nearest(embeddings: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """top_k with the rows whose vec_id is divisible by ``every`` as queries."""
    return top_k(embeddings, embeddings.filter(F.col("vec_id") % every == 0), k)
