"""Gaps in stored heights, ranges of heights and the queue of missing ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .heights import BUCKET, running, with_previous


def find_gaps(blocks: DataFrame, lo: int | None = None, hi: int | None = None, width: int = BUCKET) -> DataFrame:
    """(chain_id, from_block, to_block): missing inner heights between lo and hi; none before the first or after the last stored one."""
    b = blocks.select("chain_id", "block_number").distinct()
    b = b.filter(F.col("block_number") >= lo) if lo is not None else b
    b = b.filter(F.col("block_number") <= hi) if hi is not None else b
    return with_previous(b, F.col("block_number"), "before", width).filter("block_number > before + 1").selectExpr("chain_id", "before + 1 AS from_block", "block_number - 1 AS to_block")


def cursor_gaps(arrivals: DataFrame, cursors: DataFrame) -> DataFrame:
    """A block that arrives at n over a cursor at c leaves the gap [c + 1, n - 1] if n > c + 1."""
    at = cursors.select("chain_id", F.col("block_number").alias("at"))
    return arrivals.select("chain_id", "block_number").join(at, "chain_id").filter("block_number > at + 1").selectExpr("chain_id", "at + 1 AS from_block", "block_number - 1 AS to_block")


def queue_gaps(queue: DataFrame, gaps: DataFrame, priority: int, now: int) -> DataFrame:
    """The queue with gaps appended as pending, with ids from their own keys."""
    new = gaps.select(F.abs(F.xxhash64("chain_id", "from_block", "to_block")).alias("id"), "chain_id", "from_block", "to_block", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit("").alias("error_msg"), F.lit(priority).alias("priority"), F.lit(now).cast("long").alias("created_at"), F.lit(now).cast("long").alias("updated_at"))
    return queue.unionByName(new)


def gap_jump(cursors: DataFrame, heads: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(ranges to queue, cursors moved to the head with no hash) of the chains that lag by more than a threshold above 0."""
    late = cursors.join(heads, "chain_id").filter((F.lit(threshold) > 0) & (F.col("head") - F.col("block_number") > threshold))
    return late.selectExpr("chain_id", "block_number + 1 AS from_block", "head AS to_block"), late.selectExpr("chain_id", "head AS block_number", "'' AS block_hash")


#: Heights, or chunks, that one row is cut into at a time.
STRETCH = 10_000


def _cut(ranges: DataFrame, n: int, *others: str) -> DataFrame:
    """Ranges in stretches of n heights that begin at the range's begin; first by arrays of STRETCH at most, then each spread out."""
    whole = ranges.filter("from_block <= to_block").select("chain_id", "from_block", "to_block", *others)
    wide = whole.select("*", F.explode(F.sequence("from_block", "to_block", F.lit(n * STRETCH))).alias("_a"))
    wide = wide.withColumn("_z", F.least(F.col("_a") + n * STRETCH - 1, "to_block"))
    return wide.select("chain_id", "to_block", *others, F.explode(F.sequence("_a", "_z", F.lit(n))).alias("start"))


def expand_ranges(ranges: DataFrame) -> DataFrame:
    """A row per height."""
    return _cut(ranges, 1).select("chain_id", F.col("start").alias("block_number"))


def parse_ranges(df: DataFrame, column: str) -> DataFrame:
    """Adds from_block, to_block and error for text of the form a-b; anything else, or a > b, is an error."""
    part = lambda i: F.expr(f"try_cast(nullif(regexp_extract({column}, '^([0-9]+)-([0-9]+)$', {i}), '') AS bigint)")
    out = df.withColumn("from_block", part(1)).withColumn("to_block", part(2))
    error = F.when(F.col("from_block").isNull() | F.col("to_block").isNull(), "invalid range").when(F.col("from_block") > F.col("to_block"), "start after end")
    return out.withColumn("error", error).withColumns({c: F.when(error.isNull(), F.col(c)) for c in ("from_block", "to_block")})


def merge_ranges(ranges: DataFrame, width: int = BUCKET) -> DataFrame:
    """Ranges of a chain that overlap or touch become one. Buckets of heights hand on how far the ranges before them reach."""
    key = ["chain_id", "_bucket"]
    before = W.partitionBy("chain_id").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    order = W.partitionBy(*key).orderBy("from_block", "to_block")
    b = ranges.filter("from_block <= to_block").select("chain_id", "from_block", "to_block", F.expr(f"from_block div {width}").alias("_bucket"))
    reach = b.groupBy(*key).agg(F.max("to_block").alias("_reach")).withColumn("_reach", F.max("_reach").over(before))
    b = b.join(reach, key).withColumn("_before", F.greatest(F.max("to_block").over(order.rowsBetween(W.unboundedPreceding, -1)), "_reach"))
    b = b.withColumn("_start", F.when(F.col("_before").isNull() | (F.col("from_block") > F.col("_before") + 1), F.col("from_block")))
    latest = b.groupBy(*key).agg(F.max("_start").alias("_latest")).withColumn("_latest", F.max("_latest").over(before))
    b = b.join(latest, key).withColumn("_island", F.coalesce(F.max("_start").over(order.rowsBetween(W.unboundedPreceding, 0)), "_latest"))
    return b.groupBy("chain_id", "_island").agg(F.max("to_block").alias("to_block")).selectExpr("chain_id", "_island AS from_block", "to_block")


def subtract_ranges(ranges: DataFrame, gone: DataFrame, width: int = BUCKET) -> DataFrame:
    """What ranges have and gone hasn't, by their edges alone, however wide they are. Ranges of either don't overlap or touch (as
    merge_ranges leaves them)."""
    edge = lambda at, n: F.struct(at.alias("block_number"), F.lit(n).cast("long").alias("_d"))
    edges = lambda df, n: df.select("chain_id", F.inline(F.array(edge(F.col("from_block"), n), edge(F.col("to_block") + 1, -n))))
    steps = edges(ranges, 1).unionByName(edges(gone, 2)).groupBy("chain_id", "block_number").agg(F.sum("_d").alias("_d"))
    inside = running(steps, ["chain_id"], "block_number", ["block_number"], F.col("_d"), "_in", width)
    ends = with_previous(inside.withColumn("block_number", -F.col("block_number")), F.col("block_number"), "_next", width)  # from the top down
    return ends.filter("_in = 1").selectExpr("chain_id", "-block_number AS from_block", "-_next - 1 AS to_block")


def split_ranges(ranges: DataFrame, n: int = 100, *others: str) -> DataFrame:
    """Ranges in chunks of at most n heights, with other columns of their range."""
    return _cut(ranges, n, *others).select("chain_id", F.col("start").alias("from_block"), F.least(F.col("start") + n - 1, "to_block").alias("to_block"), *others)


def remaining_ranges(chunks: DataFrame, progress: DataFrame) -> DataFrame:
    """What is left of chunks (chain_id, from_block, to_block) after progress (chain_id, from_block, done up to a height)."""
    left = chunks.join(progress.select("chain_id", "from_block", "done"), ["chain_id", "from_block"], "left")
    return left.select("chain_id", F.greatest("from_block", F.coalesce(F.col("done") + 1, F.col("from_block"))).alias("from_block"), "to_block").filter("from_block <= to_block")


def _pending(queue: DataFrame) -> DataFrame:
    return queue.filter("status = 'pending'")


def next_range(queue: DataFrame) -> DataFrame:
    """The pending range of each chain that begins lowest; ties to the lesser id."""
    first = _pending(queue).groupBy("chain_id").agg(F.min(F.struct("from_block", "id", "to_block")).alias("r"))
    return first.select("chain_id", "r.id", "r.from_block", "r.to_block")


def pending_ranges(queue: DataFrame, n: int = 1000) -> DataFrame:
    """Up to n pending ranges of each chain, the lowest first."""
    order = F.row_number().over(W.partitionBy("chain_id").orderBy("from_block", "id"))
    return _pending(queue).withColumn("_n", order).filter(F.col("_n") <= n).select("chain_id", "id", "from_block", "to_block")


def count_pending_ranges(queue: DataFrame) -> DataFrame:
    return _pending(queue).groupBy("chain_id").agg(F.count("*").alias("n_pending"))


def mark_ranges(queue: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """changes (id, new_status, new_error): status, error and updated_at of those ids."""
    joined = queue.join(changes, "id", "left")
    hit = F.col("new_status").isNotNull()
    return joined.withColumns({"status": F.coalesce("new_status", "status"), "error_msg": F.when(hit, F.coalesce("new_error", F.lit(""))).otherwise(F.col("error_msg")), "updated_at": F.when(hit, F.lit(now).cast("long")).otherwise(F.col("updated_at"))}).select(*queue.columns)


def backfill_stats(queue: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    return queue.groupBy("chain_id").agg(F.count_if(done).alias("n_processed"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "pending").alias("n_pending"), F.max(F.when(done, F.col("updated_at"))).alias("last_at"))


def backfill_gate(queue: DataFrame, usage: DataFrame, now: int, pause_percent: float = 70, spacing: int = 12) -> DataFrame:
    """Per chain with pending ranges: held by quota (usage: one row usage_percent) or by the spacing after the last finished range, or free."""
    last = backfill_stats(queue).filter("n_pending > 0").crossJoin(F.broadcast(usage.select("usage_percent").limit(1)))
    gate = F.when(F.col("usage_percent") >= pause_percent, "quota").when(F.lit(now) - F.col("last_at") < spacing, "spacing").otherwise("free")
    return last.select("chain_id", "n_pending", gate.alias("gate"))
