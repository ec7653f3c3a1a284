"""Reorganisations: parent links that don't hold, the height to go back to, and what goes with it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .heights import BUCKET, with_last, with_previous
from .store import spans_hit


def check_parent_hash(incoming: DataFrame, blocks: DataFrame) -> DataFrame:
    """A new block at n against the stored one at n - 1: match, absent, genesis or mismatch."""
    stored = blocks.select("chain_id", (F.col("block_number") + 1).alias("block_number"), F.col("block_hash").alias("stored"))
    verdict = F.when(F.col("block_number") == 0, "genesis").when(F.col("stored").isNull(), "absent").when(F.col("stored") == F.col("parent_hash"), "match").otherwise("mismatch")
    return incoming.join(stored, ["chain_id", "block_number"], "left").select("chain_id", "block_number", verdict.alias("verdict"))


def broken_links(blocks: DataFrame, width: int = BUCKET) -> DataFrame:
    """Stored blocks whose parent hash isn't the hash of the stored block just below."""
    b = with_previous(blocks, F.struct("block_number", "block_hash"), "below", width)
    return b.filter("below.block_number = block_number - 1 AND below.block_hash <> parent_hash").select("chain_id", "block_number", "parent_hash", F.col("below.block_hash").alias("expected"))


def safe_point(mismatches: DataFrame, blocks: DataFrame, max_depth: int = 100, width: int = BUCKET) -> DataFrame:
    """Where to go back to for a mismatch at n: (chain_id, block_number, safe_block, safe_hash, depth, too_deep).

    Down from n - 1, the first stored block whose link to the one below holds gives the one below. A missing height, or
    height 0, ends the way with an empty hash.
    """
    b = with_previous(blocks, F.struct("block_number", "block_hash"), "below", width)
    has_below = F.coalesce(F.col("below.block_number") == F.col("block_number") - 1, F.lit(False))
    k = F.col("block_number")
    found = lambda at, h: F.struct(k.alias("k"), at.alias("safe"), h.alias("hash"))
    stop = F.when(k == 0, found(k, F.lit(""))).when(~has_below, found(k - 1, F.lit(""))).when(F.col("below.block_hash") == F.col("parent_hash"), found(k - 1, F.col("below.block_hash")))
    stops = with_last(b, stop, "stop", width).select("chain_id", (k + 1).alias("block_number"), "stop")
    joined = mismatches.select("chain_id", "block_number").join(stops, ["chain_id", "block_number"], "left")
    depth = F.coalesce(F.col("block_number") - F.col("stop.k"), F.lit(1))
    return joined.select("chain_id", "block_number", F.coalesce("stop.safe", F.col("block_number") - 1).alias("safe_block"), F.coalesce("stop.hash", F.lit("")).alias("safe_hash"), depth.alias("depth"), (depth > max_depth).alias("too_deep"))


def _orphans(reorgs: DataFrame, blocks: DataFrame, single_step: bool) -> DataFrame:
    """Keys of stored blocks above the safe one and under the mismatch; with single_step only the block next to the safe one."""
    hi = "safe_block + 1" if single_step else "block_number - 1"
    return spans_hit(blocks, reorgs.selectExpr("chain_id", "safe_block + 1 AS lo", f"{hi} AS hi"))


def reorg_rollback(reorgs: DataFrame, blocks: DataFrame, txs: DataFrame, cursors: DataFrame, single_step: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """reorgs as safe_point gives them -> (blocks, transactions, cursors, counts) after the rollback."""
    gone = _orphans(reorgs, blocks, single_step).withColumn("_gone", F.lit(True))
    key = ["chain_id", "block_number"]
    mark = lambda df, s: df.join(gone, key, "left").withColumn("status", F.when(F.col("_gone"), F.lit(s)).otherwise(F.col("status")))
    back = reorgs.groupBy("chain_id").agg(F.min(F.struct("safe_block", "safe_hash")).alias("_to"))
    new_cursors = cursors.join(back, "chain_id", "left").withColumns({
        "block_number": F.coalesce("_to.safe_block", "block_number"), "block_hash": F.coalesce("_to.safe_hash", "block_hash"), "state": F.when(F.col("_to").isNotNull(), F.lit("scanning")).otherwise(F.col("state")),
    }).select(*cursors.columns)
    n_tx = txs.join(gone, key).groupBy("chain_id").agg(F.count("*").alias("n_transactions"))
    counts = gone.groupBy("chain_id").agg(F.count("*").alias("n_blocks")).join(n_tx, "chain_id", "left").select("chain_id", "n_blocks", F.coalesce("n_transactions", F.lit(0)).alias("n_transactions"))
    return mark(blocks, "orphaned").select(*blocks.columns), mark(txs, "invalid").select(*txs.columns), new_cursors, counts


def revert_events(reorgs: DataFrame, blocks: DataFrame, txs: DataFrame, single_step: bool = False) -> DataFrame:
    """One event for each transaction of an orphaned block."""
    gone = _orphans(reorgs, blocks, single_step)
    return txs.join(gone, ["chain_id", "block_number"]).select("chain_id", "block_number", "tx_hash", F.lit("transaction_reverted").alias("event_type"), F.lit("blockchain_reorganization").alias("reason"))


def can_recover(reorgs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Is the safe block stored?"""
    stored = blocks.select("chain_id", F.col("block_number").alias("safe_block"), F.lit(True).alias("_there")).distinct()
    return reorgs.join(stored, ["chain_id", "safe_block"], "left").select("chain_id", "block_number", "safe_block", F.coalesce("_there", F.lit(False)).alias("recoverable"))
