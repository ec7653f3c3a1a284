"""Changes of stored tables in place: each reads and rewrites the buckets of heights that it touches. All return how many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import written
from ..sources.tables import PART, WIDTH, delete, merge_into, parts, range_parts, together
from . import store, watch


def upsert_blocks(path: str, incoming: DataFrame, order: str = "block_hash", width: int = WIDTH) -> int:
    return merge_into(incoming.sparkSession, path, parts(incoming, width), lambda old: store.upsert_blocks(old, incoming, order), width)


def insert_transactions(path: str, incoming: DataFrame, order: str = "tx_index", key: list[str] | None = None, width: int = WIDTH) -> int:
    return merge_into(incoming.sparkSession, path, parts(incoming, width), lambda old: store.insert_transactions(old, incoming, order, key), width)


def set_status(path: str, keys: DataFrame, status: str, width: int = WIDTH) -> int:
    """Keys without a height, as hashes are, are looked up first: of the table only their columns are read for that. Keys are written,
    and rows tried against an array of bits: those that can't have a key stay where they are, and only the others are joined."""
    spark, columns = keys.sparkSession, keys.columns
    if "block_number" in columns:
        return merge_into(spark, path, parts(keys, width), lambda old: store.set_status(old, keys, status), width)
    keys, at = written(keys.distinct(), "keys")
    near = watch.possible(keys.select(F.struct(*columns)))(F.struct(*columns))
    touched = spark.read.parquet(path).filter(near).select(*columns, *PART).join(keys, columns, "left_semi").select(*PART).distinct()

    def marked(old: DataFrame) -> DataFrame:
        found = store.set_status(old.filter(near), keys, status)
        return old.filter(~near).unionByName(together(found, width).select(*old.columns))

    n = merge_into(spark, path, touched, marked, width, dealt=True)
    delete(spark, at)
    return n


def delete_block_range(path: str, ranges: DataFrame, width: int = WIDTH) -> int:
    """ranges (chain_id, lo, hi). Only buckets that are stored are touched, however wide a range is."""
    spark = ranges.sparkSession
    stored = spark.read.parquet(path).select(*PART).distinct()
    return merge_into(spark, path, range_parts(ranges, width).join(stored, PART, "left_semi"), lambda old: store.delete_block_range(old, ranges), width)


def delete_tx_by_block(path: str, keys: DataFrame, width: int = WIDTH) -> int:
    return merge_into(keys.sparkSession, path, parts(keys, width), lambda old: store.delete_tx_by_block(old, keys), width)


def prune(path: str, policy: DataFrame, now: int, width: int = WIDTH) -> int:
    """Buckets with something to drop are found by the times of all rows, and these alone are rewritten."""
    spark = policy.sparkSession
    times = spark.read.parquet(path).select("chain_id", "block_timestamp", *PART)
    old = times.join(policy.select("chain_id", "retention_seconds"), "chain_id").filter((F.col("retention_seconds") > 0) & (F.col("block_timestamp") < now - F.col("retention_seconds")))
    return merge_into(spark, path, old.select(*PART).distinct(), lambda rows: store.prune(rows, policy, now), width)
