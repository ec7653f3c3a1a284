"""Lookups and writes of blocks, transactions, wallets and cursors. A write returns the new table; parquet is rewritten, not updated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TX_KEY = ["chain_id", "tx_hash", "block_number"]


def scan_block_range(blocks: DataFrame, chain: str, lo: int, hi: int) -> DataFrame:
    """Heights lo to hi of a chain, with nulls where no block is stored."""
    spine = blocks.sparkSession.range(lo, hi + 1).select(F.lit(chain).alias("chain_id"), F.col("id").alias("block_number"))
    return spine.join(blocks.filter((F.col("chain_id") == chain) & F.col("block_number").between(lo, hi)), ["chain_id", "block_number"], "left")


def by_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of the keys; keys hold any columns of df."""
    return df.join(keys.distinct(), keys.columns, "left_semi")


def latest_block(blocks: DataFrame) -> DataFrame:
    top = blocks.groupBy("chain_id").agg(F.max_by(F.struct(*blocks.columns), "block_number").alias("b"))
    return top.select("b.*")


def address_activity(txs: DataFrame, addresses: DataFrame) -> DataFrame:
    """Per address: transactions sent and received, and all that touch it."""
    sides = F.array(F.struct(F.col("from_address").alias("address"), F.lit(1).alias("sent")), F.struct(F.col("to_address").alias("address"), F.lit(0).alias("sent")))
    rows = txs.select(*TX_KEY, (F.col("from_address") == F.col("to_address")).alias("own"), F.explode(sides).alias("s")).select("own", "s.*")
    kept = rows.join(addresses.select(F.lower("address").alias("address")).distinct(), "address", "left_semi")
    return kept.groupBy("address").agg(F.sum("sent").alias("n_sent"), F.sum(1 - F.col("sent")).alias("n_received"), (F.count("*") - F.sum(F.when(F.col("own"), F.col("sent")).otherwise(0))).alias("n_transactions"))


def block_count_by_chain(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("chain_id").agg(F.count("*").alias("n_blocks"))


def cursor_status(cursors: DataFrame) -> DataFrame:
    return cursors.select("chain_id", "block_number", "updated_at")


def verify_hashes(blocks: DataFrame, other: DataFrame) -> DataFrame:
    """other (chain_id, block_number, block_hash): is the stored hash the same? A height that isn't stored is valid."""
    stored = blocks.select("chain_id", "block_number", F.col("block_hash").alias("stored"))
    return other.select("chain_id", "block_number", "block_hash").join(stored, ["chain_id", "block_number"], "left").select("chain_id", "block_number", (F.col("stored").isNull() | F.col("stored").eqNullSafe(F.col("block_hash"))).alias("valid"))


def _first(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def upsert_blocks(target: DataFrame, incoming: DataFrame, order: str = "block_hash") -> DataFrame:
    """Incoming blocks replace hash, parent, time and status of stored ones, which keep created_at; the last by order wins."""
    new = _first(incoming, ["chain_id", "block_number"], F.col(order).desc())
    old = target.select("chain_id", "block_number", *(F.col(c).alias(f"_{c}") for c in ("block_hash", "parent_hash", "block_timestamp", "status", "created_at")), F.lit(True).alias("_old"))
    joined = new.withColumn("_new", F.lit(True)).join(old, ["chain_id", "block_number"], "full")
    take = lambda c: F.when(F.col("_new"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    return joined.select("chain_id", "block_number", *map(take, ("block_hash", "parent_hash", "block_timestamp", "status")), F.when(F.col("_old"), F.col("_created_at")).otherwise(F.col("created_at")).alias("created_at"))


def insert_transactions(target: DataFrame | None, incoming: DataFrame, order: str = "tx_index", key: list[str] | None = None) -> DataFrame:
    """Incoming transactions whose key isn't stored are added; of several with one key the first by order."""
    key = key or TX_KEY
    new = _first(incoming, key, F.col(order))
    if target is None:
        return new
    return target.unionByName(new.join(target.select(*key), key, "left_anti").select(*target.columns))


def upsert_wallets(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """On the same address and network the incoming standard and updated_at replace the stored ones."""
    key = ["address", "network_type"]
    new = _first(incoming, key, F.col("updated_at").desc(), F.col("standard").desc())
    old = target.withColumnsRenamed({"standard": "_standard", "created_at": "_created", "updated_at": "_updated"})
    joined = new.join(old, key, "full")
    return joined.select(*key, F.coalesce("standard", "_standard").alias("standard"), F.coalesce("_created", "created_at").alias("created_at"), F.coalesce("updated_at", "_updated").alias("updated_at"))


def upsert_cursor(cursors: DataFrame, changes: DataFrame, mode: str = "full") -> DataFrame:
    """mode full: all columns replace; block: height and hash replace, the state stays (scanning if new); reset: the height only, of known chains."""
    new = changes.select("chain_id", *(F.col(c).alias(f"_{c}") for c in changes.columns if c != "chain_id"))
    joined = cursors.join(new, "chain_id", "left" if mode == "reset" else "full")
    has = lambda c: f"_{c}" in new.columns
    pick = lambda c: F.coalesce(f"_{c}", c) if has(c) else F.col(c)
    hash_, state = (F.col("block_hash") if mode == "reset" else pick("block_hash")), (pick("state") if mode == "full" else F.col("state") if mode == "reset" else F.coalesce("state", F.lit("scanning")))
    return joined.select("chain_id", pick("block_number").alias("block_number"), hash_.alias("block_hash"), state.alias("state"), (F.coalesce("created_at", "_updated_at") if has("updated_at") else F.col("created_at")).alias("created_at"), pick("updated_at").alias("updated_at"))


def set_status(df: DataFrame, keys: DataFrame, status: str) -> DataFrame:
    """Rows that match the keys get the status; a transaction's hash matches at every height."""
    marked = keys.distinct().withColumn("_hit", F.lit(True))
    return df.join(marked, keys.columns, "left").withColumn("status", F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("status"))).select(*df.columns)


def spans_hit(df: DataFrame, ranges: DataFrame, width: int = 1000) -> DataFrame:
    """Keys (chain_id, block_number) of df within ranges (chain_id, lo, hi), by equal buckets of heights, not by a nested loop."""
    cut = ranges.filter("lo <= hi").select("chain_id", "lo", "hi", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"hi div {width}"))).alias("_b"))
    keys = df.select("chain_id", "block_number", F.expr(f"block_number div {width}").alias("_b")).distinct()
    return keys.join(cut, ["chain_id", "_b"]).filter("block_number BETWEEN lo AND hi").select("chain_id", "block_number").distinct()


def within(df: DataFrame, ranges: DataFrame, width: int = 1000) -> DataFrame:
    """Rows of df (chain_id, block_number, ...) within ranges (chain_id, lo, hi), by the same buckets; df is read once."""
    cut = ranges.filter("lo <= hi").select(F.col("chain_id").alias("_c"), F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"hi div {width}"))).alias("_b"), "lo", "hi")
    inside = (F.col("chain_id") == F.col("_c")) & (F.expr(f"block_number div {width}") == F.col("_b")) & F.col("block_number").between(F.col("lo"), F.col("hi"))
    return df.join(cut, inside, "left_semi")


def delete_block_range(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Blocks outside all ranges (chain_id, lo, hi), both ends included."""
    return blocks.join(spans_hit(blocks, ranges), ["chain_id", "block_number"], "left_anti").select(*blocks.columns)


def delete_tx_by_block(txs: DataFrame, keys: DataFrame) -> DataFrame:
    return txs.join(keys.select("chain_id", "block_number").distinct(), ["chain_id", "block_number"], "left_anti").select(*txs.columns)


def prune(df: DataFrame, policy: DataFrame, now: int) -> DataFrame:
    """Drops rows older than their chain's retention_seconds before now; 0 or no policy keeps all."""
    kept = df.join(policy.select("chain_id", "retention_seconds"), "chain_id", "left")
    return kept.filter((F.coalesce("retention_seconds", F.lit(0)) == 0) | (F.col("block_timestamp") >= now - F.col("retention_seconds"))).select(*df.columns)


def default_columns(txs: DataFrame) -> DataFrame:
    """Values for empty columns as they are stored."""
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return txs.withColumns({
        "chain_id": F.coalesce(empty("chain_id"), F.lit("unknown")), "block_hash": F.coalesce(empty("block_hash"), F.lit("0x")), "raw_data": F.coalesce(empty("raw_data"), F.lit("null")),
        **{c: empty(c) for c in ("to_address", "value", "token_address", "token_amount")},
    })
