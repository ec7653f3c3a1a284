"""The operators as queries over the given tables, each with the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import in_place, normalize, ranges, reorg, store, watch
from ..shipping import drop_shuffles, shared_dir
from ..sources import tables
from . import fixtures as fx
from . import payloads as raw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
NOW = fx.NOW


def query(sql: str | None = None, *tables: str):
    """Registers a function under its name, with its SQL over the fixtures' tables."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = fx.sql(sql, *tables)
        return f

    return register


B = "chain_id, block_number, block_hash, parent_hash, block_timestamp, status"
ONE = "chain_id = 'chain_1'"
MISMATCH = "broken AS (SELECT * FROM (SELECT *, lag(block_number) OVER w AS pn, lag(block_hash) OVER w AS ph FROM blocks WINDOW w AS (PARTITION BY chain_id ORDER BY block_number)) WHERE pn = block_number - 1 AND ph <> parent_hash)"
STOPS = f"""{MISMATCH}, links AS (SELECT *, lag(block_number) OVER w AS pn, lag(block_hash) OVER w AS ph FROM blocks WINDOW w AS (PARTITION BY chain_id ORDER BY block_number)),
    stops AS (SELECT chain_id, block_number, last_value(CASE WHEN block_number = 0 THEN {{'k': block_number, 'safe': block_number, 'hash': ''}} WHEN pn IS DISTINCT FROM block_number - 1 THEN {{'k': block_number, 'safe': block_number - 1, 'hash': ''}} WHEN ph = parent_hash THEN {{'k': block_number, 'safe': block_number - 1, 'hash': ph}} END IGNORE NULLS) OVER (PARTITION BY chain_id ORDER BY block_number ROWS UNBOUNDED PRECEDING) AS s FROM links),
    reorgs AS (SELECT b.chain_id, b.block_number, s.s.safe AS safe_block, s.s.hash AS safe_hash, b.block_number - s.s.k AS depth, b.block_number - s.s.k > 100 AS too_deep FROM broken b JOIN stops s ON s.chain_id = b.chain_id AND s.block_number = b.block_number - 1)"""
ORPHANS = STOPS + ", gone AS (SELECT DISTINCT b.chain_id, b.block_number FROM blocks b JOIN reorgs r ON r.chain_id = b.chain_id AND b.block_number BETWEEN r.safe_block + 1 AND r.block_number - 1)"


def _with(extra: str, sql: str, *tables: str) -> str:
    start = fx.sql("SELECT 1", *tables)[: -len(" SELECT 1")]
    return start.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + extra + " " + sql


def more(extra: str, sql: str, *tables: str):
    def register(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = _with(extra, sql, *tables)
        return f

    return register


def _reorgs(s: SparkSession, d: str) -> DataFrame:
    b = fx.blocks(s, d)
    return reorg.safe_point(reorg.broken_links(b), b)


def _keys(s: SparkSession, d: str) -> DataFrame:
    return fx.blocks(s, d).filter("block_number % 50 = 0")


# 2.1 scans


@query(f"SELECT 'chain_1' AS chain_id, n AS block_number, block_hash, parent_hash, block_timestamp, status, created_at FROM (SELECT unnest(range(100, 601))::BIGINT AS n) LEFT JOIN (SELECT * FROM blocks WHERE {ONE}) b ON b.block_number = n", "blocks")
def scan_block_range(s, d):
    return store.scan_block_range(fx.blocks(s, d), "chain_1", 100, 600)


# 2.2 normalisation


def _sorted_sql(columns: str, where: str = "true") -> str:
    return f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, block_number ORDER BY tx_hash) - 1 AS pos FROM transactions) WHERE {where}"


@query(f"SELECT {B} FROM blocks", "blocks")
def evm_blocks(s, d):
    return normalize.evm_blocks(raw.evm(s, d), raw.chain())


EVM = "chain_id", "tx_hash", "block_number", "block_hash", "tx_index", "from_address", "to_address", "value", "tx_type", "gas_price", "status", "block_timestamp"
EVM_SQL = f"SELECT {', '.join(c for c in EVM if c not in ('gas_price', 'status'))}, CASE WHEN tx_index = 7 THEN '0' ELSE '1000000000' END AS gas_price, 'success' AS status FROM transactions"


def _evm_txs(s, d):
    return normalize.evm_transactions(raw.evm(s, d), raw.chain())


@query(EVM_SQL, "transactions")
def evm_transactions(s, d):
    return _evm_txs(s, d).select(*EVM)


@query(f"SELECT tx_hash, block_number, CASE WHEN gas_used % 3 <> 0 THEN gas_used END AS gas_used, CASE WHEN gas_used % 3 <> 0 AND status = 'failed' THEN 'failed' ELSE 'success' END AS status FROM transactions", "transactions")
def evm_enrich(s, d):
    return normalize.evm_enrich(_evm_txs(s, d), raw.receipts(s, d)).select("tx_hash", "block_number", "gas_used", "status")


TRANSFERS = f"SELECT chain_id, tx_hash, unnest(CASE WHEN tx_index = 1 THEN [0, 1] ELSE [0] END)::INT AS log_index, '0xa0' || lpad(tx_index::VARCHAR, 38, '0') AS token, from_address, to_address, value AS amount FROM transactions WHERE gas_used % 3 <> 0 AND (from_address IN (SELECT address FROM watched) OR to_address IN (SELECT address FROM watched))"


@query(TRANSFERS, "transactions", "watched")
def evm_erc20_transfers(s, d):
    return normalize.evm_erc20_transfers(raw.receipts(s, d), fx.wallets(s, d))


@more(
    f"transfers AS ({TRANSFERS}), found AS (SELECT DISTINCT ON (tx_hash) tx_hash, token, amount, count(*) OVER (PARTITION BY tx_hash) AS n, to_address AS t FROM transfers ORDER BY tx_hash, log_index)",
    f"SELECT t.tx_hash, t.block_number, CASE WHEN f.n IS NULL THEN 'native' ELSE 'erc20' END AS tx_type, f.token AS token_address, f.amount AS token_amount, CASE WHEN f.n = 1 THEN f.t ELSE t.to_address END AS to_address, t.value, CASE WHEN f.n > 1 THEN 'many' WHEN f.n = 1 THEN 'one' ELSE 'none' END AS kind FROM (SELECT * FROM transactions ) t LEFT JOIN found f USING (tx_hash)",
    "transactions", "watched",
)
def evm_apply_transfers(s, d):
    out = normalize.evm_apply_transfers(_evm_txs(s, d), normalize.evm_erc20_transfers(raw.receipts(s, d), fx.wallets(s, d)))
    kind = F.when(F.col("raw_data").contains("ERC20_MULTIPLE"), "many").when(F.col("raw_data").contains("ERC20"), "one").otherwise("none")
    return out.select("tx_hash", "block_number", "tx_type", "token_address", "token_amount", "to_address", "value", kind.alias("kind"))


@query(f"SELECT {B.replace('status', '')}'pending' AS status FROM blocks", "blocks")
def tron_blocks(s, d):
    return normalize.tron_blocks(raw.tron(s, d), raw.chain())


TRON = "tx_hash", "block_number", "tx_index", "from_address", "to_address", "value", "tx_type", "token_address", "token_amount", "status"
TRON_SQL = _sorted_sql(
    "tx_hash, block_number, pos::INT AS tx_index, from_address, CASE WHEN tx_index % 4 < 2 THEN to_address ELSE 'contract' || tx_index END AS to_address, CASE WHEN tx_index % 4 < 3 THEN value ELSE '0' END AS value, ['native', 'trc10', 'trc20', 'contract_call'][tx_index % 4 + 1] AS tx_type, CASE tx_index % 4 WHEN 1 THEN '1002000' WHEN 2 THEN 'contract' || tx_index END AS token_address, CASE WHEN tx_index % 4 IN (1, 2) THEN value END AS token_amount, status",
    "tx_index <> 6",
)


@query(TRON_SQL, "transactions")
def tron_transactions(s, d):
    return normalize.tron_transactions(raw.tron(s, d), raw.chain()).select(*TRON)


@query(_sorted_sql("status, count(*) AS n", "tx_index <> 6") + " GROUP BY status", "transactions")
def tron_status(s, d):
    return normalize.tron_transactions(raw.tron(s, d), raw.chain()).groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT tx_hash, block_number, CASE WHEN gas_used % 3 <> 0 THEN (gas_used * 10)::VARCHAR END AS gas_price, CASE WHEN gas_used % 3 <> 0 THEN gas_used + (gas_used * 500) // 420 END AS gas_used FROM transactions WHERE tx_index <> 6", "transactions")
def tron_enrich(s, d):
    return normalize.tron_enrich(normalize.tron_transactions(raw.tron(s, d), raw.chain()), raw.tron_infos(s, d)).select("tx_hash", "block_number", "gas_price", "gas_used")


@query(f"SELECT chain_id, tx_hash, 0::INT AS log_index, 'log' || tx_index AS address, 't1,t2' AS topics, '00' AS data FROM transactions WHERE gas_used % 3 <> 0", "transactions")
def tron_logs(s, d):
    return normalize.tron_logs(raw.tron_infos(s, d)).withColumn("topics", F.array_join("topics", ","))


@query(f"SELECT {B.replace('status', '')}'pending' AS status FROM blocks", "blocks")
def btc_blocks(s, d):
    return normalize.btc_blocks(raw.bitcoin(s, d), raw.chain())


@query(
    _sorted_sql("tx_hash, block_number, pos::INT AS tx_index, CASE tx_index % 3 WHEN 0 THEN '1' || from_address ELSE 'bc' || to_address END AS to_address, (gas_used * 100000)::VARCHAR AS value, 0::INT AS output_index", "tx_index % 3 < 2")
    + " UNION ALL " + _sorted_sql("tx_hash, block_number, pos::INT, 'change', '50000000', 1::INT"), "transactions",
)
def btc_outputs(s, d):
    return normalize.btc_outputs(raw.bitcoin(s, d), raw.chain()).select("tx_hash", "block_number", "tx_index", "to_address", "value", "output_index")


@query(f"SELECT {B} FROM blocks", "blocks")
def sui_blocks(s, d):
    return normalize.sui_blocks(raw.sui(s, d), raw.chain())


@query(_sorted_sql("tx_hash, block_number, pos::INT AS tx_index, from_address, to_address, gas_used + 5 AS gas_used, (tx_index * 10)::VARCHAR AS gas_price, status, '[\"' || to_address || '\"]' AS raw_data"), "transactions")
def sui_transactions(s, d):
    return normalize.sui_transactions(raw.sui(s, d), raw.chain()).select("tx_hash", "block_number", "tx_index", "from_address", "to_address", "gas_used", "gas_price", "status", "raw_data")


@query(_sorted_sql("tx_hash, block_number, CASE WHEN tx_index % 2 = 0 THEN 'native' ELSE 'token' END AS tx_type, CASE WHEN tx_index % 2 = 1 THEN '0xabc::token::T' || tx_index END AS token_address, CASE WHEN tx_index % 2 = 1 THEN value END AS token_amount, gas_used::VARCHAR AS value"), "transactions")
def sui_balance_changes(s, d):
    return normalize.sui_transactions(raw.sui(s, d), raw.chain()).select("tx_hash", "block_number", "tx_type", "token_address", "token_amount", "value")


@query("SELECT tx_hash, block_number, CASE WHEN tx_index = 1 THEN '0x' ELSE block_hash END AS block_hash, CASE WHEN tx_index <> 2 THEN to_address END AS to_address, raw_data FROM transactions", "transactions")
def default_columns(s, d):
    blank = lambda c, i: F.when(F.col("tx_index") == i, F.lit("")).otherwise(F.col(c))
    return store.default_columns(fx.transactions(s, d).withColumns({"block_hash": blank("block_hash", 1), "to_address": blank("to_address", 2)})).select("tx_hash", "block_number", "block_hash", "to_address", "raw_data")


# 2.3 watch-lists


@query("SELECT DISTINCT lower(address) AS address FROM wallets WHERE NOT address LIKE '%7' UNION SELECT '0xnew' AS address", "wallets")
def watchlist(s, d):
    w = fx.wallets(s, d)
    return watch.watchlist(w, s.range(1).select(F.lit("0xNEW").alias("address")), w.filter("address LIKE '%7'"))


K = "chain_id, tx_hash, block_number"


#: What watch_evm keeps, as SQL.
RELEVANT = """coalesce((from_address IN (SELECT address FROM watched) OR to_address IN (SELECT address FROM watched) OR json_extract_string(raw_data, '$.type') = 'ERC20' OR EXISTS (SELECT 1 FROM watched w WHERE length(w.address) >= 30 AND contains(lower(raw_data), regexp_replace(w.address, '^0x', '')))), false)"""


@query(f"SELECT {K} FROM transactions WHERE {RELEVANT}", "transactions", "watched")
def watch_evm(s, d):
    return watch.watch_evm(fx.transactions(s, d), fx.wallets(s, d)).selectExpr(*K.split(", "))


@query(f"SELECT {K} FROM transactions WHERE from_address IN (SELECT address FROM watched) OR to_address IN (SELECT address FROM watched)", "transactions", "watched")
def watch_tron(s, d):
    return watch.watch_tron(fx.transactions(s, d), watch.watchlist(fx.wallets(s, d))).selectExpr(*K.split(", "))


@query(f"SELECT {K} FROM transactions WHERE to_address IN (SELECT address FROM watched)", "transactions", "watched")
def watch_btc(s, d):
    return watch.watch_btc(fx.transactions(s, d), watch.watchlist(fx.wallets(s, d))).selectExpr(*K.split(", "))


@query(f"SELECT {K}, CASE WHEN from_address IN (SELECT address FROM watched) THEN 'x' ELSE to_address END AS to_address FROM transactions WHERE from_address IN (SELECT address FROM watched) OR to_address IN (SELECT address FROM watched)", "transactions", "watched")
def watch_sui(s, d):
    t = fx.transactions(s, d).withColumn("raw_data", F.to_json(F.array(F.lit("nobody"), "to_address"))).withColumn("to_address", F.lit("x"))
    return watch.watch_sui(t, fx.wallets(s, d)).selectExpr(*K.split(", "), "to_address")


@query("SELECT chain_id, block_number, bool_or(from_address IN (SELECT address FROM watched) OR to_address IN (SELECT address FROM watched)) AS relevant FROM transactions GROUP BY 1, 2", "transactions", "watched")
def relevant_blocks(s, d):
    return watch.relevant_blocks(fx.transactions(s, d), fx.wallets(s, d))


@query("SELECT count(DISTINCT address) AS n_keys, count(DISTINCT address) AS n_hits, greatest(100000, 10 * count(DISTINCT address)) AS size, true AS sized FROM watched", "watched")
def bloom_build(s, d):
    """Every key is found again, and between one and seven bits are set for each."""
    low = watch.watchlist(fx.wallets(s, d))
    bloom = watch.bloom_build(fx.wallets(s, d))
    n, hits = low.agg(F.count("*").alias("n_keys")), watch.bloom_prefilter(low, "address", bloom).agg(F.count("*").alias("n_hits"))
    bits = bloom.agg(F.max("size").alias("size"), F.sum(F.bitmap_count("bits")).alias("set"))
    return n.join(hits).join(bits).select("n_keys", "n_hits", "size", F.col("set").between(F.col("n_keys"), 7 * F.col("n_keys")).alias("sized"))


@query("SELECT count(*) FILTER (WHERE from_address IN (SELECT address FROM watched)) AS n_watched, count(*) FILTER (WHERE from_address IN (SELECT address FROM watched)) AS n_kept, true AS few FROM transactions", "transactions", "watched")
def bloom_prefilter(s, d):
    """No watched sender is lost, and few others pass."""
    t, w = fx.transactions(s, d), fx.wallets(s, d)
    passed = watch.bloom_prefilter(t, "from_address", watch.bloom_build(w))
    watched = watch.watchlist(w).withColumnRenamed("address", "from_address")
    n = t.join(watched, "from_address", "left_semi").agg(F.count("*").alias("n_watched"))
    kept = passed.join(watched, "from_address", "left_semi").agg(F.count("*").alias("n_kept"))
    others = passed.join(watched, "from_address", "left_anti").agg(F.count("*").alias("n_others"))
    return n.join(kept).join(others).join(t.agg(F.count("*").alias("n"))).select("n_watched", "n_kept", (F.col("n_others") <= 0.02 * F.col("n")).alias("few"))


@query(f"SELECT chain_id, count(*) FILTER (WHERE hit) AS n_matched, count(*) FILTER (WHERE NOT hit) AS n_filtered FROM (SELECT chain_id, {RELEVANT} AS hit FROM transactions) GROUP BY 1", "transactions", "watched")
def filter_stats(s, d):
    t = fx.transactions(s, d)
    return watch.filter_stats(t, watch.watch_evm(t, fx.wallets(s, d)))


# 2.4 lookups


@query("SELECT * FROM blocks WHERE block_number % 50 = 0", "blocks")
def block_by_number(s, d):
    return store.by_keys(fx.blocks(s, d), _keys(s, d).select("chain_id", "block_number"))


@query("SELECT * FROM blocks WHERE block_number % 50 = 0", "blocks")
def block_by_hash(s, d):
    return store.by_keys(fx.blocks(s, d), _keys(s, d).select("chain_id", "block_hash"))


@query("SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY block_number DESC) = 1", "blocks")
def latest_block(s, d):
    return store.latest_block(fx.blocks(s, d))


@query(f"SELECT {K}, value FROM transactions WHERE tx_hash IN (SELECT tx_hash FROM transactions WHERE gas_used % 40 = 0)", "transactions")
def tx_by_hash(s, d):
    t = fx.transactions(s, d)
    return store.by_keys(t, t.filter("gas_used % 40 = 0").select("tx_hash")).selectExpr(*K.split(", "), "value")


@query(f"SELECT {K}, value FROM transactions WHERE block_number % 50 = 0", "transactions")
def tx_by_block(s, d):
    return store.by_keys(fx.transactions(s, d), _keys(s, d).select("chain_id", "block_number")).selectExpr(*K.split(", "), "value")


@query("SELECT a.address, count(*) FILTER (WHERE a.address = t.from_address) AS n_sent, count(*) FILTER (WHERE a.address = t.to_address) AS n_received, count(*) AS n_transactions FROM watched a JOIN transactions t ON a.address = t.from_address OR a.address = t.to_address GROUP BY 1", "transactions", "watched")
def address_activity(s, d):
    return store.address_activity(fx.transactions(s, d), fx.wallets(s, d))


@query("SELECT chain_id, count(*) AS n_blocks FROM blocks GROUP BY 1", "blocks")
def block_count_by_chain(s, d):
    return store.block_count_by_chain(fx.blocks(s, d))


@query("SELECT * FROM wallets WHERE address LIKE '%7'", "wallets")
def wallet_by_address(s, d):
    w = fx.wallets(s, d)
    return store.by_keys(w, w.filter("address LIKE '%7'").select("address"))


@query("SELECT * FROM wallets", "wallets")
def list_wallets(s, d):
    return fx.wallets(s, d)


@query("SELECT chain_id, block_number, updated_at FROM cursors", "cursors")
def cursor_status(s, d):
    return store.cursor_status(fx.cursors(s, d))


@query("SELECT i.chain_id, i.block_number, coalesce(b.block_hash = i.block_hash, true) AS valid FROM incoming i LEFT JOIN blocks b USING (chain_id, block_number)", "incoming")
def verify_hashes(s, d):
    return store.verify_hashes(fx.blocks(s, d), fx.incoming(s, d))


# 2.5 writes


@query(f"SELECT coalesce(i.chain_id, b.chain_id) AS chain_id, coalesce(i.block_number, b.block_number) AS block_number, coalesce(i.block_hash, b.block_hash) AS block_hash, coalesce(i.parent_hash, b.parent_hash) AS parent_hash, coalesce(i.block_timestamp, b.block_timestamp) AS block_timestamp, coalesce(i.status, b.status) AS status, coalesce(b.created_at, i.created_at) AS created_at FROM blocks b FULL JOIN incoming i ON b.chain_id = i.chain_id AND b.block_number = i.block_number", "incoming")
def upsert_blocks(s, d):
    return store.upsert_blocks(fx.blocks(s, d), fx.incoming(s, d))


@query(f"SELECT {K}, value FROM transactions", "transactions")
def insert_transactions(s, d):
    new = fx.arrivals(s, d)
    early = store.insert_transactions(None, new.filter("block_number < 100"), "arrival")
    return store.insert_transactions(early, new, "arrival").selectExpr(*K.split(", "), "value")


@query("SELECT address, network_type, CASE WHEN address LIKE '%7' THEN 'contract' ELSE standard END AS standard, created_at, CASE WHEN address LIKE '%7' THEN updated_at + 5 ELSE updated_at END AS updated_at FROM wallets", "wallets")
def upsert_wallets(s, d):
    w = fx.wallets(s, d)
    return store.upsert_wallets(w, w.filter("address LIKE '%7'").withColumns({"standard": F.lit("contract"), "created_at": F.col("created_at") + 5, "updated_at": F.col("updated_at") + 5}))


@query(f"SELECT h.chain_id, h.head AS block_number, '' AS block_hash, coalesce(c.state, 'scanning') AS state, coalesce(c.created_at, {NOW}) AS created_at, {NOW}::BIGINT AS updated_at FROM heads h LEFT JOIN cursors c USING (chain_id)", "cursors")
def upsert_cursor(s, d):
    changes = fx.heads(s, d).select("chain_id", F.col("head").alias("block_number"), F.lit("").alias("block_hash"), F.lit(NOW).cast("long").alias("updated_at"))
    return store.upsert_cursor(fx.cursors(s, d), changes, "block")


@query("SELECT chain_id, block_number, CASE WHEN block_number % 50 = 0 THEN 'orphaned' ELSE status END AS status FROM blocks", "blocks")
def set_block_status(s, d):
    return store.set_status(fx.blocks(s, d), _keys(s, d).select("chain_id", "block_number"), "orphaned").select("chain_id", "block_number", "status")


@query(f"SELECT {K}, CASE WHEN tx_hash IN (SELECT tx_hash FROM transactions WHERE gas_used % 40 = 0) THEN 'invalid' ELSE status END AS status FROM transactions", "transactions")
def set_tx_status(s, d):
    t = fx.transactions(s, d)
    return store.set_status(t, t.filter("gas_used % 40 = 0").select("chain_id", "tx_hash"), "invalid").selectExpr(*K.split(", "), "status")


@query("SELECT chain_id, block_number FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.chain_id = b.chain_id AND b.block_number BETWEEN r.from_block AND r.to_block)", "blocks", "ranges")
def delete_block_range(s, d):
    return store.delete_block_range(fx.blocks(s, d), fx.ranges(s, d).selectExpr("chain_id", "from_block AS lo", "to_block AS hi")).select("chain_id", "block_number")


@query(f"SELECT {K} FROM transactions WHERE block_number % 50 <> 0", "transactions")
def delete_tx_by_block(s, d):
    return store.delete_tx_by_block(fx.transactions(s, d), _keys(s, d)).selectExpr(*K.split(", "))



@query("SELECT chain_id, block_number FROM blocks WHERE chain_id IN ('chain_0', 'chain_4') OR block_timestamp >= 900000000 - right(chain_id, 1)::BIGINT * 31536000", "blocks")
def prune(s, d):
    policy = fx.heads(s, d).selectExpr("chain_id", "cast(right(chain_id, 1) AS bigint) * 31536000 AS retention_seconds").filter("chain_id <> 'chain_4'")
    return store.prune(fx.blocks(s, d), policy, 900_000_000).select("chain_id", "block_number")


# the same in place, over tables in buckets of heights


#: Least heights of a bucket of these tables, so that small ones have several; the buckets of large ones are as wide as they need.
BUCKET = 100


def _stored(s, df, heights, **others):
    """A table's folder, and the width of its buckets, which grows with the heights."""
    drop_shuffles(s)
    at, width = f"{shared_dir(s)}/table-{uuid.uuid4().hex}", tables.fitting_width(heights, BUCKET)
    tables.write_table(df, at, width, **others)
    return at, width


def _in_place(function):
    """Registers a query with the SQL of the form that makes a new table."""
    QUERIES[function.__name__] = function
    ORACLES[function.__name__] = ORACLES[function.__name__.removesuffix("_in_place")]
    return function


@_in_place
def upsert_blocks_in_place(s, d):
    b = fx.blocks(s, d)
    at, width = _stored(s, b, b)
    in_place.upsert_blocks(at, fx.incoming(s, d), width=width)
    return tables.read_table(s, at)


@_in_place
def insert_transactions_in_place(s, d):
    new = fx.arrivals(s, d)
    at, width = _stored(s, store.insert_transactions(None, new.filter("block_number < 100"), "arrival"), fx.blocks(s, d))
    in_place.insert_transactions(at, new, "arrival", width=width)
    return tables.read_table(s, at).selectExpr(*K.split(", "), "value")


@_in_place
def set_tx_status_in_place(s, d):
    at, width = _stored(s, fx.transaction_lines(s, d), fx.blocks(s, d), then=lambda rows: fx.lines_as_transactions(rows, *tables.PART))
    in_place.set_status(at, tables.read_table(s, at).filter("gas_used % 40 = 0").select("chain_id", "tx_hash"), "invalid", width)
    return tables.read_table(s, at).selectExpr(*K.split(", "), "status")


@_in_place
def delete_block_range_in_place(s, d):
    b = fx.blocks(s, d)
    at, width = _stored(s, b, b)
    in_place.delete_block_range(at, fx.ranges(s, d).selectExpr("chain_id", "from_block AS lo", "to_block AS hi"), width)
    return tables.read_table(s, at).select("chain_id", "block_number")


@_in_place
def prune_in_place(s, d):
    policy = fx.heads(s, d).selectExpr("chain_id", "cast(right(chain_id, 1) AS bigint) * 31536000 AS retention_seconds").filter("chain_id <> 'chain_4'")
    b = fx.blocks(s, d)
    at, width = _stored(s, b, b)
    in_place.prune(at, policy, 900_000_000, width)
    return tables.read_table(s, at).select("chain_id", "block_number")


# 2.6 gaps and ranges

GAPS = "SELECT chain_id, before + 1 AS from_block, block_number - 1 AS to_block FROM (SELECT chain_id, block_number, lag(block_number) OVER (PARTITION BY chain_id ORDER BY block_number) AS before FROM blocks) WHERE block_number > before + 1"


@query(GAPS, "blocks")
def find_gaps(s, d):
    return ranges.find_gaps(fx.blocks(s, d))


@query("SELECT i.chain_id, c.block_number + 1 AS from_block, i.block_number - 1 AS to_block FROM incoming i JOIN cursors c USING (chain_id) WHERE i.block_number > c.block_number + 1", "incoming", "cursors")
def cursor_gaps(s, d):
    return ranges.cursor_gaps(fx.incoming(s, d), fx.cursors(s, d))


@query(f"SELECT chain_id, from_block, to_block, status, priority FROM missing UNION ALL SELECT chain_id, from_block, to_block, 'pending', 1::INT FROM ({GAPS})", "missing", "blocks")
def queue_gaps(s, d):
    return ranges.queue_gaps(fx.missing(s, d), ranges.find_gaps(fx.blocks(s, d)), 1, NOW).select("chain_id", "from_block", "to_block", "status", "priority")


@query("SELECT c.chain_id, c.block_number + 1 AS from_block, h.head AS to_block, h.head AS cursor_block FROM cursors c JOIN heads h USING (chain_id) WHERE h.head - c.block_number > 50", "cursors")
def gap_jump(s, d):
    queued, moved = ranges.gap_jump(fx.cursors(s, d), fx.heads(s, d), 50)
    return queued.join(moved.selectExpr("chain_id", "block_number AS cursor_block"), "chain_id")


@query("SELECT chain_id, unnest(range(from_block, to_block + 1)) AS block_number FROM ranges", "ranges")
def expand_ranges(s, d):
    return ranges.expand_ranges(fx.ranges(s, d))


@query("SELECT text, CASE WHEN k <> 1 AND k <> 2 THEN a END AS from_block, CASE WHEN k <> 1 AND k <> 2 THEN b END AS to_block, CASE k WHEN 1 THEN 'invalid range' WHEN 2 THEN 'start after end' END AS error FROM (SELECT from_block AS a, to_block + 1 AS b, from_block % 5 AS k, CASE from_block % 5 WHEN 1 THEN from_block || '-' || (to_block + 1) || 'x' WHEN 2 THEN (to_block + 1) || '-' || from_block ELSE from_block || '-' || (to_block + 1) END AS text FROM ranges)", "ranges")
def parse_ranges(s, d):
    text = "CASE from_block % 5 WHEN 1 THEN from_block || '-' || (to_block + 1) || 'x' WHEN 2 THEN (to_block + 1) || '-' || from_block ELSE from_block || '-' || (to_block + 1) END AS text"
    return ranges.parse_ranges(fx.ranges(s, d).selectExpr(text), "text")


MERGED = "SELECT chain_id, min(from_block) AS from_block, max(to_block) AS to_block FROM (SELECT *, sum(new) OVER (PARTITION BY chain_id ORDER BY from_block, to_block) AS island FROM (SELECT *, CASE WHEN from_block > max(to_block) OVER (PARTITION BY chain_id ORDER BY from_block, to_block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS new FROM ranges)) GROUP BY chain_id, island"


@query(MERGED, "ranges")
def merge_ranges(s, d):
    return ranges.merge_ranges(fx.ranges(s, d))


@query("SELECT chain_id, a AS from_block, least(a + 2, to_block) AS to_block FROM (SELECT chain_id, to_block, unnest(range(from_block, to_block + 1, 3)) AS a FROM ranges)", "ranges")
def split_ranges(s, d):
    return ranges.split_ranges(fx.ranges(s, d), 3)


@query("SELECT chain_id, CASE WHEN from_block % 2 = 0 THEN from_block + 3 ELSE from_block END AS from_block, to_block FROM ranges WHERE from_block % 2 = 1 OR from_block + 3 <= to_block", "ranges")
def remaining_ranges(s, d):
    r = fx.ranges(s, d)
    return ranges.remaining_ranges(r, r.filter("from_block % 2 = 0").selectExpr("chain_id", "from_block", "from_block + 2 AS done"))


@query("SELECT chain_id, id, from_block, to_block FROM missing WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY from_block, id) = 1", "missing")
def next_range(s, d):
    return ranges.next_range(fx.missing(s, d))


@query("SELECT chain_id, id, from_block, to_block FROM missing WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY from_block, id) <= 1000", "missing")
def pending_ranges(s, d):
    return ranges.pending_ranges(fx.missing(s, d))


@query("SELECT chain_id, count(*) AS n_pending FROM missing WHERE status = 'pending' GROUP BY 1", "missing")
def count_pending_ranges(s, d):
    return ranges.count_pending_ranges(fx.missing(s, d))


@query(f"SELECT id, CASE WHEN id % 10 = 3 THEN 'failed' ELSE status END AS status, CASE WHEN id % 10 = 3 THEN 'bad' ELSE error_msg END AS error_msg, CASE WHEN id % 10 = 3 THEN {NOW} ELSE updated_at END AS updated_at FROM missing", "missing")
def mark_ranges(s, d):
    q = fx.missing(s, d)
    return ranges.mark_ranges(q, q.filter("id % 10 = 3").selectExpr("id", "'failed' AS new_status", "'bad' AS new_error"), NOW).select("id", "status", "error_msg", "updated_at")


@query("SELECT chain_id, count(*) FILTER (WHERE status = 'completed') AS n_processed, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'pending') AS n_pending, max(CASE WHEN status = 'completed' THEN updated_at END) AS last_at FROM missing GROUP BY 1", "missing")
def backfill_stats(s, d):
    return ranges.backfill_stats(fx.missing(s, d))


@query(f"SELECT chain_id, count(*) FILTER (WHERE status = 'pending') AS n_pending, CASE WHEN {NOW} - max(CASE WHEN status = 'completed' THEN updated_at END) < 12 THEN 'spacing' ELSE 'free' END AS gate FROM missing GROUP BY 1 HAVING count(*) FILTER (WHERE status = 'pending') > 0", "missing")
def backfill_gate(s, d):
    return ranges.backfill_gate(fx.missing(s, d), s.range(1).select(F.lit(20.0).alias("usage_percent")), NOW)


# 2.7 reorganisations


@query("SELECT i.chain_id, i.block_number, CASE WHEN i.block_number = 0 THEN 'genesis' WHEN b.block_hash IS NULL THEN 'absent' WHEN b.block_hash = i.parent_hash THEN 'match' ELSE 'mismatch' END AS verdict FROM incoming i LEFT JOIN blocks b ON b.chain_id = i.chain_id AND b.block_number = i.block_number - 1", "incoming")
def check_parent_hash(s, d):
    return reorg.check_parent_hash(fx.incoming(s, d), fx.blocks(s, d))


@more(MISMATCH, "SELECT chain_id, block_number, parent_hash, ph AS expected FROM broken", "blocks")
def broken_links(s, d):
    return reorg.broken_links(fx.blocks(s, d))


@more(STOPS, "SELECT * FROM reorgs", "blocks")
def safe_point(s, d):
    return _reorgs(s, d)


@more(ORPHANS, "SELECT g.chain_id, count(DISTINCT g.block_number) AS n_blocks, count(t.tx_hash) AS n_transactions, min(c.block_number) AS cursor_block, min(c.state) AS state FROM gone g LEFT JOIN transactions t USING (chain_id, block_number) LEFT JOIN (SELECT chain_id, min(safe_block) AS block_number, 'scanning' AS state FROM reorgs JOIN cursors USING (chain_id) GROUP BY 1) c USING (chain_id) GROUP BY 1", "transactions", "blocks", "cursors")
def reorg_rollback(s, d):
    _, _, c, counts = reorg.reorg_rollback(_reorgs(s, d), fx.blocks(s, d), fx.transactions(s, d), fx.cursors(s, d))
    return counts.join(c.selectExpr("chain_id", "block_number AS cursor_block", "state"), "chain_id", "left")


@more(ORPHANS, "SELECT chain_id, block_number, tx_hash, 'transaction_reverted' AS event_type, 'blockchain_reorganization' AS reason FROM transactions JOIN gone USING (chain_id, block_number)", "transactions", "blocks")
def revert_events(s, d):
    return reorg.revert_events(_reorgs(s, d), fx.blocks(s, d), fx.transactions(s, d))


@more(STOPS, "SELECT r.chain_id, r.block_number, r.safe_block, b.block_number IS NOT NULL AS recoverable FROM reorgs r LEFT JOIN blocks b ON b.chain_id = r.chain_id AND b.block_number = r.safe_block", "blocks")
def can_recover(s, d):
    return reorg.can_recover(_reorgs(s, d), fx.blocks(s, d))
