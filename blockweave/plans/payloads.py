"""Raw payloads of all chains, made from their stored blocks and transactions, read back by their schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import SUI_COIN, TRANSFER, TRC20_CALL
from ..sources.raw import EVM_RECEIPT, TRON_INFO, schema
from . import fixtures as fx

def chain() -> Column:
    """The chain of a payload."""
    return F.col("chain_id")


def _parsed(df: DataFrame, schema_) -> DataFrame:
    """Rows as JSON, parsed once: what is asked of a generator's columns later on isn't pushed below it, to parse each row again."""
    return df.select(F.inline(F.array(F.from_json(F.to_json(F.struct("*")), schema_))))


def _landed(df: DataFrame, family: str) -> DataFrame:
    return _parsed(df, schema(family, keyed=True))


def evm(spark: SparkSession, sf_dir: str) -> DataFrame:
    hex_ = "'0x' || lower(hex({}))"
    item = f"struct(tx_hash AS hash, upper(from_address) AS `from`, to_address AS `to`, {hex_.format('cast(value AS bigint)')} AS value, CASE WHEN tx_index = 7 THEN '0x' ELSE '0x3b9aca00' END AS gasPrice, {hex_.format('tx_index')} AS transactionIndex)"
    return _landed(fx.grouped(spark, sf_dir, item).selectExpr("chain_id", f"{hex_.format('block_number')} AS number", f"{hex_.format('block_timestamp')} AS timestamp", "block_hash AS hash", "parent_hash AS parentHash", "items AS transactions"), "evm")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts of two in three transactions, with one transfer log, or two for the first lines of orders."""
    pad = "'0x' || lpad(substring({}, 3), 64, '0')"
    log = f"struct('0xA0' || lpad(tx_index, 38, '0') AS address, array('{TRANSFER}', {pad.format('from_address')}, {pad.format('to_address')}) AS topics, '0x' || lpad(hex(cast(value AS bigint)), 64, '0') AS data)"
    t = fx.transactions(spark, sf_dir).filter("gas_used % 3 <> 0")
    made = t.selectExpr("chain_id", "tx_hash AS transactionHash", "'0x' || lower(hex(gas_used)) AS gasUsed", "CASE WHEN status = 'failed' THEN '0x0' ELSE '0x1' END AS status", f"CASE WHEN tx_index = 1 THEN array({log}, {log}) ELSE array({log}) END AS logs")
    return _parsed(made, EVM_RECEIPT)


def tron(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = f"CASE WHEN tx_index % 4 = 2 THEN '{TRC20_CALL}' || lpad(substring(to_address, 3), 64, '0') || lpad(hex(cast(value AS bigint)), 64, '0') ELSE 'deadbeef' END"
    value = f"struct(from_address AS owner_address, to_address, cast(value AS bigint) AS amount, '1002000' AS asset_name, 'contract' || tx_index AS contract_address, {data} AS data)"
    kind = "CASE tx_index % 4 WHEN 0 THEN 'TransferContract' WHEN 1 THEN 'TransferAssetContract' ELSE 'TriggerSmartContract' END"
    contract = f"CASE WHEN tx_index = 6 THEN array() ELSE array(struct({kind} AS type, struct({value} AS value) AS parameter)) END"
    item = f"struct(tx_hash AS txID, struct({contract} AS contract) AS raw_data, CASE WHEN status = 'failed' THEN array(struct('REVERT' AS contractRet)) WHEN tx_index = 1 THEN NULL ELSE array(struct('SUCCESS' AS contractRet)) END AS ret)"
    return _landed(fx.grouped(spark, sf_dir, item).selectExpr("chain_id", "block_hash AS blockID", "struct(struct(block_number AS number, parent_hash AS parentHash, block_timestamp * 1000 + 7 AS timestamp) AS raw_data) AS block_header", "items AS transactions"), "tron")


def tron_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fx.transactions(spark, sf_dir).filter("gas_used % 3 <> 0")
    made = t.selectExpr("chain_id", "tx_hash AS id", "gas_used * 10 AS fee", "struct(gas_used AS energy_usage, gas_used * 500 AS energy_fee) AS receipt", "array(struct('log' || tx_index AS address, array('t1', 't2') AS topics, '00' AS data)) AS log")
    return _parsed(made, TRON_INFO)


def bitcoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    script = "CASE tx_index % 3 WHEN 0 THEN struct(cast(NULL AS string) AS address, array('1' || from_address, 'x') AS addresses, 'script' AS type, '' AS asm) WHEN 1 THEN struct('bc' || to_address AS address, array() AS addresses, 'key' AS type, '' AS asm) ELSE struct(cast(NULL AS string) AS address, array() AS addresses, 'nulldata' AS type, 'OP_RETURN' AS asm) END"
    item = f"struct(tx_hash AS txid, array(struct(cast(gas_used AS decimal(20,8)) / 1000 AS value, {script} AS scriptPubKey), struct(cast(0.5 AS decimal(20,8)) AS value, struct('change' AS address, array() AS addresses, 'key' AS type, '' AS asm) AS scriptPubKey)) AS vout)"
    return _landed(fx.grouped(spark, sf_dir, item).selectExpr("chain_id", "block_number AS height", "block_hash AS hash", "nullif(parent_hash, '') AS previousblockhash", "block_timestamp AS time", "items AS tx"), "bitcoin")


def sui(spark: SparkSession, sf_dir: str) -> DataFrame:
    owner = "struct(struct('ADDRESS' AS kind, {} AS address) AS output_owner)"
    change = "struct({} AS address, {} AS coin_type, {} AS amount)"
    native = change.format("from_address", f"'{SUI_COIN}'", "'-' || gas_used")
    token = change.format("to_address", "'0xabc::token::T' || tx_index", "'-' || value")
    item = (
        "struct(tx_hash AS digest, struct(from_address AS sender, struct(tx_index * 10 AS price) AS gas_payment) AS transaction, "
        f"struct(struct(status = 'success' AS success) AS status, struct(gas_used AS computation_cost, 5 AS storage_cost) AS gas_used, array({owner.format('from_address')}, {owner.format('to_address')}, {owner.format('to_address')}) AS changed_objects) AS effects, "
        f"CASE WHEN tx_index % 2 = 0 THEN array({native}) ELSE array({native}, {token}) END AS balance_changes)"
    )
    return _landed(fx.grouped(spark, sf_dir, item).selectExpr("chain_id", "block_number AS sequence_number", "block_hash AS digest", "struct(parent_hash AS previous_digest, block_timestamp AS timestamp) AS summary", "items AS transactions"), "sui")
