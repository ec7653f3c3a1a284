"""Raw payloads of the four chain families, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVM_BLOCK = "number string, timestamp string, hash string, parentHash string, transactions array<struct<hash string, `from` string, `to` string, value string, gasPrice string, transactionIndex string>>"
EVM_RECEIPT = "chain_id string, transactionHash string, gasUsed string, status string, logs array<struct<address string, topics array<string>, data string>>"
TRON_VALUE = "struct<owner_address string, to_address string, amount bigint, asset_name string, contract_address string, data string>"
TRON_BLOCK = f"blockID string, block_header struct<raw_data struct<number bigint, parentHash string, timestamp bigint>>, transactions array<struct<txID string, raw_data struct<contract array<struct<type string, parameter struct<value {TRON_VALUE}>>>>, ret array<struct<contractRet string>>>>"
TRON_INFO = "chain_id string, id string, fee bigint, receipt struct<energy_usage bigint, energy_fee bigint>, log array<struct<address string, topics array<string>, data string>>"
BTC_BLOCK = "height bigint, hash string, previousblockhash string, time bigint, tx array<struct<txid string, vout array<struct<value decimal(20,8), scriptPubKey struct<address string, addresses array<string>, type string, asm string>>>>>"
SUI_BLOCK = (
    "sequence_number bigint, digest string, summary struct<previous_digest string, timestamp bigint>, transactions array<struct<digest string, transaction struct<sender string, gas_payment struct<price bigint>>, "
    "effects struct<status struct<success boolean>, gas_used struct<computation_cost bigint, storage_cost bigint>, changed_objects array<struct<output_owner struct<kind string, address string>>>>, "
    "balance_changes array<struct<address string, coin_type string, amount string>>>>"
)
#: Family -> schema of its blocks, as landed.
SCHEMAS = {"evm": EVM_BLOCK, "tron": TRON_BLOCK, "bitcoin": BTC_BLOCK, "sui": SUI_BLOCK}


#: The column of landed rows that names their chain, where several chains land together.
KEYED = "chain_id string, "


def schema(family: str, keyed: bool = False) -> T.StructType:
    return T._parse_datatype_string((KEYED if keyed else "") + SCHEMAS[family])


def read_raw(spark: SparkSession, path: str, family: str, keyed: bool = False) -> DataFrame:
    """Landed blocks (JSON lines) of a family; keyed ones name their chain. A block that hasn't landed is an absent row."""
    return spark.read.schema(schema(family, keyed)).json(path)


def stream_raw(spark: SparkSession, path: str, family: str, files: int = 100, keyed: bool = False) -> DataFrame:
    """The same as a stream of files."""
    return spark.readStream.schema(schema(family, keyed)).option("maxFilesPerTrigger", files).json(path)


def with_sequence(sui: DataFrame, cursor: int) -> DataFrame:
    """Checkpoints with sequence 0 or none take the cursor's; has_block tells those with a digest, the others only move the head."""
    number = F.coalesce(F.nullif(F.col("sequence_number"), F.lit(0).cast("long")), F.lit(cursor).cast("long"))
    return sui.withColumn("sequence_number", number).withColumn("has_block", F.coalesce(F.col("digest") != "", F.lit(False)))
