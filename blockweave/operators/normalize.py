"""Raw blocks of the four families as common blocks and transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import hex_decimal, hex_long
from .watch import possible

#: The Transfer topic of ERC-20 logs, the call of a TRC-20 transfer, energy's price in SUN, the native coin of Sui.
TRANSFER = "0xddf252ad1be2c89b69c2b068fc378daa952ba7f163c4a11628f55a4df523b3ef"
TRC20_CALL = "a9059cbb"
ENERGY_PRICE = 420
SUI_COIN = "0x2::sui::SUI"
TX_COLUMNS = ["chain_id", "tx_hash", "block_number", "block_hash", "tx_index", "from_address", "to_address", "value", "tx_type", "token_address", "token_amount", "gas_used", "gas_price", "status", "block_timestamp", "raw_data"]

#: Types of the columns that aren't text.
KINDS = {"block_number": "long", "tx_index": "int", "gas_used": "long", "block_timestamp": "long"}


def _tx(df: DataFrame, **columns: Column) -> DataFrame:
    """The common shape; what isn't given is null."""
    return df.select(*(columns.get(c, F.lit(None)).cast(KINDS.get(c, "string")).alias(c) for c in TX_COLUMNS))


def _own() -> Column:
    """Joins a transaction with its row (_c, _h). The hash comes first: it is what tells rows apart when they are sorted."""
    return (F.col("tx_hash") == F.col("_h")) & (F.col("chain_id") == F.col("_c"))


def _chain(chain: str | Column) -> Column:
    """The chain's name, or the column of raw rows that has it."""
    return chain if isinstance(chain, Column) else F.lit(chain)


def _block(df: DataFrame, chain: str | Column, number: Column, hash_: Column, parent: Column, time: Column, status: str) -> DataFrame:
    return df.select(_chain(chain).alias("chain_id"), number.alias("block_number"), hash_.alias("block_hash"), F.coalesce(parent, F.lit("")).alias("parent_hash"), time.alias("block_timestamp"), F.lit(status).alias("status"))


def evm_blocks(raw: DataFrame, chain: str | Column) -> DataFrame:
    return _block(raw, chain, hex_long(F.col("number")), F.col("hash"), F.col("parentHash"), hex_long(F.col("timestamp")), "processed")


def evm_transactions(raw: DataFrame, chain: str | Column) -> DataFrame:
    b = raw.select(_chain(chain).alias("chain_id"), hex_long(F.col("number")).alias("number"), "hash", hex_long(F.col("timestamp")).alias("timestamp"), "transactions")
    t = b.select("chain_id", "number", "hash", "timestamp", F.posexplode("transactions").alias("at", "t"))
    return _tx(t, chain_id=F.col("chain_id"), tx_hash=F.col("t.hash"), block_number=F.col("number"), block_hash=F.col("hash"), tx_index=F.coalesce(hex_long(F.col("t.transactionIndex")), F.col("at")), from_address=F.lower("t.from"), to_address=F.lower(F.coalesce("t.to", F.lit(""))), value=hex_decimal(F.col("t.value")), tx_type=F.lit("native"), gas_price=hex_decimal(F.col("t.gasPrice")), status=F.lit("success"), block_timestamp=F.col("timestamp"), raw_data=F.to_json("t"))


def evm_enrich(txs: DataFrame, receipts: DataFrame) -> DataFrame:
    """gas_used of the receipt, and failed where its status is 0x0; without a receipt a row stays."""
    r = receipts.select(F.col("chain_id").alias("_c"), F.col("transactionHash").alias("_h"), hex_long(F.col("gasUsed")).alias("_gas"), F.col("status").alias("_status"))
    joined = txs.join(r, _own(), "left")
    return joined.withColumns({"gas_used": F.coalesce("_gas", "gas_used"), "status": F.when(F.col("_status") == "0x0", F.lit("failed")).otherwise(F.col("status"))}).select(*txs.columns)


def evm_erc20_transfers(receipts: DataFrame, wallets: DataFrame) -> DataFrame:
    """(chain_id, tx_hash, log_index, token, from_address, to_address, amount) of transfer logs that touch a watched address or contract."""
    logs = receipts.select("chain_id", F.col("transactionHash").alias("tx_hash"), F.posexplode("logs").alias("log_index", "l")).filter((F.size("l.topics") >= 3) & (F.lower(F.get("l.topics", F.lit(0))) == TRANSFER))
    address = lambda i: F.concat(F.lit("0x"), F.lower(F.right(F.get("l.topics", F.lit(i)), F.lit(40))))
    rows = logs.select("chain_id", "tx_hash", "log_index", F.lower("l.address").alias("token"), address(1).alias("from_address"), address(2).alias("to_address"), hex_decimal(F.col("l.data")).alias("amount"))
    watched = wallets.select(F.lower("address").alias("_address"), F.lit(True).alias("_hit")).distinct()
    may = possible(watched.select("_address"))
    rows = rows.filter(may(F.col("from_address")) | may(F.col("to_address")) | may(F.col("token")))  # so that few are joined
    for c in ("from_address", "to_address", "token"):
        rows = rows.join(watched.withColumnsRenamed({"_address": f"_{c}", "_hit": f"_hit_{c}"}), F.col(c) == F.col(f"_{c}"), "left")
    hit = F.col("_hit_from_address") | F.col("_hit_to_address") | F.col("_hit_token")
    return rows.filter(hit).select("chain_id", "tx_hash", "log_index", "token", "from_address", "to_address", "amount")


def evm_apply_transfers(txs: DataFrame, transfers: DataFrame) -> DataFrame:
    """The first transfer in log order fills the token columns; a single one also recipient, value and raw_data, several raw_data as a tagged list."""
    one = F.struct("log_index", "token", "from_address", "to_address", "amount")
    found = transfers.groupBy(F.col("chain_id").alias("_c"), F.col("tx_hash").alias("_h")).agg(F.sort_array(F.collect_list(one)).alias("_all"))
    joined = txs.join(found, _own(), "left")
    first, n = F.get("_all", F.lit(0)), F.size("_all")
    has, single = F.col("_all").isNotNull(), F.col("_all").isNotNull() & (n == 1)
    item = lambda t: F.struct(t["token"].alias("token"), t["from_address"].alias("from"), t["to_address"].alias("to"), t["amount"].alias("amount"))
    single_json = F.to_json(F.struct(F.lit("ERC20").alias("type"), *(first[c].alias(a) for c, a in (("token", "token"), ("from_address", "from"), ("to_address", "to"), ("amount", "amount")))))
    many_json = F.to_json(F.struct(F.lit("ERC20_MULTIPLE").alias("type"), F.transform("_all", item).alias("transfers")))
    out = {
        "tx_type": F.when(has, F.lit("erc20")).otherwise(F.col("tx_type")), "token_address": F.when(has, first["token"]).otherwise(F.col("token_address")), "token_amount": F.when(has, first["amount"]).otherwise(F.col("token_amount")),
        "to_address": F.when(single, first["to_address"]).otherwise(F.col("to_address")), "value": F.when(single, first["amount"]).otherwise(F.col("value")),
        "raw_data": F.when(single, single_json).when(has, many_json).otherwise(F.col("raw_data")),
    }
    return joined.withColumns(out).select(*txs.columns)


def tron_blocks(raw: DataFrame, chain: str | Column) -> DataFrame:
    h = "block_header.raw_data"
    return _block(raw, chain, F.col(f"{h}.number"), F.col("blockID"), F.col(f"{h}.parentHash"), F.expr(f"{h}.timestamp div 1000"), "pending")


def tron_status(ret: Column) -> Column:
    """No result, or SUCCESS, is success."""
    first = F.get(ret, F.lit(0))["contractRet"]
    return F.when(first.isNull() | first.isin("", "SUCCESS"), F.lit("success")).otherwise(F.lit("failed"))


def tron_transactions(raw: DataFrame, chain: str | Column) -> DataFrame:
    """The first contract of each transaction; those without one are left out."""
    h = "block_header.raw_data"
    t = raw.select(_chain(chain).alias("chain_id"), "blockID", "block_header", F.posexplode("transactions").alias("at", "t")).filter(F.size("t.raw_data.contract") > 0)
    t = t.withColumn("c", F.get("t.raw_data.contract", F.lit(0))).withColumn("v", F.col("c.parameter.value"))
    kind, data = F.col("c.type"), F.coalesce(F.col("v.data"), F.lit(""))
    transfer, asset = kind == "TransferContract", kind == "TransferAssetContract"
    trc20 = (kind == "TriggerSmartContract") & data.startswith(TRC20_CALL) & (F.length(data) >= 136)
    amount = F.when(trc20, hex_decimal(F.substring(data, 73, 64)))
    return _tx(
        t, chain_id=F.col("chain_id"), tx_hash=F.col("t.txID"), block_number=F.col(f"{h}.number"), block_hash=F.col("blockID"), tx_index=F.col("at"), from_address=F.col("v.owner_address"),
        to_address=F.when(transfer | asset, F.col("v.to_address")).otherwise(F.col("v.contract_address")), value=F.when(transfer | asset, F.col("v.amount").cast("string")).otherwise(F.coalesce(amount, F.lit("0"))),
        tx_type=F.when(transfer, "native").when(asset, "trc10").when(trc20, "trc20").otherwise("contract_call"), token_address=F.when(asset, F.col("v.asset_name")).when(trc20, F.col("v.contract_address")),
        token_amount=F.when(asset, F.col("v.amount").cast("string")).when(trc20, amount), status=tron_status(F.col("t.ret")), block_timestamp=F.expr(f"{h}.timestamp div 1000"), raw_data=F.to_json("t"),
    )


def tron_enrich(txs: DataFrame, infos: DataFrame) -> DataFrame:
    gas = F.coalesce("receipt.energy_usage", F.lit(0)) + F.expr(f"coalesce(receipt.energy_fee, 0) div {ENERGY_PRICE}")
    i = infos.select(F.col("chain_id").alias("_c"), F.col("id").alias("_h"), F.col("fee").alias("_fee"), gas.alias("_gas"))
    joined = txs.join(i, _own(), "left")
    return joined.withColumns({"gas_price": F.coalesce(F.col("_fee").cast("string"), "gas_price"), "gas_used": F.coalesce("_gas", "gas_used")}).select(*txs.columns)


def tron_logs(infos: DataFrame) -> DataFrame:
    return infos.select("chain_id", F.col("id").alias("tx_hash"), F.posexplode("log").alias("log_index", "l")).select("chain_id", "tx_hash", "log_index", "l.address", "l.topics", "l.data")


def btc_blocks(raw: DataFrame, chain: str | Column) -> DataFrame:
    return _block(raw, chain, F.col("height"), F.col("hash"), F.col("previousblockhash"), F.col("time"), "pending")


def btc_outputs(raw: DataFrame, chain: str | Column) -> DataFrame:
    """A row per output with an address, its own or the first of several; amounts in satoshi."""
    t = raw.select(_chain(chain).alias("chain_id"), "height", "hash", "time", F.posexplode("tx").alias("at", "t"))
    o = t.select("chain_id", "height", "hash", "time", "at", "t.txid", F.posexplode("t.vout").alias("output_index", "o"))
    o = o.withColumn("address", F.coalesce(F.nullif(F.col("o.scriptPubKey.address"), F.lit("")), F.get("o.scriptPubKey.addresses", F.lit(0)))).filter("address IS NOT NULL AND address <> ''")
    satoshi = (F.col("o.value") * F.lit(100_000_000).cast("decimal(9,0)")).cast("decimal(28,0)").cast("string")
    out = _tx(o.withColumn("satoshi", satoshi), chain_id=F.col("chain_id"), tx_hash=F.col("txid"), block_number=F.col("height"), block_hash=F.col("hash"), tx_index=F.col("at"), from_address=F.lit(""), to_address=F.col("address"), value=F.col("satoshi"), tx_type=F.lit("native"), status=F.lit("success"), block_timestamp=F.col("time"), raw_data=F.to_json(F.struct("output_index")))
    return out.withColumn("output_index", F.get_json_object("raw_data", "$.output_index").cast("int"))


def sui_blocks(raw: DataFrame, chain: str | Column) -> DataFrame:
    return _block(raw, chain, F.col("sequence_number"), F.col("digest"), F.col("summary.previous_digest"), F.col("summary.timestamp"), "processed")


def sui_balance_changes(balance: Column, sender: Column) -> dict[str, Column]:
    """The last change of another coin gives the token; the last change of the sender's native coin gives the value."""
    token = F.element_at(F.filter(balance, lambda b: b["coin_type"] != SUI_COIN), -1)
    own = F.element_at(F.filter(balance, lambda b: (b["coin_type"] == SUI_COIN) & (b["address"] == sender)), -1)
    plain = lambda c: F.regexp_replace(c, "^-", "")
    token = F.when(F.exists(balance, lambda b: b["coin_type"] != SUI_COIN), token)
    own = F.when(F.exists(balance, lambda b: (b["coin_type"] == SUI_COIN) & (b["address"] == sender)), own)
    return {"tx_type": F.when(token.isNotNull(), F.lit("token")).otherwise(F.lit("native")), "token_address": token["coin_type"], "token_amount": plain(token["amount"]), "value": F.coalesce(plain(own["amount"]), F.lit("0"))}


def sui_transactions(raw: DataFrame, chain: str | Column) -> DataFrame:
    t = raw.select(_chain(chain).alias("chain_id"), "sequence_number", "digest", "summary", F.posexplode("transactions").alias("at", "t"))
    owners = F.filter(F.transform(F.coalesce("t.effects.changed_objects", F.array().cast("array<struct<output_owner:struct<kind:string,address:string>>>")), lambda o: o["output_owner"]["address"]), lambda a: a.isNotNull() & (a != "") & (a != F.col("t.transaction.sender")))
    t = t.withColumn("recipients", F.array_distinct(owners)).withColumn("balance", F.coalesce("t.balance_changes", F.array().cast("array<struct<address:string,coin_type:string,amount:string>>")))
    gas = F.col("t.effects.gas_used.computation_cost") + F.col("t.effects.gas_used.storage_cost")
    changes = sui_balance_changes(F.col("balance"), F.col("t.transaction.sender"))
    return _tx(t, chain_id=F.col("chain_id"), tx_hash=F.col("t.digest"), block_number=F.col("sequence_number"), block_hash=F.col("digest"), tx_index=F.col("at"), from_address=F.col("t.transaction.sender"), to_address=F.get("recipients", F.lit(0)), gas_used=gas, gas_price=F.col("t.transaction.gas_payment.price").cast("string"), status=F.when(F.col("t.effects.status.success"), "success").otherwise("failed"), block_timestamp=F.col("summary.timestamp"), raw_data=F.to_json("recipients"), **changes)


#: Family -> its normalisers of blocks and transactions.
NORMALIZERS = {"evm": (evm_blocks, evm_transactions), "tron": (tron_blocks, tron_transactions), "bitcoin": (btc_blocks, btc_outputs), "sui": (sui_blocks, sui_transactions)}
