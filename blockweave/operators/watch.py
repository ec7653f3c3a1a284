"""Watch-lists: keeping the transactions that touch watched addresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import written
from .store import TX_KEY

#: Least bits of a Bloom filter, bits for a key, and hashes: about one false hit in a hundred.
BITS, PER_KEY, HASHES = 100_000, 10, 7
#: Bits of the array at most (16 MB) that tells what may be watched.
MOST_BITS = 1 << 27
#: Watched texts of fewer characters aren't looked for within raw data.
LEAST = 30


def watchlist(wallets: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """The set of lower-cased addresses, with some added and some removed."""
    low = lambda df: df.select(F.lower("address").alias("address"))
    out = low(wallets).union(low(add)) if add is not None else low(wallets)
    out = out.distinct()
    return out.join(low(remove).distinct(), "address", "left_anti") if remove is not None else out


def _touching(txs: DataFrame, watched: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Keys of the transactions of which any of the columns is watched: one equal join over all of them, not an OR."""
    sides = txs.select(*TX_KEY, F.explode(F.array_distinct(F.array(*columns.values()))).alias("address"))
    return sides.join(watched, "address", "left_semi").select(*TX_KEY).distinct()


def _grams(text: Column, q: int, of: str = ".") -> Column:
    """All stretches of q characters of a text, each once; of is the class of their characters."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=({of}{{{q}}}))"), F.lit(1)))


def rarest_grams(watched: DataFrame) -> DataFrame:
    """(gram, watched_text): of every watched text of LEAST characters or more, without 0x, the stretch that fewest of them have, as
    long as the shortest of them; of equal ones that of most different characters, then the first by order. Texts of one length are
    their own stretches."""
    plain = watched.filter(F.length("address") >= LEAST).select(F.regexp_replace("address", "^0x", "").alias("watched_text")).distinct()
    q = plain.agg(F.min(F.length("watched_text"))).first()[0] or LEAST
    every = plain.select("watched_text", F.explode(_grams(F.col("watched_text"), q)).alias("gram"))
    common = every.groupBy("gram").agg(F.count("*").alias("n"))
    variety = F.size(F.array_distinct(F.split("gram", "")))
    best = every.join(common, "gram").groupBy("watched_text").agg(F.min(F.struct("n", (-variety).alias("variety"), "gram")).alias("best"))
    return best.select(F.col("best.gram").alias("gram"), "watched_text")


def _bit_array(keys: DataFrame, bits: int) -> DataFrame:
    """One row, words: an array of bits / 64 numbers, with a bit set for each key's hash. Its size is bounded by MOST_BITS."""
    at = F.pmod(F.xxhash64("gram"), F.lit(bits))
    words = keys.select(at.alias("at")).selectExpr("at div 64 AS id", "shiftleft(1L, cast(at % 64 AS int)) AS bit").groupBy("id").agg(F.bit_or("bit").alias("bit"))
    every = keys.sparkSession.range(bits // 64).join(words, "id", "left").select("id", F.coalesce("bit", F.lit(0).cast("long")).alias("bit"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bit"))), lambda x: x["bit"]).alias("_words"))


def possible(keys: DataFrame) -> Callable[[Column], Column]:
    """A test of texts against keys (one column) that lets all keys through and few others, by an array of bits that grows with the
    keys up to MOST_BITS. The array is a scalar subquery: each task has it once, and no row carries it."""
    keys = keys.toDF("gram")
    bits = -(-min(MOST_BITS, max(BITS, 2 * PER_KEY * keys.count())) // 64) * 64
    words = _bit_array(keys, bits).scalar()
    at = lambda g: F.pmod(F.xxhash64(g), F.lit(bits))
    return lambda g: F.coalesce(F.getbit(F.get(words, (at(g) / 64).cast("int")), (at(g) % 64).cast("int")) == 1, F.lit(False))


def may_touch(txs: DataFrame, wallets: DataFrame) -> DataFrame:
    """Transactions of which the sender or the recipient may be watched, in any case: all that are, and few others. No shuffle."""
    may = possible(watchlist(wallets))
    return txs.filter(may(F.lower("from_address")) | may(F.lower("to_address")))


def watch_evm(txs: DataFrame, wallets: DataFrame, raw: bool = True, grams: DataFrame | None = None, cut: Callable[[DataFrame, str], DataFrame] = lambda df, name: written(df, name)[0]) -> DataFrame:
    """Sender or recipient watched in any case, or raw_data of the type ERC20, or a watched text of LEAST characters within raw_data,
    without 0x and in any case.

    Transactions are gone through once: those whose sender, recipient or a stretch of whose raw data may be watched, by an array of
    bits, are candidates. They are written (by cut) and joined with the watch-list and with the stretches of watched texts (grams, see
    rarest_grams), and hold the whole text or not. With longer lists more candidates pass, and none is lost.
    Without raw, raw_data is left out. grams: rarest_grams of the watch-list, where they have been written already.
    """
    watched = watchlist(wallets)
    if not raw:
        return txs.join(_touching(txs, watched, {"from": F.lower("from_address"), "to": F.lower("to_address")}), TX_KEY, "left_semi")
    grams = cut(rarest_grams(watched), "grams") if grams is None else grams
    q, plain = grams.agg(F.min(F.length("gram")), F.bool_and(F.col("gram").rlike("^[0-9a-z]+$"))).first()
    may = possible(watched.select("address").union(grams.select("gram")))
    marked = F.coalesce(F.get_json_object("raw_data", "$.type") == "ERC20", F.lit(False))
    text = F.lower("raw_data")
    stretches = F.posexplode_outer(_grams(text, q or LEAST, "[0-9a-z]" if plain else ".")).alias("_pos", "gram")
    rows = txs.withColumn("_id", F.monotonically_increasing_id()).select("*", stretches)
    near = may(F.col("gram")) | (F.coalesce("_pos", F.lit(0)) == 0) & (may(F.lower("from_address")) | may(F.lower("to_address")) | marked)
    candidates = cut(rows.filter(near).drop("_pos"), "candidates")
    sides = F.explode(F.array_distinct(F.array(F.lower("from_address"), F.lower("to_address")))).alias("address")
    touching = candidates.select("_id", sides).join(watched, "address", "left_semi").select("_id")
    within = candidates.select("_id", text.alias("_text"), "gram").join(grams, "gram").filter(F.col("_text").contains(F.col("watched_text"))).select("_id")
    keys = touching.union(within).distinct().withColumn("_hit", F.lit(True))
    return candidates.dropDuplicates(["_id"]).join(keys, "_id", "left").filter(F.coalesce("_hit", F.lit(False)) | marked).select(*txs.columns)


def watch_tron(txs: DataFrame, wallets: DataFrame) -> DataFrame:
    """Sender or recipient watched, in the same case."""
    return txs.join(_touching(txs, wallets.select("address").distinct(), {"from": F.col("from_address"), "to": F.col("to_address")}), TX_KEY, "left_semi")


def watch_btc(txs: DataFrame, wallets: DataFrame) -> DataFrame:
    """Recipient watched, in the same case."""
    return txs.join(wallets.select(F.col("address").alias("to_address")).distinct(), "to_address", "left_semi").select(*txs.columns)


def watch_sui(txs: DataFrame, wallets: DataFrame) -> DataFrame:
    """Sender watched, else any of the recipients in raw_data (the first of them becomes the recipient), else the recipient."""
    watched = watchlist(wallets)
    listed = txs.select(*TX_KEY, F.posexplode_outer(F.from_json("raw_data", "array<string>")).alias("at", "r"))
    first = listed.join(watched.select(F.col("address").alias("_r")), F.lower("r") == F.col("_r"), "left_semi").groupBy(*TX_KEY).agg(F.min_by("r", "at").alias("_first"))
    mark = lambda n: watched.select(F.col("address").alias(f"_{n}"), F.lit(True).alias(f"_{n}_hit"))
    joined = txs.join(first, TX_KEY, "left").join(mark("s"), F.lower("from_address") == F.col("_s"), "left").join(mark("t"), F.lower("to_address") == F.col("_t"), "left")
    kept = joined.filter(F.col("_s_hit") | F.col("_first").isNotNull() | F.col("_t_hit"))
    to = F.when(F.col("_s_hit").isNull() & F.col("_first").isNotNull(), F.col("_first")).otherwise(F.col("to_address"))
    return kept.withColumn("to_address", to).select(*txs.columns)


def relevant_blocks(txs: DataFrame, wallets: DataFrame) -> DataFrame:
    """(chain_id, block_number, relevant): does any sender or recipient of the block hit the set?"""
    hit = _touching(txs, watchlist(wallets), {"from": F.lower("from_address"), "to": F.lower("to_address")}).select("chain_id", "block_number").distinct().withColumn("_hit", F.lit(True))
    every = txs.select("chain_id", "block_number").distinct()
    return every.join(hit, ["chain_id", "block_number"], "left").select("chain_id", "block_number", F.coalesce("_hit", F.lit(False)).alias("relevant"))


def bloom_build(keys: DataFrame, column: str = "address", bits: int | None = None, hashes: int = HASHES) -> DataFrame:
    """(part, bits, size): a bit set over the lower-cased keys, in parts; without given bits it has PER_KEY for each key."""
    low = keys.select(F.lower(column).alias("key")).distinct()
    size = low.agg(F.greatest(F.lit(BITS), F.lit(PER_KEY) * F.count("*")).alias("size")) if bits is None else keys.sparkSession.range(1).select(F.lit(bits).cast("long").alias("size"))
    at = F.explode(F.array(*(F.pmod(F.xxhash64("key", F.lit(i)), F.col("size")) for i in range(hashes))))
    marked = low.join(F.broadcast(size)).select("size", at.alias("at")).distinct()  # one row
    return marked.groupBy(F.bitmap_bucket_number(F.col("at") + 1).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at") + 1)).alias("bits"), F.first("size").alias("size"))


def bloom_prefilter(df: DataFrame, column: str, bloom: DataFrame, hashes: int = HASHES) -> DataFrame:
    """Rows that may be in the set: none of the set is lost; an empty filter lets all pass. A row's places are joined with the parts."""
    size = bloom.agg(F.max("size").alias("_size"))
    key = F.lower(F.col(column))
    asked = df.select(key.alias("_key")).distinct().join(F.broadcast(size))  # one row
    places = asked.select("_key", "_size", F.explode(F.array(*(F.pmod(F.xxhash64("_key", F.lit(i)), F.col("_size")) + 1 for i in range(hashes)))).alias("_at"))
    parts = bloom.select(F.col("part").alias("_part"), F.col("bits").alias("_bits"))
    joined = places.withColumn("_part", F.bitmap_bucket_number("_at")).join(parts, "_part", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.expr("bitmap_bit_position(_at) div 8") + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.bitmap_bit_position("_at") % 8).cast("int")) == 1, F.lit(False))
    passed = joined.withColumn("_hit", hit).groupBy("_key").agg(F.bool_and(F.col("_hit") | F.col("_size").isNull()).alias("_hit"))
    empty = asked.filter("_size IS NULL").select("_key")
    return df.join(passed.filter("_hit").select("_key").union(empty).distinct(), key == F.col("_key"), "left_semi")


def filter_stats(txs: DataFrame, matched: DataFrame) -> DataFrame:
    """Per chain: transactions that matched and that were left out."""
    n = txs.groupBy("chain_id").agg(F.count("*").alias("n"))
    m = matched.groupBy("chain_id").agg(F.count("*").alias("m"))
    return n.join(m, "chain_id", "left").select("chain_id", F.coalesce("m", F.lit(0)).alias("n_matched"), (F.col("n") - F.coalesce("m", F.lit(0))).alias("n_filtered"))
