"""Events, cursors, failures, health and RPC analytics as queries, each with the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import flow, ranges, reorg, telemetry, watch
from ..shipping import CODEC, drop_shuffles, shared_dir
from ..sources import raw as sources
from ..sources import tables, units
from ..streaming import jobs
from . import fixtures as fx
from . import payloads as raw
from .queries import MISMATCH, NOW, RELEVANT, more, query

K = "chain_id, tx_hash, block_number"
DEPTH = 40


def _events(s, d):
    return flow.to_events(fx.transactions(s, d))


def _commits(s, d):
    """Blocks as commits in order of their hash; seq by time of the block and height."""
    return fx.blocks(s, d).selectExpr("chain_id", "block_number + CASE WHEN block_number % 37 = 0 THEN 5 ELSE 0 END AS seq", "block_number", "block_hash")


def _timed(s, d):
    return fx.blocks(s, d).selectExpr("chain_id", "block_number", "block_timestamp AS ts")


def _samples(s, d):
    """Lag samples from the call log: one a chain and quarter of an hour, which stand for minutes."""
    at = F.expr("ts div 900 * 60").alias("ts")
    return fx.rpc_calls(s, d).groupBy("chain_id", at).agg(F.max(F.col("event_id") % 40 * 60).alias("lag"))


SAMPLES = "samples AS (SELECT chain_id, ts // 900 * 60 AS ts, max(event_id % 40 * 60) AS lag FROM rpc_calls GROUP BY ALL)"


def _available(s, d):
    return fx.heads(s, d).selectExpr("chain_id", "chain_id <> 'chain_2' AS available")


# 2.8 events and cursors


@query(f"SELECT {K}, 'transaction_confirmed' AS event_type, from_address, to_address, 'native' AS tx_type, value FROM transactions", "transactions")
def to_events(s, d):
    return _events(s, d).select("chain_id", "tx_hash", "block_number", "event_type", "from_address", "to_address", F.col("metadata")["tx_type"].alias("tx_type"), F.col("metadata")["value"].alias("value"))


@query(f"SELECT {K}, head >= {DEPTH} AND block_number <= head - {DEPTH} AS final FROM transactions JOIN heads USING (chain_id)", "transactions", "heads")
def finality_batch(s, d):
    done, rest = flow.finality_batch(_events(s, d), fx.heads(s, d), DEPTH)
    return done.withColumn("final", F.lit(True)).unionByName(rest.withColumn("final", F.lit(False))).select("chain_id", "tx_hash", "block_number", "final")


PENDING = f"pending AS (SELECT t.* FROM transactions t JOIN heads USING (chain_id) WHERE NOT (head >= {DEPTH} AND block_number <= head - {DEPTH}))"


@more(PENDING, f"SELECT {K} FROM pending WHERE block_number % 2 = 1", "transactions", "heads")
def finality_discard(s, d):
    _, rest = flow.finality_batch(_events(s, d), fx.heads(s, d), DEPTH)
    return flow.finality_discard(rest, fx.blocks(s, d).filter("block_number % 2 = 0")).select("chain_id", "tx_hash", "block_number")


@more(PENDING, "SELECT chain_id, block_number, count(*) AS n_pending FROM pending GROUP BY ALL", "transactions", "heads")
def pending_by_block(s, d):
    return flow.pending_by_block(flow.finality_batch(_events(s, d), fx.heads(s, d), DEPTH)[1])


@query("SELECT chain_id, head FROM heads", "heads")
def chain_head(s, d):
    return flow.chain_head(fx.blocks(s, d))


@query("SELECT chain_id, block_number, block_hash FROM blocks JOIN heads USING (chain_id) WHERE block_number >= head - 100", "heads")
def recent_buffer(s, d):
    return flow.recent_buffer(fx.blocks(s, d)).select("chain_id", "block_number", "block_hash")


FOLD = """commits AS (SELECT chain_id, block_number + CASE WHEN block_number % 37 = 0 THEN 5 ELSE 0 END AS seq, block_number, block_hash FROM blocks),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY seq, block_number) AS i FROM commits),
    fold AS (SELECT h.chain_id, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BIGINT AS block_number, NULL::VARCHAR AS outcome, CASE WHEN c.chain_id IS NOT NULL AND c.chain_id <> 'chain_3' THEN 3 END::BIGINT AS pos, CASE WHEN c.chain_id IS NOT NULL AND c.chain_id <> 'chain_3' THEN md5(h.chain_id || ':3') END AS hsh FROM heads h LEFT JOIN cursors c USING (chain_id)
        UNION ALL SELECT f.chain_id, o.i, o.seq, o.block_number, CASE WHEN f.pos IS NULL THEN 'init' WHEN o.block_number = f.pos THEN CASE WHEN o.block_hash = f.hsh THEN 'duplicate' ELSE 'hash_mismatch' END WHEN o.block_number < f.pos THEN 'stale' WHEN o.block_number = f.pos + 1 THEN 'advance' ELSE 'gap' END,
        CASE WHEN f.pos IS NULL OR o.block_number = f.pos + 1 THEN o.block_number ELSE f.pos END, CASE WHEN f.pos IS NULL OR o.block_number = f.pos + 1 THEN o.block_hash ELSE f.hsh END FROM fold f JOIN ordered o ON o.chain_id = f.chain_id AND o.i = f.i + 1)"""


@more(FOLD, "SELECT chain_id, seq, block_number, outcome, pos AS cursor_block, hsh AS cursor_hash FROM fold WHERE i > 0", "blocks", "cursors")
def cursor_fold(s, d):
    start = fx.cursors(s, d).filter("chain_id <> 'chain_3'").withColumns({"block_number": F.lit(3).cast("long"), "block_hash": F.md5(F.concat("chain_id", F.lit(":3")))})
    return flow.cursor_fold(_commits(s, d), start)


@query("SELECT chain_id, CASE WHEN chain_id = 'chain_2' THEN block_number ELSE head END AS block_number, CASE WHEN chain_id = 'chain_2' THEN block_hash ELSE '' END AS block_hash, CASE WHEN chain_id = 'chain_2' THEN 'paused' ELSE state END AS state, chain_id = 'chain_2' AS refused FROM cursors JOIN heads USING (chain_id)", "cursors")
def cursor_jump(s, d):
    c = fx.cursors(s, d).withColumn("state", F.when(F.col("chain_id") == "chain_2", "paused").otherwise(F.col("state")))
    return flow.cursor_jump(c, fx.heads(s, d).withColumnRenamed("head", "to_block"))


@query("SELECT chain_id, greatest(head - 10, 0) AS block_number, '' AS block_hash, 'init' AS state FROM heads WHERE chain_id NOT IN (SELECT chain_id FROM cursors)", "cursors")
def cursor_init(s, d):
    return flow.cursor_init(fx.cursors(s, d), fx.heads(s, d))


PAIRS = ", ".join(f"('{a}', '{b}')" for a, to in flow.TRANSITIONS.items() for b in to)


@query(f"SELECT event_id, chain_id, (from_state, to_state) IN ({PAIRS}) AS valid, from_state || ' -> ' || to_state || CASE WHEN (from_state, to_state) IN ({PAIRS}) THEN '' ELSE ' (invalid)' END AS description FROM transition_log", "transition_log")
def validate_transitions(s, d):
    return flow.validate_transitions(fx.transition_log(s, d)).select("event_id", "chain_id", "valid", "description")


# streams: the given rows are landed as files, streamed and read back


def _folder(s) -> str:
    drop_shuffles(s)
    return f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"


@query("SELECT DISTINCT chain_id, tx_hash, block_number FROM arrivals", "arrivals")
def micro_dedup(s, d):
    """Arrivals as a stream, repeats within the watermark dropped."""
    at = _folder(s)
    fx.arrivals(s, d).selectExpr("chain_id", "tx_hash", "block_number", "timestamp_seconds(block_timestamp) AS seen_at").write.parquet(f"{at}/in")
    stream = s.readStream.schema("chain_id string, tx_hash string, block_number long, seen_at timestamp").parquet(f"{at}/in")
    once = flow.micro_dedup(stream, ["chain_id", "tx_hash", "block_number"], "seen_at")
    once.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{at}/out").select("chain_id", "tx_hash", "block_number")


def _stream_rows(s, d):
    heads = fx.heads(s, d).selectExpr("chain_id", "head AS block_number", "'' AS tx_hash", "'head' AS kind")
    orphans = fx.blocks(s, d).filter("block_number % 10 = 0").selectExpr("chain_id", "block_number", "'' AS tx_hash", "'orphan' AS kind")
    return [fx.transactions(s, d).selectExpr("chain_id", "block_number", "tx_hash", "'event' AS kind"), orphans, heads]


@more("keep AS (SELECT chain_id, block_number FROM blocks WHERE block_number % 10 <> 0)", f"SELECT {K} FROM transactions JOIN heads USING (chain_id) WHERE head >= {DEPTH} AND block_number <= head - {DEPTH} AND block_number % 10 <> 0", "transactions", "heads")
def finality_stream(s, d):
    at = _folder(s)
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    shards = jobs.fitting_shards(fx.heads(s, d))
    for rows in _stream_rows(s, d):
        rows.write.mode("append").option("compression", CODEC).parquet(f"{at}/in")
        stream = s.readStream.schema(jobs.EVENT).parquet(f"{at}/in")
        q = jobs.finality_stream(stream, DEPTH, shards).writeStream.format("parquet").option("compression", CODEC).option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        q.awaitTermination()
    return s.read.parquet(f"{at}/out").select("chain_id", "tx_hash", "block_number")


def _landed(s, d) -> str:
    at = _folder(s)
    raw.evm(s, d).write.option("compression", "gzip").json(f"{at}/raw")
    return at


def _kept(df, at: str):
    """A table that several jobs read, written once."""
    df.write.option("compression", CODEC).parquet(at)
    return df.sparkSession.read.parquet(at)


def _forked(blocks):
    """What a fetcher lands, one after the other: chains whose last block under the head is of a fork, the heads of the main chains,
    and once the reorganisations have been seen both blocks again."""
    number = F.expr("cast(conv(substring(number, 3), 16, 10) AS bigint)")
    parent = F.when(number > 0, F.md5(F.concat("chain_id", F.lit(":"), (number - 1).cast("string")))).otherwise("")
    top = blocks.withColumn("parentHash", parent).withColumn("_n", number)
    heads = top.groupBy("chain_id").agg(F.max("_n").alias("_head"))
    top = top.join(F.broadcast(heads), "chain_id").withColumn("_under", F.col("_head") - F.col("_n"))  # a row a chain
    fork = top.filter("_under = 1").withColumn("hash", F.md5(F.concat(F.lit("fork:"), F.col("hash"))))
    parts = [top.filter("_under > 1").unionByName(fork), top.filter("_under = 0"), top.filter("_under <= 1")]
    return [p.drop("_n", "_head", "_under") for p in parts]


@query(
    "SELECT chain_id, tx_hash, block_number, from_address, to_address, value, CASE WHEN gas_used % 3 <> 0 THEN gas_used END AS gas_used, CASE WHEN gas_used % 3 <> 0 AND status = 'failed' THEN 'failed' ELSE 'success' END AS status FROM transactions WHERE from_address IN (SELECT address FROM watched) OR to_address IN (SELECT address FROM watched)",
    "transactions", "watched",
)
def live_index(s, d):
    """Indexing through reorganisations of every chain, with receipts and the prefilter: what is left is the main chain's."""
    at = _folder(s)
    wallets, receipts = _kept(fx.wallets(s, d), f"{at}/wallets"), _kept(raw.receipts(s, d), f"{at}/receipts")
    first, *later = _forked(_kept(raw.evm(s, d), f"{at}/blocks"))
    later = [_kept(part, f"{at}/later-{k}") for k, part in enumerate(later)]  # the last blocks of each chain
    for part in (first, *later):
        part.write.mode("append").option("compression", "gzip").json(f"{at}/raw")
        tables.delete(s, f"{at}/blocks")  # landed now
        stream = sources.stream_raw(s, f"{at}/raw", "evm", 1000, keyed=True)
        jobs.live_index(stream, "evm", raw.chain(), wallets, f"{at}/out", f"{at}/state", receipts, prefilter=True).awaitTermination()
    rows = units.current(units.read_units(s, f"{at}/out", "transactions"), ["chain_id", "tx_hash", "block_number"])
    return rows.filter("status <> 'invalid'").select("chain_id", "tx_hash", "block_number", "from_address", "to_address", "value", "gas_used", "status")


HOLES = "landed AS (SELECT DISTINCT chain_id, block_number FROM blocks), islands AS (SELECT chain_id, min(block_number) AS lo, max(block_number) AS hi FROM (SELECT *, block_number - row_number() OVER (PARTITION BY chain_id ORDER BY block_number) AS g FROM landed) GROUP BY chain_id, g), cut AS (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY lo) AS k, lag(hi) OVER (PARTITION BY chain_id ORDER BY lo) AS before FROM islands)"


@more(HOLES, "SELECT chain_id, max(hi) FILTER (WHERE k = 1) AS block_number, count(*) FILTER (WHERE k > 1) AS n_holes, coalesce(sum(lo - before - 1) FILTER (WHERE k > 1), 0)::BIGINT AS n_missing FROM cut GROUP BY 1", "blocks")
def live_frontier(s, d):
    """Cursors after landing the blocks with holes, late ones and an empty batch: each waits at the first hole that is left."""
    at, wallets = _folder(s), _kept(fx.wallets(s, d), f"{_folder(s)}/wallets")
    landed = raw.evm(s, d).withColumns({"transactions": F.expr("slice(transactions, 1, 0)"), "_n": F.expr("cast(conv(substring(number, 3), 16, 10) AS bigint)")})
    landed = _kept(landed.withColumn("parentHash", F.expr("md5(chain_id || ':' || (_n - 1))")), f"{at}/blocks")  # one chain without forks
    late = "_n % 7 = 3 OR _n % 50 = 20 AND _n > 0"
    for part in (f"NOT ({late})", "false", late):
        landed.filter(part).drop("_n").write.mode("append").option("compression", "gzip").json(f"{at}/raw")
        stream = sources.stream_raw(s, f"{at}/raw", "evm", 1000, keyed=True)
        jobs.live_index(stream, "evm", raw.chain(), wallets, f"{at}/out", f"{at}/state").awaitTermination()
    done = units.Units(s, f"{at}/out")
    cursors, islands = done.last("cursors"), done.last("islands")
    gaps = jobs.holes(cursors, islands).groupBy("chain_id").agg(F.count("*").alias("n_holes"), F.sum(F.expr("to_block - from_block + 1")).alias("n_missing"))
    return cursors.join(gaps, "chain_id", "left").select("chain_id", "block_number", F.coalesce("n_holes", F.lit(0)).alias("n_holes"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"))


@query("SELECT chain_id, block_number, 'block without height or hash' AS error_msg, CASE WHEN block_number % 14 <> 3 AND block_number % 3 = 0 THEN 1 ELSE 0 END::INT AS retry_count, CASE WHEN block_number % 14 = 3 THEN 'resolved' ELSE 'pending' END AS status FROM blocks WHERE block_number % 7 = 3", "blocks")
def live_retries(s, d):
    """The retry queue of a live job of which every seventh block lands without a hash; half of these land well later, some fail again."""
    at, wallets = _folder(s), _kept(fx.wallets(s, d), f"{_folder(s)}/wallets")
    landed = raw.evm(s, d).withColumns({"transactions": F.expr("slice(transactions, 1, 0)"), "_n": F.expr("cast(conv(substring(number, 3), 16, 10) AS bigint)")})
    landed = _kept(landed.withColumn("parentHash", F.expr("md5(chain_id || ':' || (_n - 1))")), f"{at}/blocks")
    first = landed.withColumn("hash", F.expr("CASE WHEN _n % 7 = 3 THEN '' ELSE hash END"))
    second = landed.filter("_n % 7 = 3 AND (_n % 14 = 3 OR _n % 3 = 0)").withColumn("hash", F.expr("CASE WHEN _n % 14 = 3 THEN hash ELSE '' END"))
    for part in (first, second):
        part.drop("_n").write.mode("append").option("compression", "gzip").json(f"{at}/raw")
        stream = sources.stream_raw(s, f"{at}/raw", "evm", 1000, keyed=True)
        jobs.live_index(stream, "evm", raw.chain(), wallets, f"{at}/out", f"{at}/state").awaitTermination()
    return jobs.retry_queue(s, f"{at}/out").select("chain_id", "block_number", "error_msg", "retry_count", "status")


@query("SELECT block_number, block_hash FROM blocks", "blocks")
def read_raw(s, d):
    from ..operators.normalize import evm_blocks

    return evm_blocks(sources.read_raw(s, f"{_landed(s, d)}/raw", "evm", keyed=True), raw.chain()).select("block_number", "block_hash")


@query("SELECT block_number, block_hash, true AS has_block FROM blocks", "blocks")
def stream_raw(s, d):
    at = _folder(s)
    raw.sui(s, d).write.option("compression", "gzip").json(f"{at}/raw")
    stream = sources.with_sequence(sources.stream_raw(s, f"{at}/raw", "sui", keyed=True), 0)
    stream.selectExpr("sequence_number AS block_number", "digest AS block_hash", "has_block").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{at}/out")


@query(f"SELECT {K} FROM transactions", "transactions")
def sink_transactions(s, d):
    at, t = _folder(s), fx.transactions(s, d)
    for epoch in (0, 1, 1):  # the last is a replay
        units.write_unit(fx.blocks(s, d).filter(f"block_number % 2 = {epoch}"), t.filter(f"block_number % 2 = {epoch}"), fx.cursors(s, d), at, epoch)
    return units.read_units(s, at, "transactions").select("chain_id", "tx_hash", "block_number")


@query("SELECT chain_id, block_number, block_hash FROM blocks", "blocks")
def sink_blocks(s, d):
    at = _folder(s)
    units.write_unit(fx.blocks(s, d), fx.transactions(s, d), fx.cursors(s, d), at, 0)
    return units.read_units(s, at, "blocks").select("chain_id", "block_number", "block_hash")


@query(f"SELECT {K}, 'transaction_confirmed' AS event_type FROM transactions", "transactions")
def sink_events(s, d):
    at = _folder(s)
    units.write_events(_events(s, d), at, 0)
    return s.read.parquet(at).select("chain_id", "tx_hash", "block_number", "event_type")


INSIDE = "hit AS (SELECT DISTINCT b.chain_id, b.block_number FROM blocks b JOIN missing m ON m.chain_id = b.chain_id AND m.status = 'pending' AND b.block_number BETWEEN m.from_block AND m.to_block)"


@more(INSIDE, "SELECT block_number, tx_hash, value FROM hit JOIN transactions USING (chain_id, block_number) WHERE from_address IN (SELECT address FROM watched) OR to_address IN (SELECT address FROM watched)", "blocks", "transactions", "missing", "watched")
def backfill_ingest(s, d):
    return jobs.backfill_ingest(fx.missing(s, d), raw.evm(s, d), "evm", raw.chain(), fx.wallets(s, d))[1].select("block_number", "tx_hash", "value")


@more(INSIDE, "SELECT block_number, tx_hash, value FROM hit JOIN transactions USING (chain_id, block_number)", "blocks", "transactions", "missing")
def rescan_ingest(s, d):
    return jobs.rescan_ingest(fx.missing(s, d).filter("status = 'pending'"), raw.evm(s, d), "evm", raw.chain())[1].select("block_number", "tx_hash", "value")


# The same as jobs that are broken off and go on


DONE = """spans AS (SELECT DISTINCT chain_id, unnest(range(from_block, to_block + 1)) AS h FROM missing WHERE status = 'pending'),
    first AS (SELECT m.id, min(h) FILTER (WHERE b.block_number IS NULL) AS absent FROM missing m JOIN spans s ON s.chain_id = m.chain_id AND h BETWEEN from_block AND to_block LEFT JOIN blocks b ON b.chain_id = s.chain_id AND b.block_number = h WHERE m.status = 'pending' GROUP BY 1)"""


@more(DONE, "SELECT m.id, CASE WHEN m.status = 'pending' AND absent IS NULL THEN 'completed' ELSE m.status END AS status FROM missing m LEFT JOIN first USING (id)", "blocks", "missing")
def backfill_job(s, d):
    """The queue after a backfill that was broken off after its first unit and run again; ranges with an absent height stay pending."""
    at = _folder(s)
    landed = _kept(raw.evm(s, d), f"{at}/raw")
    half = fx.missing(s, d).filter("status = 'pending'").count() // 2 + 1
    run = lambda most: jobs.ingest_ranges(fx.missing(s, d), landed, "evm", raw.chain(), f"{at}/out", NOW, fx.wallets(s, d), per_unit=half, chunk=1, most_units=most)
    run(1)
    return run(None).select("id", "status")


# streams that keep what is near the head


@query("SELECT chain_id, head FROM heads", "heads")
def chain_head_stream(s, d):
    """Heads over a stream in two triggers, the upper blocks first; the last version of each chain."""
    at, b = _folder(s), fx.blocks(s, d).select("chain_id", "block_number")
    for part in (b.filter("block_number % 2 = 0"), b.filter("block_number % 2 = 1")):
        part.write.mode("append").parquet(f"{at}/in")
        jobs.head_stream(s.readStream.schema(b.schema).parquet(f"{at}/in"), f"{at}/out", f"{at}/state").awaitTermination()
    return s.read.parquet(f"{at}/out").groupBy("chain_id").agg(F.max_by("head", "epoch").alias("head"))


@query("SELECT chain_id, block_number, block_hash FROM blocks JOIN heads USING (chain_id) WHERE block_number >= head - 100", "heads")
def recent_buffer_stream(s, d):
    """The buffer over a stream in two triggers."""
    at, b = _folder(s), fx.blocks(s, d).select("chain_id", "block_number", "block_hash")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for part in (b.filter("block_number % 3 = 0"), b.filter("block_number % 3 > 0")):
        part.write.mode("append").parquet(f"{at}/in")
        changes = jobs.recent_stream(s.readStream.schema(b.schema).parquet(f"{at}/in"))
        changes.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return jobs.recent_now(s.read.parquet(f"{at}/out")).select("chain_id", "block_number", "block_hash")


# 2.9 failures

CLASS = "CASE WHEN contains({0}, '-32700') OR contains({0}, '-32600') OR contains({0}, '-32601') OR contains({0}, '-32602') THEN 'fatal' WHEN regexp_matches(lower({0}), '429|403|too many requests|forbidden|quota|plan limit|unauthorized|rate limit|count exceeded') THEN 'failover' ELSE 'retry' END"


@query("SELECT chain_id, block_number, error_msg, status, retry_count FROM failed UNION ALL SELECT chain_id, block_number, 'gone', 'pending', 0::INT FROM incoming", "failed", "incoming")
def record_failures(s, d):
    return flow.record_failures(fx.failed(s, d), fx.incoming(s, d).withColumn("error_msg", F.lit("gone")), NOW).select("chain_id", "block_number", "error_msg", "status", "retry_count")


@query("SELECT chain_id, id, block_number FROM failed WHERE status = 'pending' QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY last_attempt, id) = 1", "failed")
def next_failed(s, d):
    return flow.next_failed(fx.failed(s, d))


@query(f"SELECT id, chain_id, block_number, retry_count, least(2.0 * pow(2, retry_count), 60.0)::DOUBLE AS delay FROM failed WHERE status = 'pending' AND last_attempt + least(2.0 * pow(2, retry_count), 60.0) <= {NOW}", "failed")
def due_retries(s, d):
    return flow.due_retries(fx.failed(s, d), NOW)


@query(f"SELECT id, CASE WHEN id % 3 = 0 THEN 'resolved' ELSE status END AS status, CASE WHEN id % 3 = 1 THEN retry_count + 1 ELSE retry_count END AS retry_count, CASE WHEN id % 3 = 1 THEN {NOW} ELSE last_attempt END AS last_attempt FROM failed", "failed")
def settle_retries(s, d):
    q = fx.failed(s, d)
    return flow.settle_retries(q, q.filter("id % 3 < 2").selectExpr("id", "id % 3 = 0 AS success"), NOW).select("id", "status", "retry_count", "last_attempt")


@query(f"SELECT id, CASE WHEN retry_count >= 5 OR {CLASS.format('error_msg')} = 'fatal' THEN 'stop' ELSE 'retry' END AS verdict FROM failed", "failed")
def retry_verdict(s, d):
    return flow.retry_verdict(fx.failed(s, d))


@query("SELECT id, chain_id, block_number FROM failed WHERE status = 'pending'", "failed")
def pending_failures(s, d):
    return flow.pending_failures(fx.failed(s, d)).select("id", "chain_id", "block_number")


@query("SELECT chain_id, count(*) AS n_failures FROM failed WHERE status = 'pending' GROUP BY 1", "failed")
def count_failures(s, d):
    return flow.count_failures(fx.failed(s, d))


@query(f"SELECT id, created_at FROM failed WHERE created_at > {NOW} - 86400", "failed")
def expire_failures(s, d):
    return flow.expire_failures(fx.failed(s, d), NOW).select("id", "created_at")


@query(f"SELECT {CLASS.format('error_msg')} AS error_class, count(*) AS n_errors FROM rpc_calls WHERE error_msg <> '' GROUP BY 1", "rpc_calls")
def classify_errors(s, d):
    return flow.classify_errors(fx.rpc_calls(s, d))


# 2.10 health

LAG = "lags AS (SELECT h.chain_id, h.head, greatest(h.head - coalesce(c.block_number, 0), 0) AS lag FROM heads h LEFT JOIN cursors c USING (chain_id))"
HEALTH = LAG + """, base AS (SELECT l.chain_id, l.lag, (SELECT count(*) FROM missing m WHERE m.chain_id = l.chain_id AND status = 'pending') AS n_missing, (SELECT count(*) FROM failed f WHERE f.chain_id = l.chain_id AND status = 'pending') AS n_failed, l.chain_id <> 'chain_2' AS available FROM lags l),
    health AS (SELECT *, CASE WHEN NOT available OR lag > 100 OR n_missing > 10 OR n_failed > 50 THEN 'critical' WHEN lag > 10 OR n_missing > 0 OR n_failed > 0 THEN 'degraded' ELSE 'healthy' END AS health FROM base)"""


def _health(s, d):
    return telemetry.chain_health(fx.cursors(s, d), fx.heads(s, d), fx.missing(s, d), fx.failed(s, d), _available(s, d))


@more(LAG, "SELECT * FROM lags", "cursors")
def chain_lag(s, d):
    return telemetry.chain_lag(fx.cursors(s, d), fx.heads(s, d))


@query("SELECT chain_id, round((n - 1) / span, 6) AS blocks_per_second, round(span / (n - 1), 6) AS seconds_per_block FROM (SELECT chain_id, count(*) AS n, max(block_timestamp) - min(block_timestamp) AS span FROM (SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY block_timestamp DESC, block_number DESC) <= 100) GROUP BY 1)", "blocks")
def throughput(s, d):
    return flow.throughput(_timed(s, d))


@query("SELECT chain_id, n, event_id, from_state, to_state, last_reorg FROM (SELECT *, row_number() OVER (PARTITION BY chain_id ORDER BY ts DESC, event_id DESC) AS n, max(CASE WHEN to_state = 'reorg' THEN ts END) OVER (PARTITION BY chain_id) AS last_reorg FROM transition_log) WHERE n <= 10", "transition_log")
def state_history(s, d):
    return flow.state_history(fx.transition_log(s, d))


@more(HEALTH, "SELECT * FROM health", "cursors", "missing", "failed")
def chain_health(s, d):
    return _health(s, d)


@more(HEALTH, "SELECT CASE WHEN bool_or(health = 'critical') THEN 'critical' WHEN bool_or(health = 'degraded') THEN 'degraded' ELSE 'healthy' END AS status FROM health", "cursors", "missing", "failed")
def system_status(s, d):
    return telemetry.system_status(_health(s, d))


@more(SAMPLES + ", s AS (SELECT *, coalesce(lag >= lag(lag) OVER w, true) AS growing, sum((lag <= 1000)::INT) OVER w AS low FROM samples WINDOW w AS (PARTITION BY chain_id ORDER BY ts)), t AS (SELECT *, sum((lag > 1000)::INT) OVER (PARTITION BY chain_id, low ORDER BY ts)::BIGINT AS high FROM s)", "SELECT chain_id, ts, lag, growing, high, lag > 1000 AND (growing OR high >= 3) AS triggered FROM t", "rpc_calls")
def lag_trend(s, d):
    return telemetry.lag_trend(_samples(s, d))


@more(LAG, "SELECT chain_id, lag, least(greatest(CASE WHEN lag <= 0 THEN 12 WHEN lag < 5 THEN 6 WHEN lag < 50 THEN 1 ELSE 0.5 END, 0.5), 60)::DOUBLE AS interval_s, (CASE WHEN lag > 100 THEN 1 WHEN lag <= 0 THEN 1 WHEN lag < 10 THEN 3 WHEN lag < 100 THEN 10 ELSE 20 END)::INT AS batch_size FROM lags", "cursors")
def catchup_plan(s, d):
    lag = telemetry.chain_lag(fx.cursors(s, d), fx.heads(s, d))
    return telemetry.catchup_plan(lag.withColumn("latency_s", F.when(F.col("lag") > 100, 3.0).otherwise(0.5)))


@more(MISMATCH, f"SELECT chain_id, (SELECT count(*) FROM blocks b WHERE b.chain_id = h.chain_id) AS n_blocks, n AS n_transactions, m AS n_matched, (SELECT count(*) FROM broken b WHERE b.chain_id = h.chain_id) AS n_reorgs, (SELECT count(*) FROM cursors c WHERE c.chain_id = h.chain_id AND h.head - c.block_number > 50) AS n_jumps, (SELECT count(*) FROM missing q WHERE q.chain_id = h.chain_id AND status = 'completed') AS n_backfilled, n - m AS n_filtered FROM heads h JOIN (SELECT chain_id, count(*) AS n, count(*) FILTER (WHERE {RELEVANT}) AS m FROM transactions GROUP BY 1) USING (chain_id)", "transactions", "watched", "cursors", "missing")
def counters(s, d):
    b, t = fx.blocks(s, d), fx.transactions(s, d)
    return telemetry.counters(b, t, watch.watch_evm(t, fx.wallets(s, d)), reorg.broken_links(b), ranges.gap_jump(fx.cursors(s, d), fx.heads(s, d), 50)[0], fx.missing(s, d))


LE = "[0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10, NULL]"


@query(f"SELECT provider, le::DOUBLE AS le, count(*) FILTER (WHERE le IS NULL OR x <= le) AS n, round(sum(x), 4) AS total, count(*) AS n_all FROM (SELECT provider, latency_ms / 1000 AS x, unnest({LE}::DOUBLE[]) AS le FROM rpc_calls) GROUP BY ALL", "rpc_calls")
def histogram(s, d):
    return telemetry.histogram(fx.rpc_calls(s, d).withColumn("x", F.col("latency_ms") / 1000), "x", telemetry.BUCKETS["latency_s"], ["provider"])


@query("SELECT chain_id, ts - ts % 3600 AS window_start, round(sum(1.0)::DOUBLE, 4) AS increase, round(count(*) / 3600, 6) AS rate FROM rpc_calls WHERE NOT ok GROUP BY ALL", "rpc_calls")
def rate(s, d):
    return telemetry.increase(fx.rpc_calls(s, d).filter("NOT ok").withColumn("value", F.lit(1.0)), 3600, ["chain_id"])


@query("SELECT chain_id, provider, ts - ts % 86400 AS window_start, count(*) AS increase FROM rpc_calls GROUP BY ALL", "rpc_calls")
def increase(s, d):
    return telemetry.increase(fx.rpc_calls(s, d).withColumn("value", F.lit(1)), 86_400, ["chain_id", "provider"]).drop("rate")


def _alert(limit: int, seconds: int) -> str:
    return f"SELECT chain_id, ts, lag FROM (SELECT *, min(lag) OVER (PARTITION BY chain_id ORDER BY ts RANGE BETWEEN {seconds} PRECEDING AND CURRENT ROW) > {limit} AND min(ts) OVER (PARTITION BY chain_id) <= ts - {seconds} AS fire FROM samples) WHERE fire"


@more(SAMPLES, _alert(100, 300), "rpc_calls")
def alert_lag(s, d):
    return telemetry.alert_lag(_samples(s, d), 100, 300)


@more(SAMPLES, _alert(1000, 120), "rpc_calls")
def alert_critical_lag(s, d):
    return telemetry.alert_lag(_samples(s, d), 1000, 120)


def _states(true: str, labels: str, step: int, hold: int) -> str:
    """Alerts from the evaluations at which a condition is met: stretches of consecutive steps."""
    return f"SELECT {labels}, min(window_end) AS pending_at, CASE WHEN max(window_end) - min(window_end) >= {hold} THEN min(window_end) + {hold} END AS firing_at, max(window_end) + {step} AS resolved_at FROM (SELECT *, window_end // {step} - row_number() OVER (PARTITION BY {labels} ORDER BY window_end) AS island FROM ({true})) GROUP BY {labels}, island"


@query(_states("SELECT chain_id, provider, window_end FROM (SELECT *, ts - ts % 60 + 60 + unnest(range(5)) * 60 AS window_end FROM rpc_calls) GROUP BY ALL HAVING count(*) FILTER (WHERE NOT ok) * 100 > count(*) * 10", "chain_id, provider", 60, 300), "rpc_calls")
def alert_error_rate(s, d):
    """The rule's own figures: over a tenth of the calls in 5 minutes, held for 5, of each provider and chain."""
    return telemetry.alert_error_rate(fx.rpc_calls(s, d))


#: The log's month in 43 minutes: as many reorganisations as the rules' own limits are made for.
FAST = 1000


def _reorgs(s, d):
    return fx.transition_log(s, d).filter("to_state = 'reorg'").selectExpr("chain_id", f"ts div {FAST} AS ts")


def _alert_reorgs(seconds: int, limit: float, hold: int) -> str:
    true = f"SELECT chain_id, window_end FROM (SELECT chain_id, t - t % 60 + 60 + unnest(range({seconds // 60})) * 60 AS window_end FROM (SELECT chain_id, ts // {FAST} AS t FROM transition_log WHERE to_state = 'reorg')) GROUP BY ALL HAVING count(*) > {limit}"
    return _states(true, "chain_id", 60, hold)


@query(_alert_reorgs(3600, 5, 0), "transition_log")
def alert_reorgs(s, d):
    """More than five in an hour."""
    return telemetry.alert_reorgs(_reorgs(s, d))


@query(_alert_reorgs(1800, 180, 600), "transition_log")
def alert_reorg_rate(s, d):
    """The rule over 30 minutes: 0.1 a second, held for 10 minutes."""
    return telemetry.alert_reorg_rate(_reorgs(s, d))


USAGE = "usage AS (SELECT provider, ts // 86400 AS day, count(*) AS used, any_value(daily_limit) AS daily_limit, CASE WHEN any_value(daily_limit) = 0 THEN 999999 ELSE greatest(any_value(daily_limit) - count(*), 0) END AS remaining, CASE WHEN any_value(daily_limit) = 0 THEN 0.0 ELSE round(count(*) * 100.0::DOUBLE / any_value(daily_limit), 4) END AS percent FROM rpc_calls JOIN provider_policy USING (provider) GROUP BY 1, 2)"


def _usage(s, d):
    return telemetry.quota_usage(fx.rpc_calls(s, d), fx.provider_policy(s, d))


@more(USAGE, "SELECT * FROM (SELECT provider, day, remaining, remaining * 100 < daily_limit * 10 AS low_percent, remaining < 1000 AS low_calls FROM usage WHERE daily_limit > 0) WHERE low_percent OR low_calls", "provider_policy")
def alert_quota(s, d):
    return telemetry.alert_quota(_usage(s, d))


@query("SELECT DISTINCT chain_id FROM blocks WHERE chain_id NOT IN (SELECT chain_id FROM rpc_calls WHERE ts BETWEEN 1706600000 AND 1706600300)", "blocks", "rpc_calls")
def alert_stalled(s, d):
    return telemetry.alert_stalled(fx.blocks(s, d), fx.rpc_calls(s, d), 1_706_600_300)


@more(LAG, "SELECT l.chain_id, l.head, coalesce(c.block_number, 0) AS indexed, l.lag, CASE WHEN lag < 10 THEN 'green' WHEN lag < 100 THEN 'yellow' ELSE 'red' END AS lag_band, coalesce(q, 0) AS queue, CASE WHEN coalesce(q, 0) < 100 THEN 'green' WHEN coalesce(q, 0) < 1000 THEN 'yellow' ELSE 'red' END AS queue_band, l.chain_id <> 'chain_2' AS available, coalesce(j, 0) AS jumps_1h FROM lags l LEFT JOIN cursors c USING (chain_id) LEFT JOIN (SELECT chain_id, count(*) AS q FROM missing WHERE status = 'pending' GROUP BY 1) USING (chain_id) LEFT JOIN (SELECT chain_id, count(*) AS j FROM transition_log WHERE to_state = 'catchup' AND ts BETWEEN 1706600000 - 3600 AND 1706600000 GROUP BY 1) USING (chain_id)", "cursors", "missing", "transition_log")
def panel_chain_status(s, d):
    return telemetry.panel_chain_status(fx.cursors(s, d), fx.heads(s, d), fx.missing(s, d), _available(s, d), fx.transition_log(s, d).filter("to_state = 'catchup'"), 1_706_600_000)


@query("SELECT *, error_percent > 5 OR latency_ms > 1000 AS unhealthy FROM (SELECT chain_id, provider, ts - ts % 300 AS window_start, round(avg(latency_ms), 4) AS latency_ms, round(avg((NOT ok)::INT) * 100, 4) AS error_percent, round(count(*) / 300, 6) AS per_second FROM rpc_calls GROUP BY ALL)", "rpc_calls")
def panel_provider_status(s, d):
    return telemetry.panel_provider_status(fx.rpc_calls(s, d))


# 2.11 RPC calls


@more(USAGE, "SELECT * FROM usage", "provider_policy")
def quota_usage(s, d):
    return _usage(s, d)


@query("SELECT provider, ts - ts % 3600 AS hour, count(*) AS n_calls FROM rpc_calls GROUP BY ALL", "rpc_calls")
def calls_this_hour(s, d):
    return telemetry.calls_this_hour(fx.rpc_calls(s, d))


@query("SELECT event_id, provider, n_day, n_slot FROM (SELECT *, row_number() OVER (PARTITION BY provider, ts // 86400 ORDER BY ts, event_id) AS n_day, row_number() OVER (PARTITION BY provider, ts // 60 ORDER BY ts, event_id) AS n_slot FROM rpc_calls JOIN provider_policy USING (provider)) WHERE (daily_limit > 0 AND n_day > daily_limit) OR n_slot > 3", "provider_policy")
def over_limit(s, d):
    return telemetry.over_limit(fx.rpc_calls(s, d), fx.provider_policy(s, d))


@more(USAGE, "SELECT provider || ':' || day AS provider, CASE WHEN percent >= 100 THEN 1800.0 WHEN percent > 90 THEN 2.0 WHEN percent > 75 THEN 0.5 WHEN used % 101 > 95 THEN 60.0 WHEN used % 101 > 80 THEN 0.2 ELSE 0.0 END::DOUBLE AS delay_s FROM usage", "provider_policy")
def throttle_delay(s, d):
    u = _usage(s, d).select(F.concat_ws(":", "provider", "day").alias("provider"), "percent", (F.col("used") % 101).alias("slot_percent"), F.lit(60).alias("interval_seconds"))
    return telemetry.throttle_delay(u, NOW - 1800)


@more(USAGE, "SELECT day, round(sum(used) * 100.0::DOUBLE / sum(daily_limit), 4) AS usage_percent FROM usage WHERE daily_limit > 0 GROUP BY 1", "provider_policy")
def fleet_usage(s, d):
    return telemetry.fleet_usage(_usage(s, d))


@query("SELECT event_id, provider, sum(round(latency_ms * 1000)::BIGINT) OVER w / (1000.0::DOUBLE * count(*) OVER w) AS latency_ms FROM rpc_calls WHERE ok WINDOW w AS (PARTITION BY provider ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)", "rpc_calls")
def rolling_latency(s, d):
    return telemetry.rolling_latency(fx.rpc_calls(s, d))


#: A moment after all calls.
AT = 1_706_659_100


@query(f"SELECT provider, count(*) FILTER (WHERE ts - ts % 60 > {AT} - 3600 AND ts - ts % 60 <= {AT}) AS n_1h, count(*) FILTER (WHERE ts - ts % 60 > {AT} - 86400 AND ts - ts % 60 <= {AT}) AS n_24h FROM rpc_calls GROUP BY 1", "rpc_calls")
def request_counts(s, d):
    return telemetry.request_counts(fx.rpc_calls(s, d), AT)


THROTTLED = "(status_code = 429 OR regexp_matches(lower(error_msg), 'rate limit exceeded|too many requests|daily request count exceeded|project rate limit|monthly quota exceeded'))"


@query(f"SELECT provider, count(*) FILTER (WHERE {THROTTLED}) AS n_429, count(*) FILTER (WHERE status_code = 403) AS n_403, max(CASE WHEN {THROTTLED} OR status_code = 403 THEN ts END) AS last_throttle FROM rpc_calls GROUP BY 1", "rpc_calls")
def detect_throttle(s, d):
    return telemetry.detect_throttle(fx.rpc_calls(s, d))


STATS = f"""lat AS (SELECT provider, avg(latency_ms) AS latency_ms FROM (SELECT * FROM rpc_calls WHERE ok QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ts DESC, event_id DESC) <= 100) GROUP BY 1),
    lastt AS (SELECT provider, ts, status_code = 403 AS is_403 FROM rpc_calls WHERE {THROTTLED} OR status_code = 403 QUALIFY row_number() OVER (PARTITION BY provider ORDER BY ts DESC, event_id DESC) = 1),
    raws AS (SELECT c.provider, count(*) FILTER (WHERE {THROTTLED}) AS n_429, count(*) FILTER (WHERE status_code = 403) AS n_403, count(*) FILTER (WHERE ok AND ts > {AT} - 86400 AND ts <= {AT}) AS requests_24h, avg((NOT ok)::INT) AS error_rate FROM rpc_calls c GROUP BY 1),
    wide AS (SELECT r.*, coalesce(l.latency_ms, 0) AS latency_ms, CASE WHEN daily_limit > 0 THEN daily_limit ELSE 100000 END AS lim, greatest(coalesce(t.ts + CASE WHEN t.is_403 THEN 600 ELSE 60 END - {AT}, 0), 0) AS hold_s FROM raws r LEFT JOIN lat l USING (provider) LEFT JOIN lastt t USING (provider) LEFT JOIN provider_policy p USING (provider)),
    more_ AS (SELECT *, requests_24h * 100.0::DOUBLE / lim AS usage_percent, greatest(lim - requests_24h, 0) AS quota_left FROM wide),
    stats AS (SELECT *, CASE WHEN n_403 > 0 AND hold_s > 0 THEN 'blocked' WHEN n_429 > 5 AND hold_s > 0 THEN 'throttled' WHEN latency_ms > 3000 THEN 'degraded' WHEN usage_percent > 90 THEN 'throttled' ELSE 'healthy' END AS status FROM more_)"""
T = ("provider_policy",)


def _stats(s, d):
    return telemetry.provider_stats(fx.rpc_calls(s, d), fx.provider_policy(s, d), AT)


def _served(s, d):
    return fx.rpc_calls(s, d).select("chain_id", "provider").distinct()


@more(STATS, "SELECT provider, status, round(latency_ms, 4) AS latency_ms, round(usage_percent, 4) AS usage_percent, n_429, n_403 FROM stats", *T)
def provider_status(s, d):
    return telemetry.provider_status(_stats(s, d))


SCORE = "CASE WHEN status = 'blocked' THEN 0 ELSE greatest(100 - (CASE status WHEN 'throttled' THEN 60 WHEN 'degraded' THEN 30 ELSE 0 END + CASE WHEN latency_ms > 3000 THEN 30 WHEN latency_ms > 2000 THEN 20 WHEN latency_ms > 1000 THEN 10 ELSE 0 END + CASE WHEN usage_percent > 90 THEN 30 WHEN usage_percent > 75 THEN 15 WHEN usage_percent > 50 THEN 5 ELSE 0 END + n_429 * 3 + n_403 * 8), 0) END::DOUBLE"


@more(STATS, f"SELECT provider, {SCORE} AS score FROM stats", *T)
def health_score(s, d):
    return telemetry.health_score(_stats(s, d))


@query("SELECT provider, count(*) AS n_requests, count(*) FILTER (WHERE NOT ok) AS n_failures, round(avg(latency_ms), 4) AS latency_ms, round(avg((NOT ok)::INT), 6) AS error_rate, count(*) FILTER (WHERE NOT ok) * 2 <= count(*) AS available FROM rpc_calls GROUP BY 1", "rpc_calls")
def provider_error_rate(s, d):
    return telemetry.provider_error_rate(fx.rpc_calls(s, d))


CIRCUITS = """runs AS (SELECT *, sum(ok::INT) OVER (PARTITION BY provider ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM rpc_calls),
    fails AS (SELECT provider, run, max(ts) AS last_failure_at FROM runs WHERE NOT ok GROUP BY 1, 2),
    opens AS (SELECT provider, run, ts AS opened_at FROM runs WHERE NOT ok AND NOT regexp_matches(lower(error_msg), 'not found|out of range') QUALIFY row_number() OVER (PARTITION BY provider, run ORDER BY ts, event_id) = 5),
    circuits AS (SELECT o.provider, opened_at, last_failure_at, last_failure_at + 60 AS probe_at, r.ts AS closed_at FROM opens o JOIN fails f ON f.provider = o.provider AND f.run = o.run LEFT JOIN runs r ON r.provider = o.provider AND r.run = o.run + 1 AND r.ok)"""


@more(CIRCUITS, "SELECT * FROM circuits", "rpc_calls")
def circuit_events(s, d):
    return telemetry.circuit_events(fx.rpc_calls(s, d))


@more(STATS, "SELECT provider, hold_s AS retry_after_s FROM stats", *T)
def retry_after(s, d):
    return telemetry.retry_after(_stats(s, d))


@more(STATS + ", " + CIRCUITS + f", served AS (SELECT DISTINCT chain_id, provider FROM rpc_calls), u AS (SELECT chain_id, provider, status <> 'blocked' AND provider NOT IN (SELECT provider FROM circuits WHERE closed_at IS NULL AND {AT} BETWEEN opened_at AND probe_at) AS usable, usage_percent < 95 AS has_quota FROM served JOIN stats USING (provider))", "SELECT chain_id, provider, has_quota, usable AND (has_quota OR NOT bool_or(usable AND has_quota) OVER (PARTITION BY chain_id)) AS eligible, bool_or(usable) OVER (PARTITION BY chain_id) AS chain_available FROM u", *T)
def eligible_providers(s, d):
    return telemetry.eligible_providers(_stats(s, d), _served(s, d), telemetry.circuit_events(fx.rpc_calls(s, d)), AT)


@more(STATS, "SELECT provider, score, row_number() OVER (ORDER BY score DESC, provider) AS rank FROM (SELECT provider, round((1 - least(usage_percent / 100, 1.0)) * CASE status WHEN 'healthy' THEN 1.0 WHEN 'degraded' THEN 0.5 ELSE 0.1 END, 6) AS score FROM stats WHERE status <> 'blocked')", *T)
def rank_weighted(s, d):
    return telemetry.rank_weighted(_stats(s, d))


def _ranks(score: str, keep: str, share: int) -> str:
    return f"SELECT provider, score, row_number() OVER (ORDER BY score DESC, provider) AS rank, row_number() OVER (ORDER BY score DESC, provider) <= greatest(1, count(*) OVER () // {share}) AS candidate FROM (SELECT *, round(({score})::DOUBLE, 6) AS score FROM stats) WHERE status <> 'blocked' AND {keep}"


@more(STATS, _ranks("100 - (CASE WHEN usage_percent > 90 THEN 50 WHEN usage_percent > 75 THEN 30 WHEN usage_percent > 50 THEN 10 ELSE 0 END + CASE WHEN latency_ms > 3000 THEN 40 WHEN latency_ms > 1000 THEN 20 WHEN latency_ms > 500 THEN 10 ELSE 0 END + n_429 * 5 + n_403 * 10 + error_rate * 50 + CASE status WHEN 'degraded' THEN 25 WHEN 'throttled' THEN 60 ELSE 0 END)", "score > 0", 5), *T)
def rank_adaptive(s, d):
    return telemetry.rank_adaptive(_stats(s, d))


@more(STATS, _ranks("0.4 * (100 - usage_percent) + 0.3 * (100 - (CASE status WHEN 'throttled' THEN 60 WHEN 'degraded' THEN 30 ELSE 0 END + n_429 * 3 + n_403 * 8)) + 0.3 * least(100, quota_left / 1000)", "usage_percent < 95", 2), *T)
def rank_proactive(s, d):
    return telemetry.rank_proactive(_stats(s, d))


@more(
    STATS + ", served AS (SELECT DISTINCT chain_id, provider FROM rpc_calls), scored AS (SELECT *, CASE WHEN usage_percent >= 95 OR status = 'blocked' THEN 0 ELSE greatest(100 - (CASE WHEN usage_percent >= 75 THEN 50 WHEN usage_percent >= 50 THEN 20 ELSE 0 END + CASE status WHEN 'throttled' THEN 60 WHEN 'degraded' THEN 30 ELSE 0 END + CASE WHEN latency_ms > 2000 THEN 20 ELSE 0 END + n_429 * 5 + n_403 * 10), 0) END::DOUBLE AS score, CASE WHEN usage_percent >= 75 THEN 'high usage' WHEN usage_percent >= 50 THEN 'moderate usage' WHEN status IN ('throttled', 'degraded') THEN status WHEN latency_ms > 2000 THEN 'slow' WHEN n_429 > 0 THEN 'throttled before' WHEN n_403 > 0 THEN 'blocked before' ELSE 'healthy' END AS reason FROM stats)",
    "SELECT chain_id, provider, score, reason FROM served JOIN scored USING (provider) WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY chain_id ORDER BY score DESC, provider) = 1", *T,
)
def rank_coordinated(s, d):
    return telemetry.rank_coordinated(_stats(s, d), _served(s, d))


@more(STATS, f"SELECT provider, round(usage_percent, 4) AS usage_percent FROM stats WHERE usage_percent >= 75 AND provider <> 'p1'", *T)
def rotation_advice(s, d):
    rotations = fx.provider_policy(s, d).filter("provider IN ('p1', 'p2')").selectExpr("provider", f"cast({AT} - CASE WHEN provider = 'p1' THEN 60 ELSE 600 END AS bigint) AS rotated_at")
    return telemetry.rotation_advice(_stats(s, d), rotations, AT)


@more(STATS + ", served AS (SELECT DISTINCT chain_id, provider FROM rpc_calls)", f"SELECT chain_id, provider, quota_left, {SCORE} AS score, round(usage_percent / 100, 6) AS usage_ratio, round(latency_ms / 1000, 6) AS latency_s, bool_or(status <> 'blocked') OVER (PARTITION BY chain_id) AS chain_available FROM served JOIN stats USING (provider)", *T)
def provider_gauges(s, d):
    return telemetry.provider_gauges(_stats(s, d), _served(s, d))
