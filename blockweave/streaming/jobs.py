"""The live jobs: indexing of landed blocks, and events that wait until they are final."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators import flow, normalize, ranges, reorg, store, watch
from ..operators.heights import BUCKET, running, with_last
from ..operators.store import TX_KEY
from ..shipping import CODEC, drop_shuffles, shared_dir, ship, written
from ..sources import tables, units
from ..sources.units import current, latest_rows, read_units, write_events, write_unit

EVENT = "chain_id string, block_number long, tx_hash string, kind string"
BLOCK_KEY = ["chain_id", "block_number"]
#: What tells stored transactions apart: of the bitcoin family a row is an output, and raw_data has its number.
TX_KEYS = {"bitcoin": [*TX_KEY, "raw_data"]}
BLOCKS = "chain_id string, block_number long, block_hash string, parent_hash string, block_timestamp long, status string, created_at long"
TRANSACTIONS = ", ".join(f"{c} {normalize.KINDS.get(c, 'string')}" for c in normalize.TX_COLUMNS)
#: The states of a cursor that blocks don't move.
STOPPED = "state IN ('paused', 'reorg')"
#: Stretches that have landed above a chain's cursor; states asked for; the epoch up to which a chain's held rows have been taken in.
ISLANDS = "chain_id string, from_block long, block_number long, block_hash string"
REQUESTS = "chain_id string, state string, at long"
RELEASES = "chain_id string, since long"
CURSORS = "chain_id string, block_number long, block_hash string, state string, created_at long, updated_at long"
MATCHERS = {"evm": watch.watch_evm, "tron": watch.watch_tron, "bitcoin": watch.watch_btc, "sui": watch.watch_sui}
#: Keys that a chain's waiting events are spread over, and heights whose waiting events are one entry of the state.
SHARDS, STRETCH = 16, 256
#: Rows of a key that are held before they go into the state, stretches of a key that a table's heights should not much exceed, and
#: the waiting events of a stretch.
TAKEN, STRETCHES, WAITING = 100_000, 128, pa.schema([("block_number", pa.int64()), ("tx_hash", pa.string())])


class Finality(StatefulProcessor):
    """Per chain and shard: events wait by stretch of heights until a head is deep enough above them; an orphaned block's events go.
    Repeats count once. A key's stretches lie step apart. The state is asked and changed once for each stretch that TAKEN rows of a
    batch touch, not for each block, and a stretch is one compressed value, not a list of texts to convert one by one."""

    def __init__(self, depth: int, step: int = 1):
        self.depth, self.step = depth, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "stretch long", "events binary")
        #: The head, and a stretch that no waiting event is under.
        self.heights = handle.getValueState("heights", "head long, low long")

    def _get(self, stretch: int) -> pa.Table:
        if not self.waiting.containsKey((stretch,)):
            return WAITING.empty_table()
        return pa.ipc.open_stream(self.waiting.getValue((stretch,))[0]).read_all()

    def _put(self, stretch: int, rows: pa.Table) -> None:
        if len(rows):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, WAITING, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(rows)
            self.waiting.updateValue((stretch,), (out.getvalue().to_pybytes(),))
        elif self.waiting.containsKey((stretch,)):
            self.waiting.removeKey((stretch,))

    def _reached(self, low: int, high: int) -> list[int]:
        """Stretches with waiting events up to high: asked for one by one from low on, or the whole map where that is shorter."""
        if (high - low) // self.step <= 10_000:
            return [n for n in range(low, high + 1, self.step) if self.waiting.containsKey((n,))]
        return sorted(k[0] for k in self.waiting.keys() if k[0] <= high)

    def _take(self, pdf: pd.DataFrame, low: int | None) -> int | None:
        """Events begin to wait, and those of orphaned blocks go; the least stretch that may have some."""
        pdf = pdf.astype({"block_number": "int64"}).sort_values("block_number")
        new, gone = pdf[pdf["kind"] == "event"], pdf["block_number"][pdf["kind"] == "orphan"].to_numpy()
        events = pa.Table.from_pandas(new[["block_number", "tx_hash"]], WAITING, preserve_index=False)
        of_event, of_orphan = new["block_number"].to_numpy() // STRETCH, gone // STRETCH
        for stretch in np.union1d(of_event, of_orphan).tolist():
            a, z = np.searchsorted(of_event, [stretch, stretch + 1]).tolist()
            if a < z or self.waiting.containsKey((stretch,)):
                known = pa.concat_tables([self._get(stretch), events.slice(a, z - a)])
                known = known.group_by(["block_number", "tx_hash"]).aggregate([]).cast(WAITING)
                orphans = pa.array(gone[slice(*np.searchsorted(of_orphan, [stretch, stretch + 1]))], pa.int64())
                self._put(stretch, known.filter(pc.invert(pc.is_in(known["block_number"], orphans))))
            if a < z:
                low = stretch if low is None else min(low, stretch)
        return low

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head, low = self.heights.get() if self.heights.exists() else (-1, None)
        held: list[pd.DataFrame] = []
        for pdf in rows:
            head = max([head, *pdf["block_number"][pdf["kind"] == "head"].astype(int)])
            held.append(pdf[pdf["kind"] != "head"])
            if sum(map(len, held)) >= TAKEN:
                low, held = self._take(pd.concat(held), low), []
        if sum(map(len, held)):
            low = self._take(pd.concat(held), low)
        every = self.depth == 0  # all are final, whatever the head
        if low is not None and (every or head >= self.depth):
            top = max([low, *(k[0] for k in self.waiting.keys())]) if every else (head - self.depth) // STRETCH
            out: list[pa.Table] = []
            for stretch in self._reached(low, top):
                known = self._get(stretch)
                final = pc.less_equal(known["block_number"], (stretch + 1) * STRETCH if every else head - self.depth)
                found = known.filter(final)
                if len(found):
                    self._put(stretch, known.filter(pc.invert(final)))
                    out.append(found.sort_by([("block_number", "ascending"), ("tx_hash", "ascending")]))
                if sum(map(len, out)) >= 10_000:
                    yield self._named(key[0], out)
                    out = []
            if out:
                yield self._named(key[0], out)
            low += max(0, top - low) // self.step * self.step
        self.heights.update((head, low))

    def _named(self, chain: str, found: list[pa.Table]) -> pd.DataFrame:
        return pa.concat_tables(found).to_pandas().assign(chain_id=chain)[["chain_id", "block_number", "tx_hash"]]

    def close(self) -> None:
        pass


def fitting_shards(heads: DataFrame) -> int:
    """Shards for chains up to these heads (chain_id, head), fixed for the life of a stream's state: SHARDS, or more for long chains."""
    most = heads.agg(F.max("head")).first()[0] or 0
    return max(SHARDS, -(-most // (STRETCH * STRETCHES)))


def finality_stream(rows: DataFrame, depth: int, shards: int = SHARDS) -> DataFrame:
    """rows (chain_id, block_number, tx_hash, kind: event, head or orphan) -> events, once each, when they are final.

    A chain's events and orphans are spread over shards by their stretch of heights; heads go to every shard. The session's state
    store provider must be RocksDB's.
    """
    ship(rows.sparkSession)
    every = F.sequence(F.lit(0), F.lit(shards - 1))
    own = F.array(F.pmod(F.floor(F.col("block_number") / STRETCH), F.lit(shards)).cast("int"))
    dealt = rows.filter("block_number IS NOT NULL").withColumn("shard", F.explode(F.when(F.col("kind") == "head", every).otherwise(own)))
    return dealt.groupBy("chain_id", "shard").transformWithStateInPandas(Finality(depth, shards), "chain_id string, block_number long, tx_hash string", "append", "none")


class Recent(StatefulProcessor):
    """Per chain: the blocks no more than depth under the head. A block that comes in or goes out is a row; the head never falls."""

    def __init__(self, depth: int):
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("kept", "block_number long", "block_hash string")
        self.head = handle.getValueState("head", "head long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        head = self.head.get()[0] if self.head.exists() else None
        for pdf in rows:
            before = head
            head = int(pdf["block_number"].max()) if head is None else max(head, int(pdf["block_number"].max()))
            out: list[tuple[int, str, str]] = []
            if before is not None and head > before:  # what falls below the new floor lay within depth of the old head
                for number in range(before - self.depth, min(before + 1, head - self.depth)):
                    if self.kept.containsKey((number,)):
                        out.append((number, self.kept.getValue((number,))[0], "out"))
                        self.kept.removeKey((number,))
            new = pdf[pdf["block_number"] >= head - self.depth].drop_duplicates("block_number", keep="last")
            for number, hash_ in zip(new["block_number"].astype(int).tolist(), new["block_hash"].tolist(), strict=True):
                k = (number,)
                old = self.kept.getValue(k)[0] if self.kept.containsKey(k) else None
                if old != hash_:
                    if old is not None:
                        out.append((number, old, "out"))
                    out.append((number, hash_, "in"))
                    self.kept.updateValue(k, (hash_,))
            text = lambda x: pd.Series(x, dtype=object)
            yield pd.DataFrame({"chain_id": text([key[0]] * len(out)), "block_number": pd.Series([n for n, _, _ in out], dtype="int64"), "block_hash": text([h for _, h, _ in out]), "change": text([c for _, _, c in out])})
        if head is not None:
            self.head.update((head,))

    def close(self) -> None:
        pass


def recent_stream(blocks: DataFrame, depth: int = 100) -> DataFrame:
    """A stream of blocks (chain_id, block_number, block_hash) -> (chain_id, block_number, block_hash, change: in or out).

    What has come in and not gone out is the buffer: blocks no more than depth under their chain's head, a height's last hash. State
    is depth + 1 blocks a chain. The session's state store provider must be RocksDB's.
    """
    ship(blocks.sparkSession)
    rows = blocks.select("chain_id", "block_number", "block_hash").filter("chain_id IS NOT NULL AND block_number IS NOT NULL AND block_hash IS NOT NULL")
    return rows.groupBy("chain_id").transformWithStateInPandas(Recent(depth), "chain_id string, block_number long, block_hash string, change string", "append", "none")


def recent_now(changes: DataFrame) -> DataFrame:
    """The buffer after all changes so far."""
    net = changes.groupBy("chain_id", "block_number", "block_hash").agg(F.sum(F.when(F.col("change") == "in", 1).otherwise(-1)).alias("_n"))
    return net.filter("_n > 0").drop("_n")


def head_stream(blocks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Heads of all chains as a table under path, a version an update (epoch, chain_id, head). The state never falls, whatever lands late."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/version={epoch}")

    return flow.chain_head(blocks).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _states(cursors: DataFrame, requests: DataFrame | None) -> DataFrame:
    """Cursors in the state that was last requested of their chain, where the change is allowed; other requests have no effect."""
    if requests is None:
        return cursors
    last = requests.groupBy("chain_id").agg(F.max_by("state", F.struct("at", "state")).alias("_want"))
    ok = F.coalesce(flow.allowed(F.col("state"), F.col("_want")), F.lit(False))
    return cursors.join(last, "chain_id", "left").withColumn("state", F.when(ok, F.col("_want")).otherwise(F.col("state"))).select(*cursors.columns)


def _waiting(held: DataFrame, name: Column, releases: DataFrame) -> DataFrame:
    """Held rows that haven't been taken in, with their chain in _chain."""
    since = releases.select(F.col("chain_id").alias("_chain"), F.col("since").alias("_since"))
    return held.withColumn("_chain", name).join(since, "_chain", "left").filter("_since IS NULL OR epoch > _since").drop("_since")


def frontier(cursors: DataFrame, islands: DataFrame, landed: DataFrame, width: int = BUCKET) -> DataFrame:
    """(chain_id, from_block, block_number, block_hash, reached) after blocks have landed: a row for each stretch without a hole, from
    the cursor on. Cursors and landed blocks are (chain_id, block_number, block_hash), islands also have from_block.

    A cursor is the height up to which all has landed, and islands are what has landed above it. A cursor goes on as far as the
    stretch that it is in or next to, which is the one with reached, so it never passes a hole and never falls.
    """
    ends = landed.select("chain_id", F.col("block_number").alias("from_block"), "block_number", "block_hash", F.lit(1).alias("_rank"))
    ends = ends.unionByName(islands.select("chain_id", "from_block", "block_number", "block_hash", F.lit(2).alias("_rank")))
    ends = ends.unionByName(cursors.select("chain_id", F.col("block_number").alias("from_block"), "block_number", "block_hash", F.lit(3).alias("_rank")))
    spans = ranges.merge_ranges(ends.select("chain_id", "from_block", F.col("block_number").alias("to_block")), width).withColumnRenamed("to_block", "block_number")
    whole = spans.join(cursors.select("chain_id", F.col("block_number").alias("_at")), "chain_id").filter("block_number >= _at")
    hashed = whole.join(ends.select("chain_id", "block_number", "block_hash", "_rank"), ["chain_id", "block_number"]).groupBy("chain_id", "from_block", "block_number", "_at")
    out = hashed.agg(F.min_by("block_hash", F.struct("_rank", "block_hash")).alias("block_hash"))
    return out.select("chain_id", "from_block", "block_number", "block_hash", (F.col("from_block") <= F.col("_at")).alias("reached"))


def holes(cursors: DataFrame, islands: DataFrame) -> DataFrame:
    """(chain_id, from_block, to_block): what is missing between a chain's cursor and its islands."""
    before = F.lag("block_number").over(W.partitionBy("chain_id").orderBy("block_number"))  # a row for each island
    spans = islands.select("chain_id", "from_block", "block_number").unionByName(cursors.select("chain_id", F.col("block_number").alias("from_block"), "block_number"))
    return spans.withColumn("_before", before).filter("_before IS NOT NULL").selectExpr("chain_id", "_before + 1 AS from_block", "from_block - 1 AS to_block")


def index_batch(
    raw: DataFrame, family: str, chain: str | Column, wallets: DataFrame, blocks: DataFrame, txs: DataFrame, cursors: DataFrame, receipts: DataFrame | None = None, jump: int = 0, prefilter: bool = False, max_depth: int = 100,
    islands: DataFrame | None = None, heads: DataFrame | None = None, behind: int | None = None, requests: DataFrame | None = None,
) -> dict[str, DataFrame | str]:
    """One batch of raw blocks through the live steps, over stored blocks and transactions (current rows only), cursors and islands.

    requests (chain_id, state, at) change a chain's state. Raw rows of a chain that is paused or in reorganisation go to held and
    change nothing else. Rows without a height or a hash go to failures. A chain without a cursor starts below its least
    block, or behind blocks under its head, and what is below its start is left to the backfill.

    A chain whose head (of heads, or else of the batch) is more than jump above its cursor jumps there: the heights between are
    queued in missing, and its blocks up to there wait for the backfill. The least block of a chain whose parent isn't the
    one that is stored or landed below it is a reorganisation: stored blocks above the safe one are orphaned, their transactions
    invalid and their events reverted, the cursor goes back, and blocks above the safe one wait until they land again. A
    chain with a reorganisation that is too deep stays as it is below it. Other blocks are normalised, kept if they touch the
    watch-list (with prefilter only in blocks of which a sender or recipient does), enriched from receipts and turned into events.

    Blocks above a hole are indexed, and their heights are held as islands; the cursor waits at the hole, which is queued in
    missing when it is first seen. work: a folder that the frames read from, to be deleted when all has been written.
    """
    spark = raw.sparkSession
    work = f"{shared_dir(spark)}/batch-{uuid.uuid4().hex}"

    def cut(df: DataFrame, name: str) -> DataFrame:
        """Written and read again: computed once, and later plans start from here."""
        df.write.option("compression", CODEC).parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    islands = spark.createDataFrame([], ISLANDS) if islands is None else islands
    cursors = cut(_states(cursors, requests), "cursors")
    name = F.lit(chain) if isinstance(chain, str) else chain
    stopped = cursors.filter(STOPPED).select(F.col("chain_id").alias("_stopped"))
    keyed, same = raw.withColumn("_of", name), F.col("_of") == F.col("_stopped")
    wait, raw = keyed.join(stopped, same, "left_semi").drop("_of"), keyed.join(stopped, same, "left_anti").drop("_of")

    to_blocks, to_txs = normalize.NORMALIZERS[family]
    seen = to_blocks(raw, chain).withColumn("created_at", F.col("block_timestamp"))
    whole = F.col("chain_id").isNotNull() & F.col("block_number").isNotNull() & F.coalesce(F.col("block_hash") != "", F.lit(False))
    failures = seen.filter(~whole).select("chain_id", "block_number", F.lit("block without height or hash").alias("error_msg"))
    new = seen.filter(whole)
    new = cut(new.groupBy(*BLOCK_KEY).agg(F.max_by(F.struct(*(c for c in new.columns if c not in BLOCK_KEY)), F.struct("block_timestamp", "block_hash")).alias("b")).select(*BLOCK_KEY, "b.*"), "new")

    least = new.groupBy("chain_id").agg(F.min("block_number").alias("_least"), F.max("block_number").alias("_top"))
    first = least.join(cursors.select("chain_id"), "chain_id", "left_anti")
    if behind is None:
        started = first.select("chain_id", (F.col("_least") - 1).alias("block_number"), F.lit("").alias("block_hash"))
    else:
        known_heads = first.select("chain_id", F.col("_top").alias("head")) if heads is None else heads.join(first.select("chain_id"), "chain_id", "left_semi")
        started = flow.cursor_init(cursors, known_heads, behind).select("chain_id", "block_number", "block_hash")
    heads = least.select("chain_id", F.col("_top").alias("head")) if heads is None else heads
    missing, jumped = ranges.gap_jump(cursors.filter(f"NOT {STOPPED}"), heads, jump)
    if jump or behind is not None:
        started, jumped = cut(started, "started"), cut(jumped, "jumped")
        floor = jumped if behind is None else jumped.unionByName(started)
        new = cut(new.join(floor.select("chain_id", F.col("block_number").alias("_floor")), "chain_id", "left").filter("_floor IS NULL OR block_number > _floor").drop("_floor"), "above")
    start = cut(cursors.select("chain_id", "block_number", "block_hash").join(jumped.select("chain_id"), "chain_id", "left_anti").unionByName(jumped).unionByName(started), "start")

    links = ["chain_id", "block_number", "block_hash", "parent_hash"]
    known = new.select(*links).unionByName(blocks.select(*links).join(new.select(*BLOCK_KEY), BLOCK_KEY, "left_anti"))
    mismatches = cut(reorg.check_parent_hash(new, known).filter("verdict = 'mismatch'").groupBy("chain_id").agg(F.min("block_number").alias("block_number")), "mismatches")
    forked = not mismatches.isEmpty()  # most batches have no reorganisation, and their plans stay short
    accepted = new
    if forked:
        reorgs = cut(reorg.safe_point(mismatches, known.join(mismatches.select("chain_id"), "chain_id", "left_semi"), max_depth), "reorgs")
        limit = reorgs.select("chain_id", F.when(F.col("too_deep"), F.col("block_number") - 1).otherwise(F.col("safe_block")).alias("_limit"))
        accepted = cut(new.join(limit, "chain_id", "left").filter("_limit IS NULL OR block_number <= _limit").drop("_limit"), "accepted")

    found, landed = to_txs(raw, chain).select(*normalize.TX_COLUMNS), accepted.select(*BLOCK_KEY, "block_hash")
    of_landed = lambda txs: txs.join(landed, [*BLOCK_KEY, "block_hash"], "left_semi").select(*normalize.TX_COLUMNS)
    of_relevant = lambda txs: txs
    if prefilter:
        near = of_landed(watch.may_touch(found, wallets))
        relevant = cut(watch.relevant_blocks(near, wallets).filter("relevant").select(*BLOCK_KEY), "relevant")
        of_relevant = lambda txs: txs.join(relevant, BLOCK_KEY, "left_semi")
        found = found.filter(watch.possible(relevant.select(F.struct(*BLOCK_KEY)))(F.struct(*BLOCK_KEY)))
    if family == "evm":  # the watch-list goes by rows, so it comes first, and only what it leaves is shuffled
        own = {"grams": cut(watch.rarest_grams(watch.watchlist(wallets)), "grams"), "cut": cut}
        matched = of_relevant(of_landed(watch.watch_evm(found, wallets, **own)))
    else:
        matched = MATCHERS[family](of_relevant(of_landed(found)), wallets)
    if receipts is not None:
        matched = normalize.evm_enrich(matched, receipts) if family == "evm" else normalize.tron_enrich(matched, receipts)
    matched = cut(matched.select(*normalize.TX_COLUMNS), "matched")
    out = {"blocks": accepted.withColumn("status", F.lit("processed")), "transactions": matched, "events": flow.to_events(matched)}
    if forked:
        back = reorgs.filter("NOT too_deep")
        stored = blocks.join(accepted.select(*BLOCK_KEY), BLOCK_KEY, "left_anti")
        rolled, undone, _, _ = reorg.reorg_rollback(back, stored, txs.join(accepted.select(*BLOCK_KEY), BLOCK_KEY, "left_anti"), cursors)
        undone = cut(undone.filter("status = 'invalid'").select(*matched.columns), "undone")
        nothing = lambda c: F.lit(None).cast("string").alias(c)
        reverted = undone.select("chain_id", "block_number", "tx_hash", F.lit("transaction_reverted").alias("event_type"), nothing("from_address"), nothing("to_address"), F.create_map(F.lit("reason"), F.lit("blockchain_reorganization")).alias("metadata"))
        out["blocks"] = out["blocks"].unionByName(rolled.filter("status = 'orphaned'").select(*out["blocks"].columns))
        out["transactions"] = matched.unionByName(undone)
        out["events"] = out["events"].unionByName(reverted)
        out["reorgs"] = reorgs
        safe = back.groupBy("chain_id").agg(F.min(F.struct("safe_block", "safe_hash")).alias("_safe"))
        over = F.coalesce(F.col("block_number") > F.col("_safe.safe_block"), F.lit(False))
        under = lambda df: df.join(safe, "chain_id", "left").withColumns({"block_hash": F.when(over, F.col("_safe.safe_hash")).otherwise(F.col("block_hash")), "block_number": F.when(over, F.col("_safe.safe_block")).otherwise(F.col("block_number"))}).drop("_safe")
        start, islands = cut(under(start), "back"), cut(under(islands).filter("from_block <= block_number"), "islands")
    stretches = cut(frontier(start, islands, accepted), "stretches")
    moved, ahead = stretches.filter("reached").select("chain_id", "block_number", "block_hash"), stretches.filter("NOT reached").drop("reached")
    top = islands.select("chain_id", "block_number").unionByName(start.select("chain_id", "block_number")).groupBy("chain_id").agg(F.max("block_number").alias("_top"))
    found_holes = holes(moved, ahead).join(top, "chain_id").filter("from_block > _top").drop("_top")
    out |= {"missing": missing.unionByName(found_holes), "failures": failures, "held": wait, "islands": ahead}
    out["cursors"] = store.upsert_cursor(cursors, moved, "block")
    return out | {"work": work}


def request_state(spark: SparkSession, path: str, chain: str, state: str, at: int) -> None:
    """Ask a live job to take a chain into a state with its next batch: paused, or scanning to go on. The last request by time counts."""
    spark.createDataFrame([(chain, state, at)], REQUESTS).coalesce(1).write.mode("append").parquet(f"{path}/requests")


def live_index(
    raw: DataFrame, family: str, chain: str | Column, wallets: DataFrame, path: str, checkpoint: str, receipts: DataFrame | None = None, jump: int = 0, prefilter: bool = False, max_depth: int = 100, heads: DataFrame | None = None, behind: int | None = None, fold_every: int = 100,
) -> StreamingQuery:
    """The job over a stream of raw blocks: every micro-batch is one unit of work, and a batch that has been committed isn't done again.

    Of what is stored a batch reads the heights from max_depth under its least block to its greatest: those units and buckets
    whose range meets them, and cursors, islands and releases as the last unit left them. Every batch writes a unit, an empty one
    too. Rows of a paused chain are held, and the first batch after it goes on takes them in. Every fold_every units are folded.
    current() over read_units() gives the table of blocks or transactions.
    """
    keys = {"transactions": TX_KEYS.get(family, TX_KEY)}

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        drop_shuffles(spark)
        done = units.Units(spark, path)
        if done.has(epoch):
            return
        empty = lambda schema: spark.createDataFrame([], schema)
        last = lambda name, schema: done.last(name) if done.latest >= 0 else empty(schema)
        cursors, islands, releases = last("cursors", CURSORS), last("islands", ISLANDS), last("releases", RELEASES)
        requests = spark.read.schema(REQUESTS).parquet(f"{path}/requests") if tables.exists(spark, f"{path}/requests") else None
        cursors = _states(cursors, requests)
        name = F.lit(chain) if isinstance(chain, str) else chain
        if done.rows("held"):
            going = cursors.filter(f"NOT {STOPPED}").select(F.col("chain_id").alias("_chain"))
            df = df.unionByName(_waiting(done.table("held"), name, releases).join(going, "_chain", "left_semi").select(*df.columns))
            releases = releases.join(going, F.col("chain_id") == F.col("_chain"), "left_anti").unionByName(going.select(F.col("_chain").alias("chain_id"), F.lit(epoch).cast("long").alias("since")))
        df, landed = written(df, "landed")
        lo, hi = normalize.NORMALIZERS[family][0](df, chain).agg(F.min("block_number"), F.max("block_number")).first()
        if lo is not None and done.latest >= 0:
            near = lambda name, key: current(done.table(name, lo - max_depth - 1, hi), key)
            blocks, txs = near("blocks", BLOCK_KEY).filter("status = 'processed'"), near("transactions", keys["transactions"]).filter("status <> 'invalid'")
        else:
            blocks, txs = empty(BLOCKS), empty(TRANSACTIONS)
        out = index_batch(df, family, chain, wallets, blocks, txs, cursors.withColumn("updated_at", F.lit(epoch).cast("long")), receipts, jump, prefilter, max_depth, islands, heads, behind)
        write_events(out["events"], f"{path}/events", epoch)
        others = {name: out[name] for name in ("missing", "reorgs", "failures", "held", "islands") if name in out}
        others["failures"] = others["failures"].withColumn("failed_at", F.lit(int(time.time())).cast("long"))
        write_unit(out["blocks"], out["transactions"], out["cursors"], path, epoch, releases=releases, **others)
        for folder in (out["work"], landed):
            tables.delete(spark, folder)
        if epoch % fold_every == fold_every - 1:
            units.fold(spark, path, keys, {"held": lambda rows: _waiting(rows, name, units.Units(spark, path).last("releases")).drop("_chain")})

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def retry_queue(spark: SparkSession, path: str) -> DataFrame:
    """What a live job's failures amount to: a row for each height that has failed, as the retry operators take it.

    A height is resolved once its block has been stored in the batch of its last failure or later, and else pending; every further
    batch in which it fails is one retry more. Rows without a chain or a height can't be asked for again, and are in failures
    alone. Of the stored blocks those between the least and the greatest height that failed are read.
    """
    done = units.Units(spark, path)
    failures = done.table("failures")
    if failures is None:
        failures = spark.createDataFrame([], "chain_id string, block_number long, error_msg string, failed_at long, epoch long")
    failures = failures.filter("chain_id IS NOT NULL AND block_number IS NOT NULL")
    lo, hi = failures.agg(F.min("block_number"), F.max("block_number")).first()
    times = [F.countDistinct("epoch").alias("_times"), F.max("epoch").alias("_last"), F.max_by("error_msg", F.struct("epoch", "error_msg")).alias("error_msg"), F.min("failed_at").alias("created_at"), F.max("failed_at").alias("last_attempt")]
    queue = failures.groupBy(*BLOCK_KEY).agg(*times)
    stored = None if lo is None else done.table("blocks", lo, hi)
    if stored is None:
        queue = queue.withColumn("_stored", F.lit(None).cast("long"))
    else:
        kept = latest_rows(stored, BLOCK_KEY).filter("status = 'processed'")
        queue = queue.join(kept.select(*BLOCK_KEY, F.col("epoch").alias("_stored")), BLOCK_KEY, "left")
    status = F.when(F.col("_stored") >= F.col("_last"), "resolved").otherwise("pending")
    return queue.select(
        F.abs(F.xxhash64(*BLOCK_KEY)).alias("id"), *BLOCK_KEY, F.lit("block").alias("failure_type"), "error_msg", (F.col("_times") - 1).cast("int").alias("retry_count"),
        "last_attempt", status.alias("status"), "created_at", F.col("last_attempt").alias("updated_at"),
    )


def backfill_ingest(queue: DataFrame, raw: DataFrame, family: str, chain: str | Column, wallets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, transactions) of the heights of pending ranges: filtered by the watch-list, not enriched, without events. The
    watch-list comes first, so that only what it leaves is dealt by heights."""
    return rescan_ingest(queue.filter("status = 'pending'"), raw, family, chain, lambda txs: MATCHERS[family](txs, wallets))


def rescan_ingest(ranges_: DataFrame, raw: DataFrame, family: str, chain: str | Column, kept: Callable[[DataFrame], DataFrame] = lambda txs: txs) -> tuple[DataFrame, DataFrame]:
    """(blocks, transactions) of the heights of ranges, all of them, or what kept keeps of the transactions."""
    to_blocks, to_txs = normalize.NORMALIZERS[family]
    wanted = ranges.merge_ranges(ranges_).selectExpr("chain_id", "from_block AS lo", "to_block AS hi")
    return store.within(to_blocks(raw, chain), wanted), store.within(kept(to_txs(raw, chain).select(*normalize.TX_COLUMNS)), wanted)


#: Heights of a chunk of a range, attempts after which a range is given up, and files of a unit's table at most.
CHUNK, MOST_ATTEMPTS, FILES = 100, 3, 8
PROGRESS = "chain_id string, from_block long, to_block long, done long, attempts int"


def _overlapping(ranges_: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, met, spent): does a range (id, chain_id, from_block, to_block) overlap any of the spans (chain_id, lo, hi, attempts), and any
    that has been tried MOST_ATTEMPTS times? Spans don't overlap, so of those that begin up to the range's end the last one reaches
    highest: a lookup for each range, not a comparison with each span."""
    at = spans.selectExpr("chain_id", "lo * 2 AS block_number", "hi", "attempts", "CAST(NULL AS bigint) AS id", "CAST(NULL AS bigint) AS from_block")
    asked = ranges_.selectExpr("chain_id", "to_block * 2 + 1 AS block_number", "CAST(NULL AS bigint) AS hi", "CAST(NULL AS int) AS attempts", "id", "from_block")
    rows = with_last(at.unionByName(asked), F.col("hi"), "_met", 200_000)
    rows = with_last(rows, F.when(F.col("attempts") >= MOST_ATTEMPTS, F.col("hi")), "_spent", 200_000)
    reaches = lambda c: F.coalesce(F.col(c) >= F.col("from_block"), F.lit(False))
    return rows.filter("hi IS NULL").select("id", reaches("_met").alias("met"), reaches("_spent").alias("spent"))


def _in_units(going: DataFrame, chunk: int, per_unit: int) -> DataFrame:
    """Ranges that don't overlap, in chunks with their unit: its number, from 0, per_unit chunks each, the lowest first. Ranges are
    ranked by how many chunks lie below them, so that chunks needn't be."""
    n = F.expr(f"(to_block - from_block) div {chunk} + 1")
    lower = W.orderBy("chain_id").rowsBetween(W.unboundedPreceding, -1)  # over a row a chain
    chains = going.groupBy("chain_id").agg(F.sum(n).alias("_n")).select("chain_id", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_lower"))
    ranked = running(going, ["chain_id"], "from_block", ["from_block"], n, "_upto", 100_000).join(chains, "chain_id")
    ranked = ranked.select("chain_id", "from_block", "to_block", F.col("from_block").alias("_first"), (F.col("_lower") + F.col("_upto") - n).alias("_below"))
    unit = F.expr(f"(_below + (from_block - _first) div {chunk}) div {per_unit}").alias("unit")
    return ranges.split_ranges(ranked, chunk, "_first", "_below").select("chain_id", "from_block", "to_block", unit)


def _tried(rest: DataFrame, earlier: DataFrame, chunk: int) -> DataFrame:
    """(chain_id, from_block, to_block, before): chunks of ranges that have a height at which earlier attempts ended, and how many these were.
    A height's range is the last that begins up to it: a lookup, not a comparison with each height of the ranges."""
    tried = earlier.filter("done < to_block").groupBy("chain_id", (F.col("done") + 1).alias("_at")).agg(F.max("attempts").alias("before"))
    at = rest.selectExpr("chain_id", "from_block * 2 AS block_number", "named_struct('lo', from_block, 'hi', to_block) AS _range", "CAST(NULL AS bigint) AS _at", "CAST(NULL AS int) AS before")
    asked = tried.selectExpr("chain_id", "_at * 2 + 1 AS block_number", "CAST(NULL AS struct<lo: bigint, hi: bigint>) AS _range", "_at", "before")
    rows = with_last(at.unionByName(asked), F.col("_range"), "_in", 200_000).filter("_at <= _in.hi")
    lo = F.expr(f"_in.lo + (_at - _in.lo) div {chunk} * {chunk}")
    found = rows.select("chain_id", lo.alias("from_block"), F.least(lo + chunk - 1, "_in.hi").alias("to_block"), "before")
    return found.groupBy("chain_id", "from_block", "to_block").agg(F.max("before").alias("before"))


def ingest_ranges(queue: DataFrame, raw: DataFrame, family: str, chain: str | Column, path: str, now: int, wallets: DataFrame | None = None, per_unit: int = 1000, chunk: int = CHUNK, most_units: int | None = None) -> DataFrame:
    """The queue after its pending ranges have been worked on, as a job that can be broken off at any time and goes on where it was.

    Ranges are merged and cut into chunks; per_unit chunks, the lowest first, are one unit of work under path: their blocks, their
    transactions (with wallets those that touch the watch-list) and how far each chunk has come, committed together. A chunk ends
    before its first height that isn't there, and the next run tries again from that height. A range is completed when all of
    its heights are done, failed when one of its chunks has been tried MOST_ATTEMPTS times, and else it stays pending. A run
    tries each chunk once, and ends after most_units units if given.
    """
    spark = queue.sparkSession
    drop_shuffles(spark)
    pending = queue.filter("status = 'pending' AND from_block <= to_block")
    done = units.Units(spark, path)
    began = done.latest + 1
    key = ["chain_id", "from_block", "to_block"]
    empty = spark.createDataFrame([], f"{PROGRESS}, epoch long")

    def progress() -> DataFrame:
        rows = units.Units(spark, path).table("progress")
        return empty if rows is None else rows

    work = []

    def stage(df: DataFrame, name: str) -> DataFrame:
        out, at = written(df, name)
        work.append(at)
        return out

    def by_unit(df: DataFrame, name: str) -> Callable[[int], DataFrame]:
        """The table in a folder for each unit; every unit's rows are in few files."""
        at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        work.append(at)
        plain = df.drop("unit").schema
        df.withColumn("_unit", F.col("unit")).repartition("unit", F.pmod(F.hash("chain_id", "block_number" if "block_number" in df.columns else "from_block"), F.lit(FILES))).drop("unit").write.partitionBy("_unit").option("compression", CODEC).parquet(at)
        return lambda n: spark.read.schema(plain).parquet(f"{at}/_unit={n}") if tables.exists(spark, f"{at}/_unit={n}") else spark.createDataFrame([], plain)

    # What earlier runs have done goes; what is left is cut into chunks, with the attempts at the heights that weren't there.
    rest = stage(ranges.merge_ranges(pending), "pending")
    if began:
        past = ranges.merge_ranges(progress().selectExpr("chain_id", "from_block", "done AS to_block"))
        rest = stage(ranges.subtract_ranges(rest, past), "rest")
        tried = stage(_tried(rest, progress(), chunk), "tried")
        spent = tried.filter(F.col("before") >= MOST_ATTEMPTS)  # chunks that are given up have no unit
        going = ranges.subtract_ranges(rest, ranges.merge_ranges(spent))
        chunks = _in_units(going, chunk, per_unit).join(tried.filter(F.col("before") < MOST_ATTEMPTS), key, "left").select(*key, F.coalesce("before", F.lit(0)).alias("before"), "unit")
        chunks = chunks.unionByName(spent.select(*key, "before", F.lit(None).cast("long").alias("unit")))
    else:
        chunks = _in_units(rest, chunk, per_unit).select(*key, F.lit(0).alias("before"), "unit")
    chunks = stage(chunks, "chunks")
    last = chunks.agg(F.max("unit")).first()[0]
    n_units = 0 if last is None else last + 1
    n_units = n_units if most_units is None else min(n_units, most_units)

    # The raw blocks are read once for all units of this run, not by each.
    if n_units:
        to_blocks, to_txs = normalize.NORMALIZERS[family]
        mine = chunks.filter(F.col("unit") < n_units)
        spread = mine.select("unit", *key, F.explode(F.sequence("from_block", "to_block")).alias("block_number"))
        landed = to_blocks(raw, chain).filter(F.coalesce(F.col("block_hash") != "", F.lit(False)))
        landed = stage(landed.join(spread.select(*BLOCK_KEY, "unit"), BLOCK_KEY), "landed")
        absent = spread.join(landed.select(*BLOCK_KEY), BLOCK_KEY, "left_anti").groupBy(*key).agg((F.min("block_number") - 1).alias("upto"))
        after = stage(mine.join(absent, key, "left").select(*key, F.coalesce("upto", "to_block").alias("done"), (F.col("before") + 1).cast("int").alias("attempts"), "unit"), "after")
        reached = after.filter("from_block <= done").select("chain_id", "unit", F.explode(F.sequence("from_block", "done")).alias("block_number"))
        # Before the watch-list, transactions are tried against an array of bits for the blocks that this run reaches.
        near = watch.possible(reached.select(F.struct(*BLOCK_KEY)))(F.struct(*BLOCK_KEY))
        txs = to_txs(raw, chain).select(*normalize.TX_COLUMNS).filter(near)
        if wallets is not None:
            own = {"grams": stage(watch.rarest_grams(watch.watchlist(wallets)), "grams"), "cut": stage} if family == "evm" else {}
            txs = MATCHERS[family](txs, wallets, **own)
        of_unit = {
            "blocks": by_unit(landed.join(reached, [*BLOCK_KEY, "unit"], "left_semi").withColumn("created_at", F.lit(now).cast("long")), "blocks"),
            "transactions": by_unit(txs.join(reached, BLOCK_KEY).select(*normalize.TX_COLUMNS, "unit"), "transactions"),
            "progress": by_unit(after, "progress"),
        }
    for n in range(n_units):
        write_unit(of_unit["blocks"](n), of_unit["transactions"](n), spark.createDataFrame([], CURSORS), path, began + n, progress=of_unit["progress"](n))

    own = units.latest_rows(progress().filter(F.col("epoch") >= began), key)
    left = chunks.join(own, key, "left").withColumns({"done": F.coalesce("done", F.col("from_block") - 1), "attempts": F.coalesce("attempts", "before")}).filter("done < to_block")
    still = _overlapping(pending, left.select("chain_id", (F.col("done") + 1).alias("lo"), F.col("to_block").alias("hi"), "attempts"))
    changes = still.select("id", F.when(~F.col("met"), "completed").when(F.col("spent"), "failed").alias("new_status"), F.when(F.col("spent"), "max retries exceeded").alias("new_error"))
    out, _ = written(ranges.mark_ranges(queue, changes.filter("new_status IS NOT NULL"), now), "queue")
    for folder in work:
        tables.delete(spark, folder)
    return out
