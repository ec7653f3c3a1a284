"""The live job: cursors that wait at holes, stopped chains, committed units, folding and tables that are changed in place."""

import json
import os
import random
from pathlib import Path

import pytest
from conftest import SF
from pyspark.sql import functions as F

from blockweave.operators import flow, store
from blockweave.sources import raw, tables, units
from blockweave.streaming import jobs


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(autouse=True)
def small_plans(spark):
    """Many tiny batches: fewer tasks, nothing compiled."""
    own = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "2", "spark.sql.codegen.wholeStage": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


class Job:
    """A live job over one folder; land() adds blocks and runs it."""

    def __init__(self, spark, at, **options):
        self.spark, self.at, self.options, self.n = spark, str(at), options, 0
        self.wallets = spark.createDataFrame([("0xa",)], "address string")
        Path(f"{self.at}/raw").mkdir()

    def land(self, *numbers, chain="c", fork=""):
        """Blocks by number, with one transaction each; no numbers are an empty batch."""
        self.n += 1
        name = lambda n: f"{fork if fork and n >= min(numbers) else ''}{chain}{n}"
        rows = [{"chain_id": chain, "number": hex(n), "timestamp": "0x64", "hash": name(n), "parentHash": name(n - 1), "transactions": [{"hash": f"t{name(n)}", "from": "0xA", "to": "0xb", "value": "0x1", "gasPrice": "0x1"}]} for n in numbers]
        return self.write("".join(json.dumps(r) + "\n" for r in rows))

    def write(self, text):
        Path(f"{self.at}/raw/{self.n}.json").write_text(text or "\n")
        stream = raw.stream_raw(self.spark, f"{self.at}/raw", "evm", keyed=True)
        jobs.live_index(stream, "evm", F.col("chain_id"), self.wallets, f"{self.at}/out", f"{self.at}/state", **self.options).awaitTermination()
        return self

    @property
    def units(self):
        return units.Units(self.spark, f"{self.at}/out")

    def cursors(self):
        return {r["chain_id"]: (r["block_number"], r["block_hash"]) for r in self.units.last("cursors").collect()}

    def blocks(self, chain="c"):
        rows = units.current(self.units.table("blocks"), units.KEYS["blocks"])
        return [r[0] for r in values(rows.filter((F.col("chain_id") == chain) & (F.col("status") == "processed")), "block_number")]

    def missing(self):
        return values(self.units.table("missing"), "chain_id", "from_block", "to_block")


def test_a_cursor_waits_at_a_hole_and_never_falls(spark, tmp_path):
    job = Job(spark, tmp_path).land(1, 2, 3)
    assert job.cursors() == {"c": (3, "c3")}
    job.land(5)
    assert job.cursors() == {"c": (3, "c3")} and job.missing() == [("c", 4, 4)] and job.blocks() == [1, 2, 3, 5]
    job.land(2, 8, 9).land(6)
    assert job.cursors() == {"c": (3, "c3")} and job.missing() == [("c", 4, 4), ("c", 6, 7)]
    assert values(job.units.last("islands"), "from_block", "block_number", "block_hash") == [(5, 6, "c6"), (8, 9, "c9")]
    job.land(4, 7)
    assert job.cursors() == {"c": (9, "c9")} and job.units.last("islands").count() == 0 and job.blocks() == list(range(1, 10))
    assert values(units.current(job.units.table("transactions"), store.TX_KEY), "block_number") == [(n,) for n in range(1, 10)]


def test_chains_keep_their_cursors_through_empty_batches(spark, tmp_path):
    job = Job(spark, tmp_path).land(1, chain="x").land().land(2, chain="y")
    assert job.cursors() == {"x": (1, "x1"), "y": (2, "y2")} and job.units.latest == 2
    assert {r["status"] for r in job.units.table("blocks").collect()} == {"processed"}


def test_a_paused_chain_holds_its_blocks(spark, tmp_path):
    job = Job(spark, tmp_path).land(1, 2)
    jobs.request_state(spark, f"{tmp_path}/out", "c", "paused", 1)
    jobs.request_state(spark, f"{tmp_path}/out", "d", "init", 1)  # no such change
    job.land(3).land(4)
    assert job.cursors() == {"c": (2, "c2")} and job.blocks() == [1, 2] and job.units.rows("held") == 2
    job.land(1, 2, chain="d")
    assert job.cursors() == {"c": (2, "c2"), "d": (2, "d2")}
    assert {r["chain_id"]: r["state"] for r in job.units.last("cursors").collect()} == {"c": "paused", "d": "scanning"}
    jobs.request_state(spark, f"{tmp_path}/out", "c", "scanning", 2)
    job.land(3, chain="d")
    assert job.cursors() == {"c": (4, "c4"), "d": (3, "d3")} and job.blocks() == [1, 2, 3, 4]
    epochs = job.land(4, chain="d").units.table("blocks").filter("chain_id = 'c' AND block_number = 3")
    assert epochs.count() == 1  # taken in once


def test_rollback_cuts_islands_and_takes_the_cursor_back(spark, tmp_path):
    job = Job(spark, tmp_path).land(1, 2, 3, 4).land(6, 7)
    assert job.cursors() == {"c": (4, "c4")}
    job.land(8, fork="f-")  # its parent is c7: no fork yet
    job.land(9, fork="g-")  # its parent isn't the block 8 that is stored
    assert job.cursors() == {"c": (4, "c4")} and values(job.units.last("islands"), "from_block", "block_number", "block_hash") == [(6, 7, "c7")]
    assert values(job.units.table("reorgs"), "block_number", "safe_block", "too_deep") == [(9, 7, False)]
    job.land(5)
    assert job.cursors() == {"c": (7, "c7")}
    Path(f"{tmp_path}/raw/fork.json").write_text(json.dumps({"chain_id": "c", "number": "0x8", "timestamp": "0x64", "hash": "z", "parentHash": "other", "transactions": []}))
    job.land(20, chain="d")
    assert job.cursors()["c"] == (6, "c6") and job.cursors()["d"] == (20, "d20")


def test_heads_from_outside_and_starts_behind_them(spark, tmp_path):
    heads = spark.createDataFrame([("c", 500), ("d", 30)], "chain_id string, head long")
    job = Job(spark, tmp_path, jump=100, heads=heads, behind=10).land(21, 20, 22, chain="d")
    assert job.cursors() == {"d": (22, "d22")} and job.blocks("d") == [21, 22]
    job.land(3, 491, chain="c")
    assert job.cursors()["c"] == (491, "c491") and job.blocks() == [491]
    late = Job(spark, tmp_path / "late", jump=100) if (tmp_path / "late").mkdir() is None else None
    late.land(1, 2)
    late.options["heads"] = heads
    late.land(3, 501)
    assert late.cursors() == {"c": (501, "c501")} and late.missing() == [("c", 3, 500)] and late.blocks() == [1, 2, 501]


def test_failures_are_a_retry_queue(spark, tmp_path):
    bad = lambda *numbers: "".join(json.dumps({"chain_id": "c", "number": hex(n), "hash": ""}) + "\n" for n in numbers)
    job = Job(spark, tmp_path, fold_every=2).land(1)
    queue = lambda: jobs.retry_queue(spark, f"{tmp_path}/out")
    assert queue().count() == 0
    job.n += 1
    job.write(bad(2, 3, 3, 4) + '{"chain_id": "c", "hash": "x"}\nnot json\n')
    assert values(queue(), "block_number", "retry_count", "status") == [(2, 0, "pending"), (3, 0, "pending"), (4, 0, "pending")]
    job.land(2)
    job.n += 1
    job.write(bad(3))
    assert values(queue(), "block_number", "retry_count", "status") == [(2, 0, "resolved"), (3, 1, "pending"), (4, 0, "pending")]
    job.land(3)
    job.n += 1
    job.write(bad(3))  # stored before it failed again
    assert values(queue(), "block_number", "retry_count", "status") == [(2, 0, "resolved"), (3, 2, "pending"), (4, 0, "pending")]
    now = queue().agg({"last_attempt": "max"}).first()[0]
    assert values(flow.due_retries(queue(), now + 60), "block_number", "delay") == [(3, 8.0), (4, 2.0)]
    assert values(flow.count_failures(queue()), "chain_id", "n_failures") == [("c", 2)] and {r["verdict"] for r in flow.retry_verdict(queue()).collect()} == {"retry"}


def test_rows_without_height_or_hash_are_failures(spark, tmp_path):
    job = Job(spark, tmp_path).land(1)
    job.n += 1
    job.write('{"chain_id": "c", "hash": "x"}\nnot json\n{"chain_id": "c", "number": "0x2", "hash": ""}\n')
    assert values(job.units.table("failures"), "error_msg") == [("block without height or hash",)] * 3 and job.cursors() == {"c": (1, "c1")}


def test_a_committed_unit_is_not_done_again(spark, tmp_path):
    job = Job(spark, tmp_path).land(1)
    before = sorted(os.listdir(f"{tmp_path}/out/data/blocks"))
    import shutil

    shutil.rmtree(f"{tmp_path}/state")  # a restart that has lost its own log
    job.land(2)
    assert job.cursors() == {"c": (1, "c1")} and sorted(os.listdir(f"{tmp_path}/out/data/blocks")) == before


def test_the_live_job_folds_and_goes_on(spark, tmp_path):
    job = Job(spark, tmp_path, fold_every=2)
    for n in (1, 3, 4, 2, 5):
        job.land(n)
    assert job.units.base == 3 and job.cursors() == {"c": (5, "c5")} and job.blocks() == list(range(1, 6)) and job.missing() == [("c", 2, 2)]
    assert sorted(os.listdir(f"{tmp_path}/out/manifest")) == ["unit=2", "unit=3", "unit=4"]  # earlier ones have gone


def blocks_frame(spark, *numbers, hash_="h", chain="c"):
    return spark.createDataFrame([(chain, n, f"{hash_}{n}") for n in numbers], "chain_id string, block_number long, block_hash string")


def test_readers_open_only_units_and_buckets_in_range(spark, tmp_path):
    cursors = spark.createDataFrame([("c", 1)], "chain_id string, block_number long")
    for epoch in range(6):
        b = blocks_frame(spark, *range(epoch * 1000, epoch * 1000 + 5))
        units.write_unit(b, b.withColumn("tx_hash", F.lit("t")), cursors, str(tmp_path), epoch)
    opened = lambda lo, hi: {f.rsplit("/", 2)[1].split("-")[0] for f in units.Units(spark, str(tmp_path)).table("blocks", lo, hi).inputFiles()}
    assert opened(2000, 3002) == {"2", "3"} and len(opened(9000, 9999)) == 1
    assert units.read_units(spark, str(tmp_path), "blocks", 2001, 2002).count() == 2
    assert units.fold(spark, str(tmp_path), width=1000) == 5 == units.fold(spark, str(tmp_path), width=1000)
    found = tables.read_table(spark, f"{tmp_path}/base/blocks", 2001, 3000, width=1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan and values(found, "block_number") == [(2001,), (2002,), (2003,), (2004,), (3000,)]
    b = blocks_frame(spark, 2001, 7000, hash_="new")
    units.write_unit(b, b.withColumn("tx_hash", F.lit("t")), cursors, str(tmp_path), 6)
    files = lambda: {str(f): f.stat().st_mtime_ns for f in Path(f"{tmp_path}/base/blocks").rglob("*.parquet")}
    before = files()
    assert units.fold(spark, str(tmp_path), width=1000) == 6
    after = files()
    changed = {f.split("_bucket=")[1].split("/")[0] for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {"2", "7"}
    rows = units.current(units.read_units(spark, str(tmp_path), "blocks"), units.KEYS["blocks"])
    assert rows.count() == 31 and values(rows.filter("block_hash LIKE 'new%'"), "block_number") == [(2001,), (7000,)]


def test_changes_in_place_equal_changes_of_the_whole(spark, tmp_path):
    from blockweave.plans import fixtures as fx

    whole, new = fx.blocks(spark, SF), fx.incoming(spark, SF).filter("block_number < 150")
    at = f"{tmp_path}/blocks"
    tables.write_table(whole, at, 50)
    n = tables.merge_into(spark, at, tables.parts(new, 50), lambda old: store.upsert_blocks(old, new), 50)
    assert n == len({(r["chain_id"], r["block_number"] // 50) for r in new.collect()})
    key = lambda df: sorted(map(repr, df.select(*sorted(whole.columns)).collect()))
    assert key(tables.read_table(spark, at)) == key(store.upsert_blocks(whole, new))
    gone = spark.createDataFrame([("chain_1", 0, 120), ("chain_2", 60, 70)], "chain_id string, lo long, hi long")
    want = key(store.delete_block_range(store.upsert_blocks(whole, new), gone))
    tables.merge_into(spark, at, tables.range_parts(gone, 50), lambda old: store.delete_block_range(old, gone), 50)
    assert key(tables.read_table(spark, at)) == want and not os.path.exists(f"{at}/_chain=chain-chain_1/_bucket=0")
    assert tables.merge_into(spark, at, tables.parts(new.limit(0), 50), lambda old: old, 50) == 0


def test_frontier_against_a_loop(spark):
    rng = random.Random(6)
    for _ in range(3):
        cursor, held, landed = rng.randrange(5), set(), {rng.randrange(40) for _ in range(25)}
        for _ in range(4):
            n = rng.randrange(cursor + 1, 40)
            held |= set(range(n, n + 3))
        held -= {cursor + 1}
        spans, run = [], []
        for n in sorted(held - set(range(cursor + 1))):
            if run and n != run[-1] + 1:
                spans.append(("c", run[0], run[-1], f"c{run[-1]}"))
                run = []
            run.append(n)
        spans.append(("c", run[0], run[-1], f"c{run[-1]}"))
        every, want = held | landed, cursor
        while want + 1 in every:
            want += 1
        out = jobs.frontier(spark.createDataFrame([("c", cursor, f"c{cursor}")], "chain_id string, block_number long, block_hash string"), spark.createDataFrame(spans, jobs.ISLANDS), blocks_frame(spark, *sorted(landed), hash_="c"), width=7).persist()
        moved, ahead = out.filter("reached"), out.filter("NOT reached")
        assert values(moved, "block_number", "block_hash") == [(want, f"c{want}")]
        covered = {n for r in ahead.collect() for n in range(r["from_block"], r["block_number"] + 1)}
        assert covered == {n for n in every if n > want} and all(h == f"c{n}" for n, h in values(ahead, "block_number", "block_hash"))
        gaps = {n for r in jobs.holes(moved, ahead).collect() for n in range(r["from_block"], r["to_block"] + 1)}
        assert gaps == set(range(want + 1, max(covered, default=want) + 1)) - covered


def test_a_ranges_job_goes_on_where_it_was_broken_off(spark, tmp_path):
    txs = lambda n: [(f"t{n}", "0xA" if n % 2 else "0xz", "0xb", "0x1", "0x1", "0x0")]
    landed = lambda *numbers: spark.createDataFrame([(hex(n), "0x64", f"h{n}", f"h{n - 1}", txs(n)) for n in numbers], raw.schema("evm"))
    queue = spark.createDataFrame([(1, 10, 29, "pending"), (2, 25, 44, "pending"), (3, 60, 64, "pending"), (4, 80, 81, "completed"), (5, 50, 49, "pending")], "id long, from_block long, to_block long, status string").selectExpr("id", "'c' AS chain_id", "from_block", "to_block", "status", "0 AS attempts", "'' AS error_msg", "1 AS priority", "0L AS created_at", "0L AS updated_at")
    wallets, at = spark.createDataFrame([("0xa",)], "address string"), f"{tmp_path}/out"
    run = lambda q, raws, **o: jobs.ingest_ranges(q, raws, "evm", "c", at, 7, wallets, per_unit=2, chunk=10, **o)
    status = lambda q: {r["id"]: r["status"] for r in q.collect()}
    stored = lambda: [r[0] for r in values(units.current(units.read_units(spark, at, "blocks"), units.KEYS["blocks"]), "block_number")]
    some = landed(*range(10, 38), *range(60, 65))
    first = run(queue, some, most_units=1)
    assert status(first) == {1: "completed", 2: "pending", 3: "pending", 4: "completed", 5: "pending"} and stored() == list(range(10, 30))
    then = run(first, some)
    assert status(then) == {1: "completed", 2: "pending", 3: "completed", 4: "completed", 5: "pending"} and stored() == [*range(10, 38), *range(60, 65)]
    made = units.Units(spark, at)
    assert made.latest == 2 and made.table("progress").filter("epoch > 0 AND from_block < 30").count() == 0  # what was done wasn't done again
    assert status(run(then, landed(*range(10, 45)))) == {1: "completed", 2: "completed", 3: "completed", 4: "completed", 5: "pending"} and stored() == [*range(10, 45), *range(60, 65)]
    assert values(units.read_units(spark, at, "transactions"), "block_number") == [(n,) for n in sorted(stored()) if n % 2]
    lost = spark.createDataFrame([(9, "c", 900, 901, "pending", 0, "", 1, 0, 0)], queue.schema)
    for want in ("pending", "pending", "failed"):
        lost = run(lost, landed(901))
        assert status(lost) == {9: want}
    assert lost.first()["error_msg"] == "max retries exceeded"


def test_streams_near_the_head_equal_batches(spark, tmp_path):
    from blockweave.operators import flow

    rng = random.Random(2)
    numbers = [rng.randrange(300) for _ in range(300)]
    schema = "chain_id string, block_number long, block_hash string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    seen, heads = {}, {}
    for part in range(3):
        rows = {(c, n): f"{part if n % 9 == 0 else ''}{c}{n}" for c in "ab" for n in numbers[part * 100 : part * 100 + 100]}
        seen |= rows
        spark.createDataFrame([(*k, h) for k, h in rows.items()], schema).write.mode("append").parquet(f"{tmp_path}/in")
        stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        jobs.recent_stream(stream(), 20).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/s1").trigger(availableNow=True).start().awaitTermination()
        jobs.head_stream(stream(), f"{tmp_path}/heads", f"{tmp_path}/s2").awaitTermination()
        blocks = spark.createDataFrame([(*k, h) for k, h in seen.items()], schema)
        now = jobs.recent_now(spark.read.parquet(f"{tmp_path}/out"))
        assert values(now, "chain_id", "block_number", "block_hash") == values(flow.recent_buffer(blocks, 20), "chain_id", "block_number", "block_hash")
        got = {r["chain_id"]: r["head"] for r in spark.read.parquet(f"{tmp_path}/heads").groupBy("chain_id").agg(F.max_by("head", "epoch").alias("head")).collect()}
        assert got == {r["chain_id"]: r["head"] for r in flow.chain_head(blocks).collect()} and all(got[c] >= heads.get(c, 0) for c in got)
        heads = got
