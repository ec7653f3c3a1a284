"""Small cases of what a review found."""

import math
import os
import random
import re
import time

import pandas as pd
from conftest import SF

from blockweave import shipping
from blockweave.operators import flow, in_place, normalize, ranges, store, watch
from blockweave.plans import fixtures as fx
from blockweave.plans import payloads, queries, queries_flow
from blockweave.sources import raw, tables, units
from blockweave.streaming import jobs


def test_throughput_of_blocks_of_one_moment(spark):
    rows = [("a", n, 60) for n in range(5)] + [("b", 1, 60)] + [("c", n, 2 * n) for n in range(3)]
    out = {r[0]: r[1:] for r in flow.throughput(spark.createDataFrame(rows, "chain_id string, block_number long, ts long")).collect()}
    assert out["a"] == (math.inf, 0.0) and out["c"] == (0.5, 2.0)
    assert all(map(math.isnan, out["b"]))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)", plan)


def test_lines_become_transactions_before_they_are_wide(spark):
    """Each order's lines are dealt once, by their order; nothing is shuffled by a transaction's hash, and none differs."""
    new = fx.arrivals(spark, SF)
    expected = store.insert_transactions(None, new, order="arrival").drop("arrival")
    got = fx.transactions(spark, SF)
    assert got.columns == expected.columns and got.exceptAll(expected).isEmpty() and expected.exceptAll(got).isEmpty()
    for df in (got, payloads.evm(spark, SF), payloads.sui(spark, SF)):
        assert not [e for e in exchanges(df) if "tx_hash" in e] and sum("l_orderkey" in e for e in exchanges(df)) == 1


def test_a_long_table_has_few_buckets(spark):
    rows = spark.range(-50, 40_000).selectExpr("'c' AS chain_id", "id AS block_number", "'h' AS block_hash")
    at, width = queries._stored(spark, rows, rows)
    assert 1 < spark.read.parquet(at).select("_bucket").distinct().count() <= tables.MOST_BUCKETS
    gone = spark.createDataFrame([("c", 10, 39_000)], "chain_id string, lo long, hi long")
    in_place.delete_block_range(at, gone, width)
    assert tables.read_table(spark, at).count() == 60 + 999
    assert tables.fitting_width(rows.filter("block_number BETWEEN 0 AND 300"), 100) == 100 and tables.fitting_width(rows.limit(0), 100) == 100


class State(dict):
    """A map state or a value state that counts how often it is asked or changed."""

    n = 0

    def containsKey(self, k):  # noqa: N802
        self.n += 1
        return k in self

    def getValue(self, k):  # noqa: N802
        self.n += 1
        return self[k]

    def updateValue(self, k, v):  # noqa: N802
        self.n += 1
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        self.n += 1
        del self[k]

    def exists(self):
        return 0 in self

    def get(self):
        return self[0]

    def update(self, v):
        self[0] = v

    def getMapState(self, *_):  # noqa: N802
        return self

    def getValueState(self, *_):  # noqa: N802
        return State()


def finality(depth):
    state, job = State(), jobs.Finality(depth)
    job.init(state)

    def run(*rows):
        pdf = pd.DataFrame([("c", *r) for r in rows], columns=["chain_id", "block_number", "tx_hash", "kind"])
        return [tuple(r) for out in job.handleInputRows(("c", 0), iter([pdf]), None) for r in out.itertuples(index=False)]

    return state, run


def test_waiting_events_are_few_entries_of_the_state():
    state, run = finality(10)
    assert run((-5, "", "head")) == []
    assert run(*((n, f"t{n}", "event") for n in [*range(1000), *range(1000)])) == []
    assert run((300, "", "orphan"), (5000, "", "orphan")) == [] and len(state) == 4 and state.n < 30
    assert run((409, "", "head")) == [("c", n, f"t{n}") for n in range(400) if n != 300]
    assert run((409, "", "head"), (399, "late", "event"), (300, "again", "event")) == [("c", 300, "again"), ("c", 399, "late")]
    assert [r[1] for r in run((5000, "", "head"))] == list(range(400, 1000)) and not state and state.n < 100
    state, run = finality(0)
    assert run((7, "a", "event"), (900, "b", "event")) == [("c", 7, "a"), ("c", 900, "b")] and not state


def test_landed_blocks_are_compressed(spark):
    files = [r[0] for r in spark.read.format("binaryFile").load(f"{queries_flow._landed(spark, SF)}/raw").select("path").collect()]
    assert files and all(f.endswith(".json.gz") for f in files)


def test_a_ranges_job_reads_the_raw_blocks_once_for_all_units(spark, tmp_path, monkeypatch):
    asked = []
    counted = lambda f: lambda *a: asked.append(1) or f(*a)
    monkeypatch.setitem(normalize.NORMALIZERS, "evm", (counted(normalize.evm_blocks), counted(normalize.evm_transactions)))
    landed = spark.createDataFrame([(hex(n), "0x64", f"h{n}", "", [(f"t{n}", "0xa", "0xb", "0x1", "0x1", "0x0")]) for n in range(12) if n != 7], raw.schema("evm"))
    queue = spark.createDataFrame([(k, "c", k, k + 1, "pending", 0, "", 1, 0, 0) for k in range(11)], "id long, chain_id string, from_block long, to_block long, status string, attempts int, error_msg string, priority int, created_at long, updated_at long")
    out = jobs.ingest_ranges(queue, landed, "evm", "c", f"{tmp_path}/out", 7, per_unit=2, chunk=1)
    assert {r["id"] for r in out.filter("status = 'pending'").collect()} == {6, 7} and out.filter("status = 'completed'").count() == 9
    made = units.Units(spark, f"{tmp_path}/out")
    assert made.latest == 5 and len(asked) == 2 and made.rows("progress") == 12 and made.rows("blocks") == made.rows("transactions") == 11


def test_ranges_meet_open_spans_by_a_lookup(spark):
    rng = random.Random(5)
    spans, at = [], -40
    while at < 400_000:
        at += rng.choice([1, 2, 9, 150_000])
        spans.append(("c", at, at + rng.choice([0, 3, 30]), rng.randrange(4)))
        at = spans[-1][2]
    asked = [(k, rng.choice("ccd"), f, f + rng.choice([0, 2, 250_000])) for k, f in enumerate([*range(-60, 60), *(rng.randrange(400_000) for _ in range(100))])]
    out = jobs._overlapping(spark.createDataFrame(asked, "id long, chain_id string, from_block long, to_block long"), spark.createDataFrame(spans, "chain_id string, lo long, hi long, attempts int"))
    meets = lambda r, least: any(r[1] == c and lo <= r[3] and r[2] <= hi and n >= least for c, lo, hi, n in spans)
    assert sorted(map(tuple, out.collect())) == sorted((r[0], meets(r, 0), meets(r, 3)) for r in asked)
    assert "BroadcastNestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


def test_receipts_are_parsed_once(spark):
    for df in (payloads.receipts(spark, SF), payloads.tron_infos(spark, SF)):
        key = df.columns[1]
        kept = df.filter(f"{key} IS NOT NULL AND chain_id IS NOT NULL")
        assert kept._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1


def test_transactions_are_gone_through_once_for_the_watch_list(spark):
    cut = {}

    def stage(df, name):
        cut[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return watch.written(df, name)[0]

    out = watch.watch_evm(fx.transactions(spark, SF), fx.wallets(spark, SF), cut=stage)
    assert set(cut) == {"grams", "candidates"} and "lineitem" not in out._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"_words#\d+\w*,? *_gram|Join Inner\n.*_words", cut["candidates"]) and "scalar-subquery" in cut["candidates"]


def test_a_status_by_hash_joins_only_rows_that_may_have_it(spark, tmp_path, monkeypatch):
    joined, marked, at = [], store.set_status, f"{tmp_path}/table"
    monkeypatch.setattr(store, "set_status", lambda old, keys, status: joined.append(old.count()) or marked(old, keys, status))
    rows = spark.range(6000).selectExpr("'c' AS chain_id", "md5(string(id)) AS tx_hash", "id AS block_number", "'success' AS status")
    keys = rows.filter("block_number IN (5, 2999, 3001)").select("chain_id", "tx_hash")
    tables.write_table(rows.filter("block_number >= 0"), at, 1000)
    files = lambda: {str(f) for f in tmp_path.rglob("*.parquet")}
    before = files()
    assert in_place.set_status(at, keys.union(spark.createDataFrame([("c", "none")], keys.schema)), "invalid", 1000) == 3
    got, want = tables.read_table(spark, at), marked(rows, keys, "invalid")
    assert got.count() == 6000 and got.select(*rows.columns).exceptAll(want).isEmpty() and sum(joined) < 100
    assert {f.split("_bucket=")[1][0] for f in before & files()} == {"1", "4", "5"}


def test_hashes_are_made_behind_the_shuffle_by_bucket(spark):
    at, width = queries._stored(spark, fx.transaction_lines(spark, SF), fx.blocks(spark, SF), then=lambda rows: fx.lines_as_transactions(rows, *tables.PART))
    got, want = tables.read_table(spark, at), fx.transactions(spark, SF)
    assert got.columns == want.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_shuffled_files_go_with_their_action(spark):
    shipping.drop_shuffles(spark)
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n.rsplit("/", 1)[-1] for n in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in n}
    before = shuffled()
    shipping.written(spark.range(1000).selectExpr("id", "id % 7 AS k").repartition(3, "k"), "any")
    for _ in range(50):
        if shuffled() <= before:
            break
        time.sleep(0.1)
    assert shuffled() <= before


def test_a_live_batch_writes_few_transactions_beside_the_matched_ones(spark):
    tx = lambda n: (f"t{n}", "0xA" if n % 100 == 7 else "0xz", "0xb", "0x1", "0x1", "0x0")
    landed = spark.createDataFrame([(hex(n), "0x64", f"h{n}", f"h{n - 1}", [tx(n), (f"u{n}", "0xz", "0xy", "0x1", "0x1", "0x1")]) for n in range(300)], raw.schema("evm"))
    empty = lambda schema: spark.createDataFrame([], schema)
    wallets = spark.createDataFrame([("0xa",)], "address string")
    out = jobs.index_batch(landed, "evm", "c", wallets, empty(jobs.BLOCKS), empty(jobs.TRANSACTIONS), empty(jobs.CURSORS), prefilter=True)
    assert sorted(r["tx_hash"] for r in out["transactions"].collect()) == ["t107", "t207", "t7"] and out["blocks"].count() == 300
    work = out["work"].removeprefix("file://")
    sizes = {name: spark.read.parquet(f"{work}/{name}").count() for name in os.listdir(work) if "tx_hash" in spark.read.parquet(f"{work}/{name}").columns}
    assert sizes["matched"] == 3 and sum(sizes.values()) < 30


def test_a_long_batch_touches_each_stretch_once():
    state, job = State(), jobs.Finality(10, 4)
    job.init(state)
    rows = lambda kind, *found: pd.DataFrame([("c", n, t, kind) for n, t in found], columns=["chain_id", "block_number", "tx_hash", "kind"])
    run = lambda *pdfs: [(r.block_number, r.tx_hash) for out in job.handleInputRows(("c", 0), iter(pdfs), None) for r in out.itertuples()]
    sent = [(1024 * i + j, f"t{j}") for j in range(40) for i in range(20)]  # every fourth stretch, each in all of forty frames
    assert run(*(rows("event", *sent[20 * j : 20 * j + 20]) for j in range(40))) == [] and len(state) == 20 and state.n < 50
    assert run(rows("orphan", (1024, ""), (9000, ""))) == []
    state.n = 0
    assert run(rows("head", (1024 * 10 + 10, ""))) == sorted(r for r in sent if r[0] <= 1024 * 10 and r[0] != 1024) and len(state) == 10 and state.n < 60
    assert run(rows("head", (99_999, ""))) == sorted(r for r in sent if r[0] > 1024 * 10) and not state


def test_ranges_are_subtracted_by_their_edges(spark):
    rng = random.Random(8)
    made = lambda: [(c, a, a + rng.randrange(12)) for c in "ab" for a in (rng.randrange(300) for _ in range(25))]
    frame = lambda rows: ranges.merge_ranges(spark.createDataFrame(rows, "chain_id string, from_block long, to_block long"))
    heights = lambda rows: {(c, n) for c, a, z in rows for n in range(a, z + 1)}
    some, gone = made(), made()
    out = [tuple(r) for r in ranges.subtract_ranges(frame(some), frame(gone), 40).collect()]
    assert heights(out) == heights(some) - heights(gone) and sum(z - a + 1 for _, a, z in out) == len(heights(out))
    assert not {(c, z + 1) for c, _, z in out} & {(c, a) for c, a, _ in out}


def test_only_blocks_that_a_run_reaches_meet_the_watch_list(spark, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setitem(jobs.MATCHERS, "evm", lambda txs, wallets, **own: seen.append(txs.count()) or txs)
    landed = spark.createDataFrame([(hex(n), "0x64", f"h{n}", "", [(f"t{n}", "0xa", "0xb", "0x1", "0x1", "0x0")]) for n in range(600)], raw.schema("evm"))
    queue = spark.createDataFrame([(1, "c", 40, 43, "pending", 0, "", 1, 0, 0)], "id long, chain_id string, from_block long, to_block long, status string, attempts int, error_msg string, priority int, created_at long, updated_at long")
    out = jobs.ingest_ranges(queue, landed, "evm", "c", f"{tmp_path}/out", 7, spark.createDataFrame([("0xa",)], "address string"))
    assert out.first()["status"] == "completed" and len(seen) == 1 and 4 <= seen[0] < 60
    assert units.Units(spark, f"{tmp_path}/out").rows("transactions") == 4
