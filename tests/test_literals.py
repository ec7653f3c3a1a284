"""Small cases with known results."""

import random

import pytest
from pyspark.sql import functions as F

from blockweave.functions.numbers import hex_decimal, hex_long
from blockweave.operators import flow, heights, normalize, ranges, reorg, store, telemetry, watch
from blockweave.sources import raw


def values(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_hex(spark):
    texts = ["0x0", "0x1", "0xa", "0xff", "0x12d687", "", "0x", "zz", None, "0xde0b6b3a7640000", "0x" + "f" * 64, "0x" + "0" * 60 + "10", "0x8ac7230489e80000", "0x" + "1" + "0" * 24]
    got = [r[0] for r in frame(spark, "x string", *((t,) for t in texts)).select(hex_decimal(F.col("x"))).collect()]
    number = lambda t: str(int(t, 16)) if t and t not in ("0x", "zz") else "0"
    assert got == [number(t) for t in texts]
    assert [r[0] for r in frame(spark, "x string", ("0x12d687",), ("0x0",), ("zz",), (None,)).select(hex_long(F.col("x"))).collect()] == [1234567, 0, None, None]


def test_hex_of_any_width(spark):
    random.seed(4)
    numbers = [random.getrandbits(random.randint(1, 256)) for _ in range(300)] + [10**k for k in range(0, 77)]
    df = frame(spark, "x string, y string", *((hex(n), str(n)) for n in numbers))
    assert df.filter(hex_decimal(F.col("x")) != F.col("y")).count() == 0


def test_evm(spark):
    df = frame(spark, raw.EVM_BLOCK, ("0x3e8", "0x64", "h", "p", [("0xtx1", "0xAlice", "0xBob", "0x1", "0x3b9aca00", "0x0"), ("0xtx2", "0xCharlie", None, "0x0", "0x1", "0x1")]))
    got = values(normalize.evm_transactions(df, "ethereum"), "tx_hash", "block_number", "from_address", "to_address", "value", "gas_price", "tx_type", "status")
    assert got == [("0xtx1", 1000, "0xalice", "0xbob", "1", "1000000000", "native", "success"), ("0xtx2", 1000, "0xcharlie", "", "0", "1", "native", "success")]


def test_erc20(spark):
    topic = lambda x: "0x" + "0" * 63 + x
    logs = [("0xToken", [normalize.TRANSFER, topic("1"), topic("2")], "0xde0b6b3a7640000")]
    receipts = frame(spark, raw.EVM_RECEIPT, ("c", "0xtx", "0x5208", "0x1", logs))
    wallets = frame(spark, "address string", ("0x" + "0" * 39 + "1",))
    assert values(normalize.evm_erc20_transfers(receipts, wallets), "token", "amount") == [("0xtoken", "1000000000000000000")]


def test_tron(spark):
    def tx(i, kind, ret, **value):
        v = tuple(value.get(c) for c in ("owner_address", "to_address", "amount", "asset_name", "contract_address", "data"))
        return (i, ([(kind, (v,))],), ret)

    call = normalize.TRC20_CALL + "0" * 64 + "0" * 61 + "3e8"
    txs = [
        tx("a", "TransferContract", [("SUCCESS",)], to_address="T2", amount=1000000), tx("b", "TransferAssetContract", [("REVERT",)], asset_name="1002000", amount=5000, to_address="T3"),
        tx("c", "TriggerSmartContract", None, contract_address="TC", data=call), tx("d", "TriggerSmartContract", [], contract_address="TC", data=normalize.TRC20_CALL + "00"), ("e", ([],), None),
    ]
    df = frame(spark, raw.TRON_BLOCK, ("0000000003abc123", ((62345555, "p", 1700000000123),), txs))
    assert values(normalize.tron_blocks(df, "tron"), "block_number", "block_hash", "block_timestamp") == [(62345555, "0000000003abc123", 1700000000)]
    got = values(normalize.tron_transactions(df, "tron"), "tx_hash", "tx_type", "value", "token_address", "status")
    assert got == [("a", "native", "1000000", None, "success"), ("b", "trc10", "5000", "1002000", "failed"), ("c", "trc20", "1000", "TC", "success"), ("d", "contract_call", "0", None, "success")]


def test_bitcoin(spark):
    out = lambda v, a, many=None, kind="key": (v, (a, many, kind, ""))
    import decimal as d

    df = frame(spark, raw.BTC_BLOCK, (800000, "h", None, 5, [("t", [out(d.Decimal("0.5"), "bc1qa"), out(d.Decimal("0.3"), None, ["1x", "1y"]), out(d.Decimal("0"), None, None, "nulldata")])]))
    assert values(normalize.btc_outputs(df, "bitcoin"), "to_address", "value", "from_address") == [("1x", "30000000", ""), ("bc1qa", "50000000", "")]
    assert values(normalize.btc_blocks(df, "bitcoin"), "block_number", "parent_hash") == [(800000, "")]


def test_sui(spark):
    tx = lambda i, changes: (i, ("0xs", (10,)), ((True,), (7, 5), [(("ADDRESS", "0xs"),), (("ADDRESS", "0xr"),)]), changes)
    df = frame(spark, raw.SUI_BLOCK, (123, "digest_123", ("digest_122", 9), [tx("a", [("0xs", normalize.SUI_COIN, "1000")]), tx("b", [("0xs", "0xabc::token::TOKEN", "-500")])]))
    got = values(normalize.sui_transactions(df, "sui"), "tx_hash", "tx_type", "value", "token_address", "token_amount", "to_address", "gas_used")
    assert got == [("a", "native", "1000", None, None, "0xr", 12), ("b", "token", "0", "0xabc::token::TOKEN", "500", "0xr", 12)]
    assert values(normalize.sui_blocks(df, "sui"), "block_number", "block_hash", "parent_hash") == [(123, "digest_123", "digest_122")]


BLOCK = "chain_id string, block_number long, block_hash string, parent_hash string"


def chain(spark, numbers, broken=()):
    return frame(spark, BLOCK, *(("c", n, f"h{n}", "other" if n in broken else f"h{n - 1}") for n in numbers))


def test_parent_hash(spark):
    stored = chain(spark, [999, 1000])
    new = frame(spark, BLOCK, ("c", 1001, "x", "h1000"), ("c", 1001, "y", "zz"), ("d", 5, "x", "p"), ("c", 0, "x", ""))
    assert values(reorg.check_parent_hash(new, stored), "block_number", "verdict") == [(0, "genesis"), (1001, "match"), (1001, "mismatch"), (5, "absent")]


def walk(rows, n):
    k, depth = n - 1, 1
    while True:
        if k not in rows:
            return k, "", depth
        if k == 0:
            return 0, "", depth
        if k - 1 not in rows:
            return k - 1, "", depth
        if rows[k][1] == rows[k - 1][0]:
            return k - 1, rows[k - 1][0], depth
        k, depth = k - 1, depth + 1


@pytest.mark.parametrize("width", [7, heights.BUCKET])
def test_safe_point_is_the_walk(spark, width):
    random.seed(1)
    numbers = [n for n in range(200) if random.random() > 0.1]
    broken = {n for n in numbers if random.random() < 0.3}
    df = chain(spark, numbers, broken)
    rows = {n: (f"h{n}", "other" if n in broken else f"h{n - 1}") for n in numbers}
    at = frame(spark, "chain_id string, block_number long", *(("c", n) for n in range(1, 201)))
    got = {r["block_number"]: (r["safe_block"], r["safe_hash"], r["depth"]) for r in reorg.safe_point(at, df, width=width).collect()}
    assert got == {n: walk(rows, n) for n in range(1, 201)}
    gaps = values(ranges.find_gaps(df, width=width), "from_block", "to_block")
    assert [x for a, b in sorted(gaps) for x in range(a, b + 1)] == [n for n in range(numbers[0], numbers[-1]) if n not in rows]


def test_rollback(spark):
    b = chain(spark, range(90, 101), {96, 97, 98, 99, 100}).withColumn("status", F.lit("processed"))
    t = frame(spark, "chain_id string, tx_hash string, block_number long, status string", ("c", "a", 97, "success"), ("c", "b", 91, "success"))
    c = frame(spark, "chain_id string, block_number long, block_hash string, state string", ("c", 100, "x", "reorg"))
    points = reorg.safe_point(frame(spark, "chain_id string, block_number long", ("c", 101)), b)
    assert values(points, "safe_block", "safe_hash", "depth") == [(94, "h94", 6)]
    blocks, txs, cursors, counts = reorg.reorg_rollback(points, b, t, c)
    assert blocks.filter("status = 'orphaned'").count() == 6
    assert values(txs, "tx_hash", "status") == [("a", "invalid"), ("b", "success")]
    assert values(cursors, "block_number", "state") == [(94, "scanning")]
    assert values(counts, "n_blocks", "n_transactions") == [(6, 1)]
    assert reorg.reorg_rollback(points, b, t, c, single_step=True)[0].filter("status = 'orphaned'").count() == 1


@pytest.mark.parametrize("width", [5, heights.BUCKET])
def test_merge_ranges(spark, width):
    random.seed(2)
    rows = [(c, a, a + random.randint(0, 6)) for c in "xy" for a in random.sample(range(300), 60)]
    expected = []
    for c in "xy":
        out = []
        for _, a, b in sorted(r for r in rows if r[0] == c):
            if out and a <= out[-1][2] + 1:
                out[-1] = (c, out[-1][1], max(out[-1][2], b))
            else:
                out.append((c, a, b))
        expected += out
    df = frame(spark, "chain_id string, from_block long, to_block long", *rows)
    assert values(ranges.merge_ranges(df, width), "chain_id", "from_block", "to_block") == sorted(expected, key=repr)


def test_gaps_and_ranges(spark):
    cursor = frame(spark, "chain_id string, block_number long", ("c", 1000))
    at = lambda n: frame(spark, "chain_id string, block_number long", ("c", n))
    assert values(ranges.cursor_gaps(at(1005), cursor), "from_block", "to_block") == [(1001, 1004)]
    assert ranges.cursor_gaps(at(1001), cursor).count() == 0
    r = frame(spark, "chain_id string, from_block long, to_block long", ("c", 100, 102))
    assert values(ranges.expand_ranges(r), "block_number") == [(100,), (101,), (102,)]
    text = frame(spark, "t string", ("5-9",), ("9-5",), ("5-9x",), (None,))
    assert values(ranges.parse_ranges(text, "t"), "t", "from_block", "error") == [("5-9", 5, None), ("5-9x", None, "invalid range"), ("9-5", None, "start after end"), (None, None, "invalid range")]


def test_finality(spark):
    e = frame(spark, "chain_id string, block_number long", ("c", 100), ("c", 101))
    head = lambda n: frame(spark, "chain_id string, head long", ("c", n))
    assert flow.finality_batch(e, head(105), 10)[0].count() == 0
    assert values(flow.finality_batch(e, head(110), 10)[0], "block_number") == [(100,)]
    assert values(flow.finality_batch(e, head(110), 10)[1], "block_number") == [(101,)]
    assert flow.finality_batch(e, head(0), 0)[0].count() == 2
    assert values(flow.finality_discard(e, e.filter("block_number = 100")), "block_number") == [(101,)]


def test_cursor(spark):
    pairs = [("init", "scanning", True), ("scanning", "reorg", True), ("backfill", "reorg", False), ("paused", "catchup", True), ("reorg", "paused", False), ("scanning", "init", False)]
    log = frame(spark, "from_state string, to_state string, ok boolean", *pairs)
    assert flow.validate_transitions(log).filter("valid <> ok").count() == 0
    def fold(start, *c):
        commits = frame(spark, "chain_id string, seq long, block_number long, block_hash string", *(("c", i, *x) for i, x in enumerate(c)), ("new", 0, 7, "z"))
        cursors = frame(spark, "chain_id string, block_number long, block_hash string, state string", ("c", *start))
        return [r["outcome"] for r in flow.cursor_fold(commits, cursors).filter("chain_id = 'c'").orderBy("seq").collect()]

    assert fold((1000, "h", "scanning"), (1001, "a"), (1001, "a"), (1001, "b"), (900, "x"), (1005, "y")) == ["advance", "duplicate", "hash_mismatch", "stale", "gap"]
    assert fold((1000, "h", "paused"), (1001, "a")) == ["paused"]
    assert fold((1000, "h", "reorg"), (1001, "a")) == ["reorg"]
    got = telemetry.chain_lag(frame(spark, "chain_id string, block_number long", ("c", 1000)), frame(spark, "chain_id string, head long", ("c", 1100), ("d", 7)))
    assert values(got, "chain_id", "lag") == [("c", 100), ("d", 7)]


def test_catchup(spark):
    lag = frame(spark, "chain_id string, lag long, latency_s double", ("a", 0, 0.5), ("b", 3, 0.5), ("c", 20, 0.5), ("d", 100, 0.5), ("e", 100, 3.0), ("f", 5, 0.5), ("g", 50, 0.5), ("h", 200, 0.5))
    got = {r["chain_id"]: (r["interval_s"], r["batch_size"]) for r in telemetry.catchup_plan(lag).collect()}
    assert [got[c][0] for c in "abcd"] == [12, 6, 1, 0.5]
    assert [got[c][1] for c in "afghe"] == [1, 3, 10, 20, 1]


def test_retries(spark):
    q = frame(spark, "id long, chain_id string, block_number long, retry_count int, last_attempt long, status string, error_msg string", *((i, "c", i, n, 0, "pending", "x") for i, n in enumerate((0, 1, 2, 10))))
    assert values(flow.due_retries(q, 1000), "id", "delay") == [(0, 2.0), (1, 4.0), (2, 8.0), (3, 60.0)]
    assert values(flow.retry_verdict(q), "id", "verdict") == [(0, "retry"), (1, "retry"), (2, "retry"), (3, "stop")]


def test_error_classes(spark):
    cases = {
        "HTTP 429 Too Many Requests": "failover", "403 Forbidden": "failover", "daily quota exceeded": "failover", "plan limit reached": "failover", "Unauthorized": "failover", "code -32601: method not found": "fatal", "error -32602": "fatal", "-32700 parse error": "fatal",
        "connection refused": "retry", "timeout": "retry", "rpc error: code = Unavailable": "retry", "rpc error: code = InvalidArgument": "fatal", "rpc error: code = ResourceExhausted": "failover",
    }
    df = frame(spark, "t string", *((t,) for t in cases))
    assert {r[0]: r[1] for r in df.select("t", flow.error_class(F.col("t"))).collect()} == cases


def test_health(spark):
    heads = frame(spark, "chain_id string, head long", ("a", 1005), ("b", 1050), ("c", 1200))
    cursors = frame(spark, "chain_id string, block_number long", ("a", 1000), ("b", 1000), ("c", 1000))
    none = frame(spark, "chain_id string, status string")
    up = frame(spark, "chain_id string, available boolean", ("a", True), ("b", True), ("c", True))
    h = telemetry.chain_health(cursors, heads, none, none, up)
    assert values(h, "chain_id", "health") == [("a", "healthy"), ("b", "degraded"), ("c", "critical")]
    assert values(telemetry.system_status(h), "status") == [("critical",)]


def test_watch(spark):
    w = frame(spark, "address string", ("0x123",), ("0xabc",), ("0xdef",))
    s = watch.watchlist(w)
    assert s.count() == 3 and s.filter(F.col("address") == F.lower(F.lit("0X123"))).count() == 1
    assert watch.watchlist(w, remove=frame(spark, "address string", ("0x123",))).count() == 2
    tx = "chain_id string, tx_hash string, block_number long, from_address string, to_address string, raw_data string"
    t = frame(spark, tx, ("c", "1", 1, "0xABC", "x", "{}"), ("c", "2", 1, "y", "0xdef", "{}"), ("c", "3", 1, "y", "z", '{"type":"ERC20"}'), ("c", "4", 1, "y", "z", "{}"))
    for mode in ("calldata", "exact", "none"):
        assert values(watch.watch_evm(t, w, mode), "tx_hash") == [("1",), ("2",), ("3",)]
    long = frame(spark, "address string", ("0x" + "a1" * 20,))
    p = frame(spark, tx, ("c", "5", 1, "y", "z", "0xa9059cbb" + "0" * 24 + "A1" * 20))
    assert watch.watch_evm(p, long, "calldata").count() == 1 and watch.watch_evm(p, long, "exact").count() == 1


def test_bloom_loses_nothing(spark):
    keys = spark.range(3000).selectExpr("'K' || id AS address")
    bloom = watch.bloom_build(keys)
    assert watch.bloom_prefilter(keys, "address", bloom).count() == 3000
    others = spark.range(3000).selectExpr("'other' || id AS address")
    assert watch.bloom_prefilter(others, "address", bloom).count() < 150
    assert watch.bloom_prefilter(others, "address", watch.bloom_build(keys.limit(0))).count() == 3000


def test_first_wins(spark):
    t = frame(spark, "chain_id string, tx_hash string, block_number long, tx_index int, value string", ("c", "a", 1, 2, "late"), ("c", "a", 1, 1, "early"), ("c", "b", 1, 0, "b"))
    once = store.insert_transactions(None, t)
    assert values(once, "tx_hash", "value") == [("a", "early"), ("b", "b")]
    assert values(store.insert_transactions(once, t), "tx_hash", "value") == [("a", "early"), ("b", "b")]


CALLS = "event_id long, ts long, chain_id string, provider string, latency_ms double, ok boolean, status_code int, error_msg string"


def test_circuits(spark):
    def calls(provider, *outcomes):
        return [(i, t, "c", provider, 1.0, e is None, 200 if e is None else 500, e or "") for i, (t, e) in enumerate(outcomes)]

    rows = calls("a", *((t, "timeout") for t in range(4)), (5, "Height out of range"), (6, "block NOT FOUND"), (7, "timeout"), (9, "not found"), (12, "timeout"), (40, None), (41, "timeout"))
    rows += calls("b", *((t, "timeout") for t in range(4)), (5, None), *((t, "timeout") for t in range(6, 10)))
    rows += calls("d", *((t, "timeout") for t in range(100, 106)))
    df = frame(spark, CALLS, *rows)
    for width in (3, 86_400):
        assert values(telemetry.circuit_events(df, width=width), "provider", "opened_at", "last_failure_at", "probe_at", "closed_at") == [("a", 7, 12, 72, 40), ("d", 104, 105, 165, None)]
    stats = frame(spark, "provider string, status string, usage_percent double", *((p, "healthy", 1.0) for p in "abd"))
    served = frame(spark, "chain_id string, provider string", *(("c", p) for p in "abd"))
    usable = lambda now: {r["provider"] for r in telemetry.eligible_providers(stats, served, telemetry.circuit_events(df.filter(F.col("ts") <= now)), now).filter("eligible").collect()}
    assert usable(20) == {"b", "d"} and usable(50) == {"a", "b", "d"} and usable(165) == {"a", "b"} and usable(166) == {"a", "b", "d"}


def test_windows_in_buckets(spark):
    random.seed(2)
    rows = [(i, random.randrange(1000), "c", random.choice("pq"), float(random.randrange(99)), random.random() < 0.8, 200, "") for i in range(600)]
    got = {r["event_id"]: r["latency_ms"] for r in telemetry.rolling_latency(frame(spark, CALLS, *rows), n=7, width=50).collect()}
    for p in "pq":
        mine = sorted((r for r in rows if r[3] == p and r[5]), key=lambda r: (r[1], r[0]))
        for k, r in enumerate(mine):
            last = [x[4] for x in mine[max(0, k - 6) : k + 1]]
            assert abs(got[r[0]] - sum(last) / len(last)) < 1e-6
    lags = {t: random.choice([50, 1500, 2500]) for t in random.sample(range(2000), 300)}
    samples = frame(spark, "chain_id string, ts long, lag long", *(("c", t, x) for t, x in lags.items()))
    high, before, want = 0, None, []
    for t in sorted(lags):
        high = high + 1 if lags[t] > 1000 else 0
        growing = before is None or lags[t] >= before
        want.append((t, growing, high, lags[t] > 1000 and (growing or high >= 3)))
        before = lags[t]
    assert values(telemetry.lag_trend(samples, width=70), "ts", "growing", "high", "triggered") == sorted(want, key=repr)
    fires = [t for t in lags if min(lags) <= t - 40 and min(lags[u] for u in lags if t - 40 <= u <= t) > 1000]
    assert sorted(r["ts"] for r in telemetry.alert_lag(samples, 1000, 40, width=60).collect()) == sorted(fires)


TX = "chain_id string, tx_hash string, block_number long, from_address string, to_address string, raw_data string"


def test_watch_evm_looks_into_raw_data(spark):
    a, other = "0x" + "Ab" * 20, "T" + "z" * 33
    wallets = frame(spark, "address string", (a,), (other,), ("0xshort",))
    raws = {"none": "{}", "within": '{"input":"0xA9059CBB' + "00" * 12 + "AB" * 20 + 'ff"}', "odd": '{"x":"1' + "aB" * 20 + '2"}', "text": '{"to":"' + other.lower() + '"}', "short": '{"to":"0xshort"}', "erc20": '{"type":"ERC20"}', "many": '{"type":"ERC20_MULTIPLE"}', "word": '{"note":"ERC20"}', "broken": "ERC20", "null": None}
    txs = frame(spark, TX, *(("c", k, 1, "0xf", "0xt", v) for k, v in raws.items()), ("c", "from", 1, a.upper().replace("X", "x"), "0xt", None), ("c", "to", 1, "0xf", a.lower(), "{}"))
    assert {r["tx_hash"] for r in watch.watch_evm(txs, wallets).collect()} == {"within", "odd", "text", "erc20", "from", "to"}
    assert {r["tx_hash"] for r in watch.watch_evm(txs, wallets, raw=False).collect()} == {"from", "to"}


def test_watched_texts_of_any_kind_are_found_in_raw_data(spark):
    rng = random.Random(3)
    kinds = ["abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ123456789", "sS", "0", "ab cd", "0123456789abcdef", 'x"y z', "éäß\U0001f600q"]
    texts = [("0x" if rng.random() < 0.5 else "") + "".join(rng.choices(rng.choice(kinds), k=rng.randint(24, 45))) for _ in range(80)] + ["c" + "0" * 36 + f"{k:03}" for k in range(60)]
    noise = lambda: "".join(rng.choices(rng.choice(kinds), k=rng.randint(0, 60)))
    raws = [noise() + rng.choice([str.upper, str.lower, str])(rng.choice(texts))[rng.choice([0, 0, 2]) :][: rng.choice([99, 99, 30])] + noise() for _ in range(300)] + ["0" * 500, None, ""]
    txs = frame(spark, TX, *(("c", str(k), 1, "0xf", "0xt", r) for k, r in enumerate(raws)))
    low = lambda t: "".join(c.lower() for c in t)
    want = {str(k) for k, r in enumerate(raws) if any(len(t) >= 30 and low(t).removeprefix("0x") in low(r or "") for t in texts)}
    wallets = frame(spark, "address string", *((t,) for t in texts))
    assert {r["tx_hash"] for r in watch.watch_evm(txs, wallets).collect()} == want and 100 < len(want) < 290
    grams = watch.rarest_grams(watch.watchlist(wallets))
    own = grams.filter("watched_text LIKE 'c000%'")
    assert own.count() == own.select("gram").distinct().count() == 60  # what all of them share isn't looked for


@pytest.mark.parametrize("disorder", [0, 3, 400])
def test_a_log_folded_in_pieces_is_folded_as_one(spark, disorder):
    rng = random.Random(disorder)
    rows, start = [], {"a": (5, "h5", "scanning"), "b": (7, "h7", "paused"), "d": (0, "h0", "reorg"), "e": (90, "x", "catchup")}
    for chain in "abcde":
        numbers = sorted((k % 200 + rng.randrange(2) * (k % 31 == 0) for k in range(300)), key=lambda k: k + rng.uniform(0, disorder))
        rows += [(chain, i // 2, n, f"{rng.choice('hhhx')}{n}") for i, n in enumerate(numbers)]
    commits = frame(spark, "chain_id string, seq long, block_number long, block_hash string", *rows)
    cursors = frame(spark, "chain_id string, block_number long, block_hash string, state string", *((c, *s) for c, s in start.items()))
    want, now = [], dict(start)
    for chain, seq, n, hash_ in sorted(rows):
        now[chain], outcome = flow.step(now.get(chain), n, hash_)
        want.append((chain, seq, n, outcome, *now[chain][:2]))
    got = flow.cursor_fold(commits, cursors, segments=8)
    same = lambda x: sorted(map(repr, x))
    assert same(tuple(r) for r in got.collect()) == same(want) and len({w[3] for w in want}) >= 5
    pieces = flow._cut_log(commits, 8).groupBy("chain_id").agg(F.count_distinct("node").alias("n"))
    assert {r["n"] for r in pieces.collect()} == {8}  # one chain spreads over all of its pieces


def test_bloom_grows_with_its_keys(spark):
    keys = spark.range(30_000).selectExpr("concat('0xA', id) AS address")
    bloom = watch.bloom_build(keys)
    assert bloom.agg(F.max("size")).first()[0] == 300_000
    assert watch.bloom_prefilter(keys.select(F.lower("address").alias("a")), "a", bloom).count() == 30_000
    assert watch.bloom_prefilter(spark.range(20_000).selectExpr("concat('0xB', id) AS a"), "a", bloom).count() < 400
    assert watch.bloom_prefilter(keys, "address", watch.bloom_build(keys.limit(0))).count() == 30_000


def test_wide_ranges_are_cut(spark):
    wide = frame(spark, "chain_id string, from_block long, to_block long", ("c", 5, 250_004), ("d", 9, 8))
    assert ranges.expand_ranges(wide).agg(F.count("*"), F.min("block_number"), F.max("block_number"), F.count_distinct("block_number")).first()[:] == (250_000, 5, 250_004, 250_000)
    assert values(ranges.split_ranges(wide, 100_000), "from_block", "to_block") == [(100_005, 200_004), (200_005, 250_004), (5, 100_004)]


def test_gap_jump_in_the_live_batch(spark):
    from blockweave.streaming import jobs

    raws = frame(spark, raw.EVM_BLOCK, *((hex(n), "0x64", f"h{n}", f"h{n - 1}", []) for n in (500, 501)))
    empty = lambda schema: spark.createDataFrame([], schema)
    cursors = frame(spark, jobs.CURSORS, ("c", 10, "h10", "scanning", 0, 0))
    run = lambda jump: jobs.index_batch(raws, "evm", "c", frame(spark, "address string", ("0xa",)), empty(jobs.BLOCKS), empty(jobs.TRANSACTIONS), cursors, jump=jump)
    done = run(100)
    assert values(done["missing"], "from_block", "to_block") == [(11, 501)] and done["blocks"].count() == 0
    assert values(done["cursors"], "block_number", "block_hash") == [(501, "")]
    waits = run(1000)  # without a jump the cursor stays at the hole, which is queued
    assert values(waits["cursors"], "block_number", "block_hash") == [(10, "h10")] and values(waits["missing"], "from_block", "to_block") == [(11, 499)] and waits["blocks"].count() == 2


def test_a_deep_reorganisation_stops_the_live_batch(spark):
    from blockweave.streaming import jobs

    stored = [("c", n, f"x{n}", "other", 0, "processed", 0) for n in range(1, 9)]
    raws = frame(spark, raw.EVM_BLOCK, ("0x9", "0x64", "h9", "h8", []))
    done = jobs.index_batch(raws, "evm", "c", frame(spark, "address string", ("0xa",)), frame(spark, jobs.BLOCKS, *stored), spark.createDataFrame([], jobs.TRANSACTIONS), frame(spark, jobs.CURSORS, ("c", 8, "x8", "scanning", 0, 0)), max_depth=3)
    assert done["blocks"].count() == 0 and values(done["cursors"], "block_number") == [(8,)]
    assert values(done["reorgs"], "block_number", "too_deep") == [(9, True)]
