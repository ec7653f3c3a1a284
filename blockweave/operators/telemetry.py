"""Lag, health, metrics and alerts of chains, and analytics of a log of RPC calls.

Calls are (event_id, ts in seconds, chain_id, provider, latency_ms, ok, status_code, error_msg).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .heights import running, with_last, with_previous
from .ranges import merge_ranges

#: Bucket limits of histograms.
BUCKETS = {"reorg_depth": (1, 2, 5, 10, 20, 50, 100), "batch_size": (1, 5, 10, 25, 50, 100, 250, 500), "gap_jump": (100, 1000, 5000, 10000, 50000, 100000), "latency_s": (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)}
#: Texts that tell of throttling, and how long a 429 and a 403 hold.
THROTTLE_TEXTS = ("rate limit exceeded", "too many requests", "daily request count exceeded", "project rate limit", "monthly quota exceeded")
HOLD_429, HOLD_403 = 60, 600
DAY, HOUR = 86_400, 3600


def _z(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def chain_lag(cursors: DataFrame, heads: DataFrame) -> DataFrame:
    """head - cursor, not under 0; a chain without a cursor lags by its head."""
    at = cursors.select("chain_id", F.col("block_number").alias("at"))
    return heads.join(at, "chain_id", "left").select("chain_id", "head", F.greatest(F.col("head") - _z("at"), F.lit(0)).alias("lag"))


def _level(critical: Column, degraded: Column) -> Column:
    return F.when(critical, F.lit("critical")).when(degraded, F.lit("degraded")).otherwise(F.lit("healthy"))


def chain_health(cursors: DataFrame, heads: DataFrame, missing: DataFrame, failed: DataFrame, available: DataFrame) -> DataFrame:
    """available (chain_id, available); the queues count pending rows."""
    count = lambda df, name: df.filter("status = 'pending'").groupBy("chain_id").agg(F.count("*").alias(name))
    j = chain_lag(cursors, heads).join(count(missing, "n_missing"), "chain_id", "left").join(count(failed, "n_failed"), "chain_id", "left").join(available, "chain_id", "left")
    j = j.select("chain_id", "lag", _z("n_missing").alias("n_missing"), _z("n_failed").alias("n_failed"), F.coalesce("available", F.lit(False)).alias("available"))
    critical = ~F.col("available") | (F.col("lag") > 100) | (F.col("n_missing") > 10) | (F.col("n_failed") > 50)
    return j.withColumn("health", _level(critical, (F.col("lag") > 10) | (F.col("n_missing") > 0) | (F.col("n_failed") > 0)))


def system_status(health: DataFrame) -> DataFrame:
    """The worst chain's health."""
    worst = F.max(F.when(F.col("health") == "critical", 2).when(F.col("health") == "degraded", 1).otherwise(0))
    return health.agg(F.when(worst == 2, "critical").when(worst == 1, "degraded").otherwise("healthy").alias("status"))


def lag_trend(samples: DataFrame, threshold: int = 1000, checks: int = 3, width: int = 7 * DAY) -> DataFrame:
    """samples (chain_id, ts, lag): growing unless under the one before; high counts the checks above the threshold in a row."""
    s = with_previous(samples.withColumn("block_number", F.col("ts")), F.col("lag"), "_prior", width)
    s = running(s, ["chain_id"], "ts", ["ts"], F.lit(1).cast("long"), "_i", width)
    s = with_last(s, F.when(F.col("lag") <= threshold, F.col("_i")), "_low", width)
    s = s.withColumn("growing", F.coalesce(F.col("lag") >= F.col("_prior"), F.lit(True)))
    s = s.withColumn("high", F.when(F.col("lag") > threshold, F.col("_i") - F.coalesce("_low", F.lit(0))).otherwise(F.lit(0)).cast("long"))
    return s.select("chain_id", "ts", "lag", "growing", "high", ((F.col("lag") > threshold) & (F.col("growing") | (F.col("high") >= checks))).alias("triggered"))


def catchup_plan(lag: DataFrame, base: float = 12.0, low: float = 0.5, high: float = 60.0, normal: int = 5, burst: int = 50, least: int = 1, most: int = 20, enabled: bool = True) -> DataFrame:
    """lag (chain_id, lag, latency_s): seconds between scans and blocks of a batch."""
    x, slow = F.col("lag"), F.col("latency_s") > 2
    wait = F.when(x <= 0, F.lit(base)).when(x < normal, F.lit(base / 2)).when(x < burst, F.lit(2 * low)).otherwise(F.lit(low))
    size = F.when(slow, F.lit(least)).when(x <= 0, F.lit(1)).when(x < 10, F.least(F.lit(3), F.lit(most))).when(x < 100, F.least(F.lit(10), F.lit(most))).otherwise(F.lit(most))
    return lag.select("chain_id", "lag", (F.least(F.greatest(wait, F.lit(low)), F.lit(high)) if enabled else F.lit(base)).alias("interval_s"), (F.least(F.greatest(size, F.lit(least)), F.lit(most)) if enabled else F.lit(1)).alias("batch_size"))


def counters(blocks: DataFrame, txs: DataFrame, matched: DataFrame, reorgs: DataFrame, jumps: DataFrame, queue: DataFrame) -> DataFrame:
    count = lambda df, name: df.groupBy("chain_id").agg(F.count("*").alias(name))
    parts = [count(blocks, "n_blocks"), count(txs, "n_transactions"), count(matched, "n_matched"), count(reorgs, "n_reorgs"), count(jumps, "n_jumps"), count(queue.filter("status = 'completed'"), "n_backfilled")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "chain_id", "left")
    names = [p.columns[1] for p in parts]
    return out.select("chain_id", *(_z(n).alias(n) for n in names), (_z("n_transactions") - _z("n_matched")).alias("n_filtered"))


def histogram(df: DataFrame, column: str, limits: tuple, by: list[str]) -> DataFrame:
    """Rows at most each limit, the last without limit (le null); with sum and count of the group."""
    x = F.col(column)
    arms = F.array(*(F.struct(F.lit(float(v)).alias("le"), (x <= v).cast("long").alias("hit")) for v in limits), F.struct(F.lit(None).cast("double").alias("le"), F.lit(1).cast("long").alias("hit")))
    rows = df.filter(x.isNotNull()).select(*by, x.cast("double").alias("_x"), F.explode(arms).alias("a"))
    return rows.groupBy(*by, F.col("a.le").alias("le")).agg(F.sum("a.hit").alias("n"), F.round(F.sum("_x"), 4).alias("total"), F.count("*").alias("n_all"))


def bucket_start(ts: Column, seconds: int) -> Column:
    return ts - F.pmod(ts, F.lit(seconds))


def increase(samples: DataFrame, seconds: int, by: list[str]) -> DataFrame:
    """samples (ts, value): growth of a counter in each window, and a second."""
    at = bucket_start(F.col("ts"), seconds).alias("window_start")
    out = samples.groupBy(*by, at).agg(F.round(F.sum("value"), 4).alias("increase"))
    return out.withColumn("rate", F.round(F.col("increase") / seconds, 6))


def alert_lag(samples: DataFrame, limit: int, seconds: int, width: int = DAY) -> DataFrame:
    """Samples (chain_id, ts, lag) at which the lag has been above a limit for so many seconds.

    Samples are cut into buckets of time, not shorter than the seconds; a bucket also sees the end of the one before.
    """
    width = max(width, seconds)
    own, tail = F.expr(f"ts div {width}"), F.expr(f"ts % {width} >= {width - seconds}")
    seen = samples.withColumn("_own", own).withColumn("_bucket", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    held = F.min("lag").over(W.partitionBy("chain_id", "_bucket").orderBy("ts").rangeBetween(-seconds, 0)) > limit
    first = samples.groupBy("chain_id").agg(F.min("ts").alias("_first"))
    fires = seen.withColumn("_held", held).filter("_held AND _bucket = _own").join(first, "chain_id").filter(F.col("_first") <= F.col("ts") - seconds)
    return fires.select("chain_id", "ts", "lag")


def sliding(df: DataFrame, seconds: int, step: int) -> DataFrame:
    """Each row once for every window [end - seconds, end) it is in; windows end at multiples of step."""
    first = bucket_start(F.col("ts"), step) + step
    return df.select("*", F.explode(F.transform(F.sequence(F.lit(0), F.lit(seconds // step - 1)), lambda i: first + i * step)).alias("window_end"))


def alert_states(true: DataFrame, labels: list[str], step: int, hold: int, until: int | None = None) -> DataFrame:
    """(labels, pending_at, firing_at, resolved_at): the alerts of a rule that is evaluated every step seconds.

    true (labels, window_end) are the evaluations at which the rule's condition is met. An alert is pending from the first of
    them, fires at the first evaluation at which the condition has been met for hold seconds, and is resolved by the first at
    which it is not. An alert that never fires has no firing_at, one that still stands at the moment until no resolved_at.
    """
    at = F.expr(f"window_end div {step}")
    spans = merge_ranges(true.select(F.struct(*labels).alias("chain_id"), at.alias("from_block"), at.alias("to_block")))
    fires = F.col("from_block") + -(-hold // step)
    end = (F.col("to_block") + 1) * step
    return spans.select(*(F.col(f"chain_id.{c}").alias(c) for c in labels), (F.col("from_block") * step).alias("pending_at"), F.when(fires <= F.col("to_block"), fires * step).alias("firing_at"), (end if until is None else F.when(end <= until, end)).alias("resolved_at"))


def error_windows(calls: DataFrame, seconds: int = 300, step: int = 60, percent: float = 10) -> DataFrame:
    """(chain_id, provider, window_end, n_calls, n_errors) of the windows in which more than percent of a provider's calls on a chain fail."""
    g = sliding(calls.select("chain_id", "provider", "ts", "ok"), seconds, step).groupBy("chain_id", "provider", "window_end").agg(F.count("*").alias("n_calls"), F.count_if(~F.col("ok")).alias("n_errors"))
    return g.filter(F.col("n_errors") * 100 > F.col("n_calls") * percent)


def alert_error_rate(calls: DataFrame, seconds: int = 300, step: int = 60, percent: float = 10, hold: int = 300) -> DataFrame:
    """Alerts of each provider and chain: more than percent of the calls of the last seconds fail, held for hold seconds."""
    return alert_states(error_windows(calls, seconds, step, percent), ["chain_id", "provider"], step, hold)


def alert_reorgs(reorgs: DataFrame, seconds: int = 3600, step: int = 60, limit: float = 5, hold: int = 0) -> DataFrame:
    """Alerts of each chain: more than a number of reorgs (chain_id, ts) in the last seconds, held for hold seconds."""
    windows = sliding(reorgs.select("chain_id", "ts"), seconds, step).groupBy("chain_id", "window_end").agg(F.count("*").alias("n_reorgs"))
    return alert_states(windows.filter(F.col("n_reorgs") > limit), ["chain_id"], step, hold)


#: Reorganisations a second over 30 minutes, held for 10.
REORG_RATE, REORG_SECONDS, REORG_HOLD = 0.1, 1800, 600


def alert_reorg_rate(reorgs: DataFrame) -> DataFrame:
    """Alerts of each chain: reorganisations come at more than REORG_RATE a second over the last half hour, held for ten minutes."""
    return alert_reorgs(reorgs, REORG_SECONDS, 60, REORG_RATE * REORG_SECONDS, REORG_HOLD)


def alert_quota(usage: DataFrame, percent: float = 10, least: int = 1000) -> DataFrame:
    """Limited providers with under percent of their quota left, and under least calls."""
    low = F.col("remaining") * 100 < F.col("daily_limit") * percent
    return usage.filter(F.col("daily_limit") > 0).select("provider", "day", "remaining", low.alias("low_percent"), (F.col("remaining") < least).alias("low_calls")).filter("low_percent OR low_calls")


def alert_stalled(chains: DataFrame, commits: DataFrame, now: int, seconds: int = 300) -> DataFrame:
    """Chains without a commit (chain_id, ts) in the last seconds."""
    fresh = commits.filter(F.col("ts").between(now - seconds, now)).select("chain_id").distinct()
    return chains.select("chain_id").distinct().join(fresh, "chain_id", "left_anti")


def panel_chain_status(cursors: DataFrame, heads: DataFrame, queue: DataFrame, available: DataFrame, jumps: DataFrame, now: int) -> DataFrame:
    """jumps (chain_id, ts); bands of colour at lags of 10 and 100 and queues of 100 and 1000."""
    pending = queue.filter("status = 'pending'").groupBy("chain_id").agg(F.count("*").alias("queue"))
    recent = jumps.filter(F.col("ts").between(now - HOUR, now)).groupBy("chain_id").agg(F.count("*").alias("jumps"))
    j = chain_lag(cursors, heads).join(cursors.select("chain_id", F.col("block_number").alias("indexed")), "chain_id", "left").join(pending, "chain_id", "left").join(available, "chain_id", "left").join(recent, "chain_id", "left")
    band = lambda c, a, b: F.when(c < a, "green").when(c < b, "yellow").otherwise("red")
    return j.select("chain_id", "head", _z("indexed").alias("indexed"), "lag", band(F.col("lag"), 10, 100).alias("lag_band"), _z("queue").alias("queue"), band(_z("queue"), 100, 1000).alias("queue_band"), F.coalesce("available", F.lit(False)).alias("available"), _z("jumps").alias("jumps_1h"))


def panel_provider_status(calls: DataFrame, seconds: int = 300) -> DataFrame:
    g = calls.groupBy("chain_id", "provider", bucket_start(F.col("ts"), seconds).alias("window_start")).agg(F.round(F.avg("latency_ms"), 4).alias("latency_ms"), F.round(F.avg((~F.col("ok")).cast("double")) * 100, 4).alias("error_percent"), F.round(F.count("*") / seconds, 6).alias("per_second"))
    return g.withColumn("unhealthy", (F.col("error_percent") > 5) | (F.col("latency_ms") > 1000))


def quota_usage(calls: DataFrame, policy: DataFrame) -> DataFrame:
    """Calls of each provider and UTC day against its daily limit; 0 is no limit."""
    g = calls.groupBy("provider", F.expr(f"ts div {DAY}").alias("day")).agg(F.count("*").alias("used"))
    j = g.join(policy.select("provider", "daily_limit"), "provider", "left").withColumn("daily_limit", _z("daily_limit"))
    free = F.col("daily_limit") == 0
    return j.select("provider", "day", "used", "daily_limit", F.when(free, F.lit(999_999)).otherwise(F.greatest(F.col("daily_limit") - F.col("used"), F.lit(0))).alias("remaining"), F.when(free, F.lit(0.0)).otherwise(F.round(F.col("used") * 100.0 / F.col("daily_limit"), 4)).alias("percent"))


def calls_this_hour(calls: DataFrame) -> DataFrame:
    return calls.groupBy("provider", bucket_start(F.col("ts"), HOUR).alias("hour")).agg(F.count("*").alias("n_calls"))


def over_limit(calls: DataFrame, policy: DataFrame) -> DataFrame:
    """Calls past the daily limit, or past the limit of their interval, in order of time."""
    j = calls.join(policy, "provider").withColumn("_day", F.expr(f"ts div {DAY}")).withColumn("_slot", F.when(F.col("interval_seconds") > 0, F.expr("ts div nullif(interval_seconds, 0)")))
    order = lambda *k: W.partitionBy("provider", *k).orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    j = j.withColumn("n_day", F.count("*").over(order("_day"))).withColumn("n_slot", F.count("*").over(order("_slot")))
    over = ((F.col("daily_limit") > 0) & (F.col("n_day") > F.col("daily_limit"))) | ((F.col("interval_limit") > 0) & (F.col("n_slot") > F.col("interval_limit")))
    return j.filter(over).select("event_id", "provider", "n_day", "n_slot")


def throttle_delay(usage: DataFrame, now: int) -> DataFrame:
    """usage (provider, percent, slot_percent, interval_seconds): seconds to wait, by the day's and the interval's share."""
    to_midnight, to_slot = F.lit(float(DAY - now % DAY)), (F.col("interval_seconds") - F.lit(now) % F.col("interval_seconds")).cast("double")
    delay = F.when(F.col("percent") >= 100, to_midnight).when(F.col("percent") > 90, 2.0).when(F.col("percent") > 75, 0.5).when(F.col("slot_percent") > 95, to_slot).when(F.col("slot_percent") > 80, 0.2).otherwise(0.0)
    return usage.select("provider", delay.alias("delay_s"))


def fleet_usage(usage: DataFrame) -> DataFrame:
    """Calls over limits, of the limited providers and of each day."""
    return usage.filter(F.col("daily_limit") > 0).groupBy("day").agg(F.round(F.sum("used") * 100.0 / F.sum("daily_limit"), 4).alias("usage_percent"))


def rolling_latency(calls: DataFrame, n: int = 100, width: int = DAY) -> DataFrame:
    """Mean latency of the last n successful calls at each of them, summed in whole microseconds.

    A provider's calls are numbered and cut into chunks; a chunk also sees the last n - 1 calls of the one before.
    """
    size = 10 * n
    ok = running(calls.filter("ok"), ["provider"], "ts", ["ts", "event_id"], F.lit(1).cast("long"), "_i", width)
    own = F.expr(f"(_i - 1) div {size}")
    tail = (F.col("_i") - 1) % size > size - n
    seen = ok.withColumn("_own", own).withColumn("_chunk", F.explode(F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))))
    w = W.partitionBy("provider", "_chunk").orderBy("_i").rowsBetween(-(n - 1), 0)
    mean = F.sum(F.round(F.col("latency_ms") * 1000).cast("long")).over(w) / (F.lit(1000.0) * F.count("*").over(w))
    return seen.withColumn("_mean", mean).filter("_chunk = _own").select("event_id", "provider", F.col("_mean").alias("latency_ms"))


def request_counts(calls: DataFrame, now: int) -> DataFrame:
    minute = calls.groupBy("provider", bucket_start(F.col("ts"), 60).alias("m")).agg(F.count("*").alias("n"))
    last = lambda s: F.coalesce(F.sum(F.when((F.col("m") > now - s) & (F.col("m") <= now), F.col("n"))), F.lit(0))
    return minute.groupBy("provider").agg(last(HOUR).alias("n_1h"), last(DAY).alias("n_24h"))


def is_429(status: Column, text: Column) -> Column:
    hit = status == 429
    for t in THROTTLE_TEXTS:
        hit = hit | F.lower(text).contains(t)
    return hit


def detect_throttle(calls: DataFrame) -> DataFrame:
    c429 = is_429(F.col("status_code"), F.col("error_msg"))
    return calls.groupBy("provider").agg(F.count_if(c429).alias("n_429"), F.count_if(F.col("status_code") == 403).alias("n_403"), F.max(F.when(c429 | (F.col("status_code") == 403), F.col("ts"))).alias("last_throttle"))


def provider_stats(calls: DataFrame, policy: DataFrame, now: int) -> DataFrame:
    """Per provider: latency of its last 100 successes, requests and share of its quota in 24 h, throttles and what holds now."""
    ok = calls.filter("ok").withColumn("_n", F.row_number().over(W.partitionBy("provider").orderBy(F.col("ts").desc(), F.col("event_id").desc())))
    latency = ok.filter("_n <= 100").groupBy("provider").agg(F.avg("latency_ms").alias("latency_ms"))
    c429, c403 = is_429(F.col("status_code"), F.col("error_msg")), F.col("status_code") == 403
    base = calls.groupBy("provider").agg(
        F.count_if(c429).alias("n_429"), F.count_if(c403).alias("n_403"), F.count_if(F.col("ok") & (F.col("ts") > now - DAY) & (F.col("ts") <= now)).alias("requests_24h"), F.avg((~F.col("ok")).cast("double")).alias("error_rate"),
        F.max(F.when(c429 | c403, F.struct("ts", "event_id", c403.alias("is_403")))).alias("_last"),
    )
    j = base.join(latency, "provider", "left").join(policy.select("provider", "daily_limit"), "provider", "left")
    limit = F.when(_z("daily_limit") > 0, F.col("daily_limit")).otherwise(F.lit(100_000))
    hold = F.when(F.col("_last.is_403"), F.lit(HOLD_403)).otherwise(F.lit(HOLD_429))
    left = F.greatest(F.coalesce(F.col("_last.ts") + hold - now, F.lit(0)), F.lit(0))
    j = j.withColumns({"usage_percent": F.col("requests_24h") * 100.0 / limit, "quota_left": F.greatest(limit - F.col("requests_24h"), F.lit(0)), "hold_s": left, "latency_ms": F.coalesce("latency_ms", F.lit(0.0))})
    status = F.when((F.col("n_403") > 0) & (F.col("hold_s") > 0), "blocked").when((F.col("n_429") > 5) & (F.col("hold_s") > 0), "throttled").when(F.col("latency_ms") > 3000, "degraded").when(F.col("usage_percent") > 90, "throttled").otherwise("healthy")
    return j.withColumn("status", status).select("provider", "status", "latency_ms", "usage_percent", "quota_left", "requests_24h", "error_rate", "n_429", "n_403", "hold_s")


def provider_status(stats: DataFrame) -> DataFrame:
    return stats.select("provider", "status", F.round("latency_ms", 4).alias("latency_ms"), F.round("usage_percent", 4).alias("usage_percent"), "n_429", "n_403")


def _steps(c: Column, *arms: tuple[float, float]) -> Column:
    """The points of the first limit that is passed."""
    out = F.lit(0.0)
    for limit, points in reversed(arms):
        out = F.when(c > limit, F.lit(float(points))).otherwise(out)
    return out


def _by_status(**points: float) -> Column:
    out = F.lit(0.0)
    for status, p in points.items():
        out = F.when(F.col("status") == status, F.lit(float(p))).otherwise(out)
    return out


def health_score(stats: DataFrame) -> DataFrame:
    loss = _by_status(throttled=60, degraded=30) + _steps(F.col("latency_ms"), (3000, 30), (2000, 20), (1000, 10)) + _steps(F.col("usage_percent"), (90, 30), (75, 15), (50, 5)) + F.col("n_429") * 3.0 + F.col("n_403") * 8.0
    return stats.select("provider", F.when(F.col("status") == "blocked", F.lit(0.0)).otherwise(F.greatest(F.lit(100.0) - loss, F.lit(0.0))).alias("score"))


def provider_error_rate(calls: DataFrame) -> DataFrame:
    g = calls.groupBy("provider").agg(F.count("*").alias("n_requests"), F.count_if(~F.col("ok")).alias("n_failures"), F.round(F.avg("latency_ms"), 4).alias("latency_ms"))
    return g.withColumn("error_rate", F.round(F.col("n_failures") / F.col("n_requests"), 6)).withColumn("available", F.col("n_failures") * 2 <= F.col("n_requests"))


#: Texts of failures that don't count towards opening a circuit.
NOT_FOUND = ("not found", "out of range")


def circuit_events(calls: DataFrame, limit: int = 5, probe: int = 60, width: int = DAY) -> DataFrame:
    """(provider, opened_at, last_failure_at, probe_at, closed_at) of every opening of a provider's circuit.

    It opens at the limit-th failure since the last success, those of NOT_FOUND not counting, and closes at the next success. It
    may be probed when more than so many seconds have passed since the last failure of any kind; probe_at is the last second
    before that.
    """
    not_found = F.lit(False)
    for t in NOT_FOUND:
        not_found = not_found | F.lower("error_msg").contains(t)
    c = running(calls, ["provider"], "ts", ["ts", "event_id"], F.col("ok").cast("long"), "_run", width)
    failures = c.filter(~F.col("ok"))
    n = F.row_number().over(W.partitionBy("provider", "_run").orderBy("ts", "event_id"))
    opened = failures.filter(~not_found).withColumn("_n", n).filter(F.col("_n") == limit).select("provider", "_run", F.col("ts").alias("opened_at"))
    last = failures.groupBy("provider", "_run").agg(F.max("ts").alias("last_failure_at"))
    closed = c.filter("ok").select("provider", (F.col("_run") - 1).alias("_run"), F.col("ts").alias("closed_at"))
    j = opened.join(last, ["provider", "_run"]).join(closed, ["provider", "_run"], "left")
    return j.select("provider", "opened_at", "last_failure_at", (F.col("last_failure_at") + probe).alias("probe_at"), "closed_at")


def retry_after(stats: DataFrame) -> DataFrame:
    return stats.select("provider", F.col("hold_s").cast("long").alias("retry_after_s"))


def eligible_providers(stats: DataFrame, served: DataFrame, circuits: DataFrame, now: int) -> DataFrame:
    """served (chain_id, provider): per chain, providers whose circuit is closed or may be probed and that aren't blocked; within budget where any is.

    circuits: circuit_events of the calls up to now.
    """
    open_ = circuits.filter(F.col("closed_at").isNull() & (F.col("opened_at") <= now) & (F.col("probe_at") >= now)).select("provider").distinct().withColumn("_open", F.lit(True))
    j = served.distinct().join(stats, "provider").join(open_, "provider", "left")
    j = j.withColumn("usable", F.col("_open").isNull() & (F.col("status") != "blocked")).withColumn("has_quota", F.col("usage_percent") < 95)
    chain = W.partitionBy("chain_id")
    any_budget = F.bool_or(F.col("usable") & F.col("has_quota")).over(chain)
    return j.select("chain_id", "provider", "has_quota", (F.col("usable") & (F.col("has_quota") | ~any_budget)).alias("eligible"), F.bool_or("usable").over(chain).alias("chain_available"))


def _ranked(df: DataFrame, score: Column, keep: Column, share: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Kept providers by score, ties by name; candidates are the first of share-th of them, one at least."""
    group = by or []
    s = df.withColumn("score", F.round(score, 6)).filter(keep)
    w = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))  # a provider a row
    out = s.withColumn("rank", F.row_number().over(w.orderBy(F.col("score").desc(), "provider")).cast("long"))
    if share:
        out = out.withColumn("candidate", F.col("rank") <= F.greatest(F.lit(1), F.expr(f"count(*) OVER (PARTITION BY {', '.join(group) or '0'}) div {share}")))
    return out.select(*group, "provider", "score", "rank", *(["candidate"] if share else []))


def rank_weighted(stats: DataFrame) -> DataFrame:
    factor = F.when(F.col("status") == "healthy", 1.0).when(F.col("status") == "degraded", 0.5).otherwise(0.1)
    return _ranked(stats, (1 - F.least(F.col("usage_percent") / 100, F.lit(1.0))) * factor, F.col("status") != "blocked")


def rank_adaptive(stats: DataFrame) -> DataFrame:
    loss = _steps(F.col("usage_percent"), (90, 50), (75, 30), (50, 10)) + _steps(F.col("latency_ms"), (3000, 40), (1000, 20), (500, 10)) + F.col("n_429") * 5.0 + F.col("n_403") * 10.0 + F.col("error_rate") * 50 + _by_status(degraded=25, throttled=60)
    return _ranked(stats, 100 - loss, (F.col("status") != "blocked") & (F.col("score") > 0), 5)


def rank_proactive(stats: DataFrame) -> DataFrame:
    health = 100 - (_by_status(throttled=60, degraded=30) + F.col("n_429") * 3.0 + F.col("n_403") * 8.0)
    score = 0.4 * (100 - F.col("usage_percent")) + 0.3 * health + 0.3 * F.least(F.lit(100.0), F.col("quota_left") / 1000)
    return _ranked(stats, score, (F.col("status") != "blocked") & (F.col("usage_percent") < 95), 2)


def rank_coordinated(stats: DataFrame, served: DataFrame) -> DataFrame:
    """The best provider of each chain with its score and the first reason for a loss."""
    u, l = F.col("usage_percent"), F.col("latency_ms")  # noqa: E741
    loss = _steps(u, (74.999999, 50), (49.999999, 20)) + _by_status(throttled=60, degraded=30) + _steps(l, (2000, 20)) + F.col("n_429") * 5.0 + F.col("n_403") * 10.0
    score = F.when((u >= 95) | (F.col("status") == "blocked"), F.lit(0.0)).otherwise(F.greatest(100 - loss, F.lit(0.0)))
    reason = F.when(u >= 75, "high usage").when(u >= 50, "moderate usage").when(F.col("status").isin("throttled", "degraded"), F.col("status")).when(l > 2000, "slow").when(F.col("n_429") > 0, "throttled before").when(F.col("n_403") > 0, "blocked before").otherwise("healthy")
    j = served.distinct().join(stats.withColumns({"score": F.round(score, 6), "reason": reason}), "provider").filter("score > 0")
    order = W.partitionBy("chain_id").orderBy(F.col("score").desc(), "provider")
    return j.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("chain_id", "provider", "score", "reason")


def rotation_advice(stats: DataFrame, rotations: DataFrame, now: int, percent: float = 75, spacing: int = 120) -> DataFrame:
    """rotations (provider, rotated_at): providers used too much whose last rotation is long enough ago."""
    j = stats.join(rotations, "provider", "left")
    return j.filter((F.col("usage_percent") >= percent) & (F.col("rotated_at").isNull() | (F.lit(now) - F.col("rotated_at") >= spacing))).select("provider", F.round("usage_percent", 4).alias("usage_percent"))


def provider_gauges(stats: DataFrame, served: DataFrame) -> DataFrame:
    j = served.distinct().join(stats, "provider").join(health_score(stats), "provider")
    available = F.bool_or(F.col("status") != "blocked").over(W.partitionBy("chain_id"))
    return j.select("chain_id", "provider", "quota_left", "score", F.round(F.col("usage_percent") / 100, 6).alias("usage_ratio"), F.round(F.col("latency_ms") / 1000, 6).alias("latency_s"), available.alias("chain_available"))
