"""Queries over the driver's tables, each with the SQL that states its result: windows, metrics, state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import dedup, machines, metrics, outbox, windows
from millrace.operators.aggregate import Aggregate, folded
from millrace.sources import fixtures as X


def _events(spark, d):
    return X.table(spark, d, "events")


def rate_limit_sliding(spark, d):
    out = windows.sliding_add_first(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", 6 * 3600, 2)
    return windows.http_limit(out).select("event_id", "in_window", "allowed", "remaining", "retry_after_ms", "status", "retry_after")


def rate_limit_violations(spark, d):
    out = windows.sliding_add_first(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", 24 * 3600, 3)
    return windows.violations(out).groupBy("user_id").agg(F.count("*").alias("violations"))


def rate_limit_sliding_check_first(spark, d):
    out = windows.sliding_check_first(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", ["event_id"], 6 * 3600, 1)
    return out.select("event_id", "user_id", "allowed")


def rate_limit_anchored_counter(spark, d):
    out = windows.anchored_counter(_events(spark, d).select("event_id", "user_id", "ts"), "user_id", "ts", ["event_id"], 12 * 3600, 2)
    return out.select("event_id", "user_id", "allowed", "in_window")


def tumbling_daily(spark, d):
    return windows.tumbling(_events(spark, d), "ts", "1 day", ["user_id"], "value")


def tumbling_minute_avg(spark, d):
    return windows.tumbling(_events(spark, d), "ts", "1 minute", ["event_type"], "value")


def purchase_count_30d(spark, d):
    p = _events(spark, d).filter("event_type = 'purchase'")
    return windows.tumbling(p, "ts", "30 days", ["user_id"], "value").select("user_id", "window_start", "n")


def purchase_count_30d_rolling(spark, d):
    p = _events(spark, d).filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return windows.rolling_count(p, "user_id", "ts", 30).select("event_id", "user_id", "rolling")


def leaderboard_7d(spark, d):
    e = _events(spark, d)
    recent = e.filter(F.col("ts") > X.latest(e, "ts") - F.expr("interval 7 days"))
    return metrics.leaderboard(recent, "user_id", "value", 100)


def revenue_by_seller_day(spark, d):
    li = X.table(spark, d, "lineitem")
    return metrics.daily_revenue(li, "l_suppkey", "l_shipdate", F.col("l_extendedprice"))


def topic_lag(spark, d):
    m = _events(spark, d).select(F.col("event_type").alias("topic"), (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"))
    return metrics.topic_lag(m)


def latency_p95_nearest_rank(spark, d):
    return metrics.nearest_rank(_events(spark, d), ["event_type"], "value", 95)


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


def histogram_buckets(spark, d):
    return metrics.histogram(_events(spark, d), ["event_type"], "value", BOUNDS)


def histogram_quantile(spark, d):
    out = metrics.histogram_quantile(metrics.histogram(_events(spark, d), ["event_type"], "value", BOUNDS), ["event_type"], 0.95)
    return out.select("event_type", F.round("quantile", 6).alias("quantile"))


def counter_rate(spark, d):
    samples = _events(spark, d).select("user_id", "event_id", "ts", (F.col("event_id") % 1000).alias("total"))
    return metrics.counter_increase(samples, "user_id", "ts", "total").select("event_id", "increase", F.round("rate", 9).alias("rate"))


def error_ratio(spark, d):
    return metrics.error_ratio(_events(spark, d), ["user_id"], F.col("event_type") == "error", 0.2)


def event_counters(spark, d):
    return metrics.counters(_events(spark, d).withColumn("result", F.when(F.col("event_type") == "error", "failed").otherwise("ok")), ["event_type", "result"])


def alert_for_duration(spark, d):
    return windows.sustained(_events(spark, d), "user_id", "ts", F.col("value") < 50, 6 * 3600)


def autocomplete_prefix(spark, d):
    return metrics.prefix_search(X.table(spark, d, "part").select("p_name").distinct(), "p_name", "re", 50)


def autocomplete_expansion(spark, d):
    names = X.table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct()
    return metrics.prefixes(names, "name").groupBy("prefix").agg(F.count("*").alias("names"))


def saga_status(spark, d):
    return machines.saga_outcomes(X.saga_steps(spark, d), "saga_id", "step", F.col("failed"))


def saga_compensations(spark, d):
    return machines.saga_compensations(saga_status(spark, d), "saga_id").select("saga_id", F.col("nth").cast("long").alias("nth"), "step")


def saga_status_counts(spark, d):
    text = S.encode_status(F.when(F.col("failed_at").isNull(), "Completed").otherwise("StepFailed"), F.col("failed_at"))
    out = saga_status(spark, d).withColumn("text", text).withColumn("tag", S.decode_status(F.col("text"))["tag"])
    return out.groupBy("status", "tag").agg(F.count("*").alias("n"))


def circuit_breaker_transitions(spark, d):
    calls = _events(spark, d).select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return machines.circuit_breaker(calls, "user_id", "ts", ["event_id"], "ok", 2, 2, 12 * 3600).select("event_id", "user_id", "admitted", "state")


def endpoint_breaker_outcomes(spark, d):
    calls = _events(spark, d).select("event_id", "user_id", "ts", (F.col("event_type") != "error").alias("ok"))
    return machines.endpoint_breaker(calls, "user_id", "ts", ["event_id"], "ok", 2, 24 * 3600).select("event_id", "user_id", "outcome")


def backpressure_transitions(spark, d):
    """Days on which each event type's load goes beyond 95 % of its own peak, or back."""
    days = _events(spark, d).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    peak = days.groupBy("event_type").agg(F.max("n").alias("most"))
    return machines.transitions(days.join(peak, "event_type"), "event_type", "day", F.col("n") * 100 >= F.col("most") * 95).select("event_type", "day", "active")


def webhook_retry_schedule(spark, d):
    e = _events(spark, d).filter("event_type = 'error'").select("event_id", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("attempt"))
    wait = S.doubling_backoff(F.col("attempt"))
    capped = S.capped_backoff(F.col("attempt"), 50, 2.0, 30_000)
    return e.select("event_id", "attempt", wait.alias("wait_s"), capped.alias("supervisor_ms"))


def _attempts(spark, d):
    e = _events(spark, d).filter("event_type = 'purchase'").select("event_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("attempt"))
    code = F.when((F.col("event_id") * 7 + F.col("attempt") * 3) % 5 == 0, 200).when(F.col("attempt") % 2 == 0, 404).otherwise(503)
    return e.withColumn("status", code).filter("attempt <= event_id % 5")


def webhook_outcomes_dlq(spark, d):
    return machines.delivery_outcomes(_attempts(spark, d), ["event_id"], "attempt", "status", 3)


def error_taxonomy(spark, d):
    return _attempts(spark, d).groupBy("status", S.error_class(F.col("status")).alias("class")).agg(F.count("*").alias("n"))


def _dead(spark, d):
    e = _events(spark, d).filter("event_type = 'error'")
    none = F.lit(None).cast("string")
    headers = S.dlq_headers(F.col("topic"), F.col("event_id"), F.lit("handler_error"), F.lit(3), F.lit("permanent"), F.col("ts"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("00-"), F.col("event_id").cast("string"))).otherwise(none))
    topics = e.withColumn("topic", F.concat(F.lit("user-"), (F.col("user_id") % 3).cast("string")))
    return outbox.dead_letters(topics.withColumn("headers", headers), "topic").select("event_id", "dlq_topic", "headers")


def dlq_route_replay(spark, d):
    again = outbox.replay(_dead(spark, d), "events.dlq.user-1")
    return again.select("event_id", "dlq_topic", "topic", F.size("headers").cast("long").alias("n_headers"))


def dlq_headers(spark, d):
    return _dead(spark, d).select("event_id", F.explode("headers").alias("h")).select("event_id", "h.key", "h.value")


def dlq_purge(spark, d):
    return outbox.purge(_dead(spark, d), "events.dlq.user-1").groupBy("dlq_topic").agg(F.count("*").alias("n"))


def retry_tracker(spark, d):
    e = _events(spark, d).select("event_id", "user_id", "event_type")
    return machines.retry_tracker(e, "user_id", ["event_id"], F.col("event_type").isin("view", "click")).select("event_id", "attempts", "action")


def checkpoint_cas(spark, d):
    tries = _events(spark, d).select("event_id", "user_id", (F.col("event_id") % 4).alias("expected"))
    return dedup.compare_and_set(tries, ["user_id"], ["event_id"], "expected").select("event_id", "user_id", "accepted", "version")


def event_stream_conflicts(spark, d):
    return dedup.version_conflicts(X.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


def event_stream_first_writer(spark, d):
    li = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return dedup.firsts(li, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])


def aggregate_counter_fold(spark, d):
    e = _events(spark, d).select("user_id", "event_id", "event_type")
    return machines.since_reset(e, "user_id", ["event_id"], F.col("event_type") == "signup", F.col("event_id") % 10)


class Counter(Aggregate):
    def initial(self):
        return {"n": 0}

    def apply(self, state, event):
        return {"n": 0 if event["event_type"] == "signup" else state["n"] + event["event_id"] % 10}


def aggregate_user_fold(spark, d):
    out = folded(_events(spark, d).select("user_id", "event_id", "event_type"), Counter, "user_id", ["event_id"])
    return out.select("user_id", F.get_json_object("state", "$.n").cast("long").alias("value"), "version")


def poison_pill_split(spark, d):
    bad = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("{oops"), F.col("event_id").cast("string"))).otherwise(F.col("props"))
    out = outbox.poison_split(_events(spark, d).select("event_id", bad.alias("payload")), "payload")
    return out.select("event_id", "reason", F.when(F.col("reason").isNull(), F.get_json_object("payload", "$.k")).alias("k"))


def eos_outcomes(spark, d):
    m = X.deliveries(spark, d).select("event_id", "offset", ((F.col("offset") % 10 == 0) & (F.col("event_id") % 2 == 0)).alias("fails"))
    return machines.exactly_once(m, "event_id", ["offset"], "fails").select("event_id", "offset", "outcome")


def readiness(spark, d):
    modules = _events(spark, d).select(F.col("event_type").alias("name")).distinct().withColumn("state", F.lit("Running"))
    backends = spark.createDataFrame([("pg", False), ("kafka", True)], "name string, degraded boolean")
    return metrics.ready(modules, backends)


def _fold(start: str, step: str, columns: str, order: str = "ts, event_id") -> str:
    """SQL that steps through each user's events with a state s, one row at a time."""
    return f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {order}) AS n FROM events),
    f AS (SELECT e.*, {start} AS s FROM e WHERE n = 1 UNION ALL SELECT e.*, {step} AS s FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
    SELECT {columns} FROM f"""


_DEAD_SQL = """WITH dead AS (SELECT event_id, 'user-' || (user_id % 3) AS topic, ts FROM events WHERE event_type = 'error')"""
_ATTEMPTS_SQL = """WITH a AS (SELECT event_id, t AS attempt, CASE WHEN (event_id * 7 + t * 3) % 5 = 0 THEN 200 WHEN t % 2 = 0 THEN 404 ELSE 503 END AS status
  FROM events, (SELECT unnest([1, 2, 3, 4]) AS t) WHERE event_type = 'purchase' AND t <= event_id % 5)"""
_HIST = "WITH b(le) AS (VALUES (1.0::DOUBLE), (5.0), (10.0), (25.0), (50.0), (100.0), (250.0), (500.0), (NULL)), h AS (SELECT event_type, le, count(*) FILTER (le IS NULL AND value IS NOT NULL OR value <= le) AS n FROM events, b GROUP BY ALL)"

QUERIES = {
    "rate_limit_sliding": (
        rate_limit_sliding,
        """WITH w AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '21599.999999' SECOND PRECEDING AND CURRENT ROW) AS c FROM events)
        SELECT event_id, c AS in_window, c <= 2 AS allowed, CASE WHEN c <= 2 THEN 2 - c ELSE 0 END AS remaining, CASE WHEN c > 2 THEN 21600000::BIGINT END AS retry_after_ms,
          CASE WHEN c > 2 THEN 429 ELSE 200 END AS status, CASE WHEN c > 2 THEN 21600::BIGINT END AS retry_after FROM w""",
    ),
    "rate_limit_violations": (
        rate_limit_violations,
        """WITH w AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '86399.999999' SECOND PRECEDING AND CURRENT ROW) AS c FROM events)
        SELECT user_id, count(*) AS violations FROM w WHERE c > 3 GROUP BY 1""",
    ),
    "rate_limit_sliding_check_first": (
        rate_limit_sliding_check_first,
        _fold("e.ts", "CASE WHEN e.ts >= f.s + INTERVAL 6 HOUR THEN e.ts ELSE f.s END", "event_id, user_id, s = ts AND (lag(s) OVER (PARTITION BY user_id ORDER BY n) IS NULL OR s <> lag(s) OVER (PARTITION BY user_id ORDER BY n)) AS allowed"),
    ),
    "rate_limit_anchored_counter": (
        rate_limit_anchored_counter,
        _fold(
            "{'a': e.ts, 'c': 1::BIGINT}",
            "CASE WHEN e.ts >= f.s.a + INTERVAL 12 HOUR THEN {'a': e.ts, 'c': 1::BIGINT} ELSE {'a': f.s.a, 'c': f.s.c + 1} END",
            "event_id, user_id, s.c <= 2 AS allowed, s.c AS in_window",
        ),
    ),
    "tumbling_daily": (
        tumbling_daily,
        """SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM events GROUP BY ALL""",
    ),
    "tumbling_minute_avg": (
        tumbling_minute_avg,
        """SELECT event_type, date_trunc('minute', ts) AS window_start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
        CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM events GROUP BY ALL""",
    ),
    "purchase_count_30d": (
        purchase_count_30d,
        "SELECT user_id, time_bucket(INTERVAL 30 DAY, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS n FROM events WHERE event_type = 'purchase' GROUP BY ALL",
    ),
    "purchase_count_30d_rolling": (
        purchase_count_30d_rolling,
        """SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '2591999.999999' SECOND PRECEDING AND CURRENT ROW) AS rolling
        FROM events WHERE event_type = 'purchase'""",
    ),
    "leaderboard_7d": (
        leaderboard_7d,
        """SELECT user_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events
        WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1 ORDER BY total DESC, user_id LIMIT 100""",
    ),
    "revenue_by_seller_day": (
        revenue_by_seller_day,
        "SELECT l_suppkey, CAST(l_shipdate AS DATE) AS day, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue, count(*) AS n_sales FROM lineitem GROUP BY ALL",
    ),
    "topic_lag": (
        topic_lag,
        """SELECT event_type AS topic, user_id % 4 AS partition, min(event_id) AS low, max(event_id) + 1 AS high, max(event_id) + 1 - min(event_id) AS lag FROM events GROUP BY ALL""",
    ),
    "latency_p95_nearest_rank": (
        latency_p95_nearest_rank,
        """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
        SELECT event_type, min(value) AS p95, max(n) AS n FROM r WHERE k * 100 >= n * 95 GROUP BY 1""",
    ),
    "histogram_buckets": (histogram_buckets, f"{_HIST} SELECT event_type, le, n FROM h"),
    "histogram_quantile": (
        histogram_quantile,
        f"""{_HIST}, q AS (SELECT *, coalesce(lag(le) OVER w, 0) AS f, coalesce(lag(n) OVER w, 0) AS b, 0.95::DOUBLE * max(n) OVER (PARTITION BY event_type) AS r FROM h
          WINDOW w AS (PARTITION BY event_type ORDER BY le NULLS LAST))
        SELECT event_type, round(arg_min(CASE WHEN le IS NULL THEN f ELSE f + (le - f) * (r - b) / nullif(n - b, 0) END, coalesce(le, 'Infinity'::DOUBLE)), 6) AS quantile FROM q WHERE n >= r AND r > 0 GROUP BY 1""",
    ),
    "counter_rate": (
        counter_rate,
        """WITH l AS (SELECT event_id, event_id % 1000 AS v, lag(event_id % 1000) OVER w AS b, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1000000 AS s
          FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
        SELECT event_id, CASE WHEN v >= b THEN v - b ELSE v END AS increase, round(CASE WHEN v >= b THEN v - b ELSE v END / s, 9) AS rate FROM l WHERE s > 0""",
    ),
    "error_ratio": (
        error_ratio,
        """SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'error') / count(*) AS ratio,
        count(*) FILTER (event_type = 'error') / count(*) > 0.2 AS breached FROM events GROUP BY 1""",
    ),
    "event_counters": (
        event_counters,
        "SELECT event_type, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS result, count(*) AS n FROM events GROUP BY ALL",
    ),
    "alert_for_duration": (
        alert_for_duration,
        """WITH m AS (SELECT user_id, ts, value < 50 AS holds, sum(CASE WHEN value < 50 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM events)
        SELECT user_id, min(ts) AS since, max(ts) AS until, count(*) AS samples FROM m WHERE holds GROUP BY user_id, i HAVING max(ts) - min(ts) >= INTERVAL 6 HOUR""",
    ),
    "autocomplete_prefix": (
        autocomplete_prefix,
        "SELECT DISTINCT p_name FROM part WHERE p_name >= 're' AND p_name < 'rf' ORDER BY p_name LIMIT 50",
    ),
    "autocomplete_expansion": (
        autocomplete_expansion,
        "SELECT name[1:i] AS prefix, count(*) AS names FROM (SELECT name, unnest(range(1, length(name) + 1)) AS i FROM (SELECT DISTINCT p_brand AS name FROM part)) GROUP BY 1",
    ),
    "saga_status": (
        saga_status,
        f"""WITH {X.SAGA_SQL}, o AS (SELECT saga_id, min(step) FILTER (failed) AS failed_at, count(*) AS steps FROM steps GROUP BY 1)
        SELECT saga_id, CASE WHEN failed_at IS NULL THEN 'Completed' ELSE 'RolledBack' END AS status, failed_at, coalesce(failed_at, steps) AS executed, failed_at IS NOT NULL AS compensation_mode FROM o""",
    ),
    "saga_compensations": (
        saga_compensations,
        f"""WITH {X.SAGA_SQL}, o AS (SELECT saga_id, min(step) FILTER (failed) AS k FROM steps GROUP BY 1)
        SELECT saga_id, i AS nth, k - 1 - i AS step FROM (SELECT saga_id, k, unnest(range(0, k)) AS i FROM o WHERE k > 0)""",
    ),
    "saga_status_counts": (
        saga_status_counts,
        f"""WITH {X.SAGA_SQL}, o AS (SELECT saga_id, min(step) FILTER (failed) AS k FROM steps GROUP BY 1)
        SELECT CASE WHEN k IS NULL THEN 'Completed' ELSE 'RolledBack' END AS status, CASE WHEN k IS NULL THEN 'Completed' ELSE 'StepFailed' END AS tag, count(*) AS n FROM o GROUP BY ALL""",
    ),
    "circuit_breaker_transitions": (
        circuit_breaker_transitions,
        _fold(
            "CASE WHEN e.event_type = 'error' THEN {'st': 'Closed', 'n': 1, 'since': TIMESTAMP '1970-01-01', 'ad': TRUE} ELSE {'st': 'Closed', 'n': 0, 'since': TIMESTAMP '1970-01-01', 'ad': TRUE} END",
            """CASE WHEN f.s.st = 'Open' AND e.ts < f.s.since + INTERVAL 12 HOUR THEN {'st': 'Open', 'n': 0, 'since': f.s.since, 'ad': FALSE}
              WHEN f.s.st <> 'Closed' AND e.event_type = 'error' THEN {'st': 'Open', 'n': 0, 'since': e.ts, 'ad': TRUE}
              WHEN f.s.st = 'Open' THEN {'st': 'HalfOpen', 'n': 1, 'since': f.s.since, 'ad': TRUE}
              WHEN f.s.st = 'HalfOpen' THEN {'st': 'Closed', 'n': 0, 'since': f.s.since, 'ad': TRUE}
              WHEN e.event_type <> 'error' THEN {'st': 'Closed', 'n': 0, 'since': f.s.since, 'ad': TRUE}
              WHEN f.s.n + 1 >= 2 THEN {'st': 'Open', 'n': 0, 'since': e.ts, 'ad': TRUE}
              ELSE {'st': 'Closed', 'n': f.s.n + 1, 'since': f.s.since, 'ad': TRUE} END""",
            "event_id, user_id, s.ad AS admitted, s.st AS state",
        ),
    ),
    "endpoint_breaker_outcomes": (
        endpoint_breaker_outcomes,
        _fold(
            "CASE WHEN e.event_type = 'error' THEN {'n': 1, 'u': TIMESTAMP '1970-01-01', 'o': 'transport_error'} ELSE {'n': 0, 'u': TIMESTAMP '1970-01-01', 'o': 'sent'} END",
            """CASE WHEN e.ts < f.s.u THEN {'n': f.s.n, 'u': f.s.u, 'o': 'skipped_cb_open'} WHEN e.event_type <> 'error' THEN {'n': 0, 'u': TIMESTAMP '1970-01-01', 'o': 'sent'}
              WHEN f.s.n + 1 >= 2 THEN {'n': 0, 'u': e.ts + INTERVAL 24 HOUR, 'o': 'transport_error'} ELSE {'n': f.s.n + 1, 'u': f.s.u, 'o': 'transport_error'} END""",
            "event_id, user_id, s.o AS outcome",
        ),
    ),
    "backpressure_transitions": (
        backpressure_transitions,
        """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL), a AS (SELECT event_type, day, n * 100 >= max(n) OVER (PARTITION BY event_type) * 95 AS active FROM d)
        SELECT event_type, day, active FROM (SELECT *, coalesce(lag(active) OVER (PARTITION BY event_type ORDER BY day), FALSE) AS b FROM a) WHERE active <> b""",
    ),
    "webhook_retry_schedule": (
        webhook_retry_schedule,
        """SELECT event_id, CAST(a AS INTEGER) AS attempt, CAST(2 ** least(a, 6) AS BIGINT) AS wait_s, least(50.0::DOUBLE * 2 ** (a - 1), 30000) AS supervisor_ms
        FROM events, (SELECT unnest(range(1, 9)) AS a) WHERE event_type = 'error'""",
    ),
    "webhook_outcomes_dlq": (
        webhook_outcomes_dlq,
        f"""{_ATTEMPTS_SQL}, o AS (SELECT event_id, min(attempt) FILTER (status BETWEEN 200 AND 299) AS good, max(attempt) AS last FROM a WHERE attempt <= 3 GROUP BY 1)
        SELECT event_id, CASE WHEN good IS NOT NULL THEN 'delivered' WHEN last >= 3 THEN 'dlq' ELSE 'retrying' END AS outcome, CAST(coalesce(good, last) AS BIGINT) AS attempts FROM o""",
    ),
    "error_taxonomy": (
        error_taxonomy,
        f"{_ATTEMPTS_SQL} SELECT status, CASE status WHEN 200 THEN 'none' WHEN 404 THEN 'permanent' ELSE 'transient' END AS class, count(*) AS n FROM a GROUP BY ALL",
    ),
    "dlq_route_replay": (
        dlq_route_replay,
        f"{_DEAD_SQL} SELECT event_id, 'events.dlq.' || topic AS dlq_topic, topic, CAST(CASE WHEN event_id % 2 = 0 THEN 7 ELSE 6 END AS BIGINT) AS n_headers FROM dead WHERE topic = 'user-1'",
    ),
    "dlq_headers": (
        dlq_headers,
        f"""{_DEAD_SQL}, h AS (SELECT event_id, unnest([{{'k': 'original-topic', 'v': topic}}, {{'k': 'original-offset', 'v': CAST(event_id AS VARCHAR)}}, {{'k': 'failure-reason', 'v': 'handler_error'}},
          {{'k': 'attempt-count', 'v': '3'}}, {{'k': 'error-type', 'v': 'permanent'}}, {{'k': 'failed-at', 'v': {X.utc_text_sql('ts')}}},
          {{'k': 'traceparent', 'v': CASE WHEN event_id % 2 = 0 THEN '00-' || event_id END}}]) AS x FROM dead)
        SELECT event_id, x.k AS key, x.v AS value FROM h WHERE x.v IS NOT NULL""",
    ),
    "dlq_purge": (dlq_purge, f"{_DEAD_SQL} SELECT 'events.dlq.' || topic AS dlq_topic, count(*) AS n FROM dead WHERE topic <> 'user-1' GROUP BY 1"),
    "retry_tracker": (
        retry_tracker,
        """WITH m AS (SELECT event_id, user_id, event_type IN ('view', 'click') AS ok, sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS i FROM events),
        c AS (SELECT event_id, ok, CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, i ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS attempts FROM m)
        SELECT event_id, attempts, CASE WHEN ok THEN 'done' WHEN attempts >= 3 THEN 'dlq' ELSE 'retry' END AS action FROM c""",
    ),
    "checkpoint_cas": (
        checkpoint_cas,
        _fold(
            "CASE WHEN e.event_id % 4 = 0 THEN {'v': 1::BIGINT, 'a': TRUE} ELSE {'v': 0::BIGINT, 'a': FALSE} END",
            "CASE WHEN e.event_id % 4 = f.s.v THEN {'v': f.s.v + 1, 'a': TRUE} ELSE {'v': f.s.v, 'a': FALSE} END",
            "event_id, user_id, s.a AS accepted, s.v AS version",
            "event_id",
        ),
    ),
    "event_stream_conflicts": (
        event_stream_conflicts,
        "SELECT l_orderkey, l_linenumber, count(*) AS writers FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    ),
    "event_stream_first_writer": (
        event_stream_first_writer,
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS n FROM lineitem) WHERE n = 1""",
    ),
    "aggregate_counter_fold": (
        aggregate_counter_fold,
        """WITH r AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS r, count(*) AS version FROM events GROUP BY 1)
        SELECT user_id, CAST(coalesce(sum(event_id % 10) FILTER (event_type <> 'signup' AND (r IS NULL OR event_id > r)), 0) AS BIGINT) AS value, version FROM events JOIN r USING (user_id) GROUP BY ALL""",
    ),
    "aggregate_user_fold": (
        aggregate_user_fold,
        """WITH r AS (SELECT user_id, max(event_id) FILTER (event_type = 'signup') AS r, count(*) AS version FROM events GROUP BY 1)
        SELECT user_id, CAST(coalesce(sum(event_id % 10) FILTER (event_type <> 'signup' AND (r IS NULL OR event_id > r)), 0) AS BIGINT) AS value, version FROM events JOIN r USING (user_id) GROUP BY ALL""",
    ),
    "poison_pill_split": (
        poison_pill_split,
        """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'poison_pill' END AS reason, CASE WHEN event_id % 13 <> 0 THEN props ->> '$.k' END AS k FROM events""",
    ),
    "eos_outcomes": (
        eos_outcomes,
        f"""WITH {X.DELIVERIES_SQL} SELECT event_id, "offset", CASE WHEN "offset" % 10 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'aborted' ELSE 'committed' END
          WHEN "offset" % 10 = 1 AND event_id % 2 = 0 THEN 'committed' ELSE 'duplicate' END AS outcome FROM deliveries""",
    ),
    "readiness": (readiness, "SELECT TRUE AS modules_ok, FALSE AS backends_ok, FALSE AS ready"),
}
