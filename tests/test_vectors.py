"""Literal cases: each operator on inputs small enough to follow by hand."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import dedup, lookup, machines, metrics, outbox, windows
from millrace.operators.aggregate import Aggregate, Root, folded
from millrace.operators.folds import sorted_fold
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_keys_and_positions(spark):
    saga = F.lit("12345678-1234-1234-1234-123456789012")
    assert one(spark, S.step_key(saga, F.lit("charge"), F.lit(1))) == ("12345678-1234-1234-1234-123456789012/charge/1",)
    assert one(spark, S.lsn_to_text(F.lit(0x16AF6A8F4).cast("long")), S.lsn_to_text(F.lit(-1).cast("long"))) == ("1/6AF6A8F4", "FFFFFFFF/FFFFFFFF")
    assert one(spark, S.text_to_lsn(F.lit("0/16B2450")), S.text_to_lsn(F.lit("FFFFFFFF/FFFFFFFF")), S.text_to_lsn(F.lit("x/1"))) == (0x16B2450, -1, None)
    assert one(spark, S.lsn_order(F.lit(-1).cast("long")) > S.lsn_order(F.lit(2**62).cast("long"))) == (True,)


def test_hashes(spark):
    names = ["dark-mode:1", "", "gradual-rollout:é", "x" * 300]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = {r[0]: r[1:] for r in df.select("n", S.md5_bucket(F.col("n")), S.byte_sum_bucket(F.col("n"))).collect()}
    for n in names:
        assert got[n] == (int(hashlib.md5(n.encode()).hexdigest(), 16) % 100, sum(n.encode()) % 100)


@pytest.mark.parametrize("secret", ["webhook-secret", "k" * 64, "k" * 65, ""])
def test_signature(spark, secret):
    body = '{"event_type":"OrderCreated"}'
    inner, outer = S.hmac_pads(secret)
    got = one(spark, S.hmac_sha256(F.lit(inner), F.lit(outer), F.lit(body)))[0]
    assert got == hmac.new(secret.encode(), body.encode(), "sha256").hexdigest()


def test_backoff_and_durations(spark):
    df = spark.createDataFrame([(k,) for k in range(1, 8)], "n int")
    assert [r[0] for r in df.select(S.doubling_backoff(F.col("n"))).collect()] == [2, 4, 8, 16, 32, 64, 64]
    assert [r[0] for r in df.select(S.capped_backoff(F.col("n"), 50, 2.0, 300)).collect()] == [50, 100, 200, 300, 300, 300, 300]
    assert S.duration_ms("24h") == 86_400_000 and S.duration_ms("1m30s") == 90_000 and S.duration_ms("50ms") == 50
    for bad in ("", "5", "5x", "s"):
        with pytest.raises(ValueError):
            S.duration_ms(bad)


def test_status_codec(spark):
    df = spark.createDataFrame([("Started", None), ("StepPending", 3), ("Compensating", 0)], "tag string, step int")
    text = df.withColumn("text", S.encode_status(F.col("tag"), F.col("step")))
    assert [r.text for r in text.collect()] == ["Started", "StepPending(3)", "Compensating(0)"]
    back = text.withColumn("s", S.decode_status(F.col("text")))
    assert [(r.s.tag, r.s.step) for r in back.collect()] == [("Started", None), ("StepPending", 3), ("Compensating", 0)]
    resumed = back.withColumn("r", machines.resume_point(F.col("s"))).collect()
    assert [(r.r.direction, r.r.step) for r in resumed] == [("forward", 0), ("forward", 3), ("backward", 0)]


def test_outbox(spark):
    schema = "id long, status string, aggregate_id string, kafka_topic string, kafka_key string, payload string, published_at timestamp_ntz"
    box = spark.createDataFrame(
        [
            (2, "pending", "ord-2", "custom-topic", "k", "{}", None),
            (1, "pending", "ord-1", None, None, '{"amount":100}', None),
            (3, "published", "ord-3", None, None, "{}", at(0)),
        ],
        schema,
    )
    sent = outbox.to_messages(outbox.pending(box, 10), "orders")
    assert [tuple(r) for r in sent.collect()] == [(1, "orders", "ord-1", '{"amount":100}'), (2, "custom-topic", "k", "{}")]
    after = outbox.mark_published(box, sent.filter("id = 1"), F.lit(at(5)))
    assert rows(after, "id", "status", "published_at") == [(1, "published", at(5)), (2, "pending", None), (3, "published", at(0))]
    assert rows(outbox.reap(after, F.lit(at(100)), 97), "id") == [(1,), (2,)]
    assert outbox.reap(after, F.lit(at(100)), None).count() == 3
    assert outbox.appended(box, spark.createDataFrame([(4, "a")], "id long, aggregate_id string")).filter("status = 'pending'").count() == 3


def test_dedup(spark):
    m = spark.createDataFrame([("a", 0, 0), ("a", 1, 1), ("b", 2, 1), ("a", 3, 2), (None, 4, 0), (None, 5, 0)], "id string, n long, s int")
    m = m.withColumn("ts", F.lit(at(0)) + F.make_dt_interval(secs=F.col("s")))
    assert rows(dedup.firsts(m, ["id"], ["n"]), "id", "n") == [(None, 4), ("a", 0), ("b", 2)]
    assert rows(dedup.first_wins(m, ["id"], ["n"]).filter("is_new"), "n") == [(0,), (2,), (4,)]
    ttl = dedup.ttl_dedup(m, ["id"], "ts", ["n"], 2)
    assert rows(ttl, "n", "is_new") == [(0, True), (1, False), (2, True), (3, True), (4, True), (5, False)]
    out = dedup.idempotent_responses(m.withColumn("r", F.col("n")), "id", "ts", ["n"], "r", 2)
    assert rows(out, "n", "is_new", "given") == [(0, True, 0), (1, False, 0), (2, True, 2), (3, True, 3), (4, True, 4), (5, True, 5)]
    assert dedup.ttl_dedup(m.limit(0), ["id"], "ts", ["n"], 2).count() == 0


def test_compare_and_set(spark):
    tries = spark.createDataFrame([("p", k, e) for k, e in enumerate([0, 1, 1, 2, 0])] + [("q", 9, 3)], "p string, n int, e long")
    out = dedup.compare_and_set(tries, ["p"], ["n"], "e")
    assert rows(out, "n", "accepted", "version") == [(0, True, 1), (1, True, 2), (2, False, 2), (3, True, 3), (4, False, 3), (9, False, 0)]


def test_latest_state(spark):
    c = spark.createDataFrame([("k", 1, "c", "a"), ("k", 2, "u", None), ("d", 3, "c", "x"), ("d", 4, "d", None), ("e", 5, "r", "y")], "key string, lsn long, op string, v string")
    assert rows(dedup.latest_state(c, ["key"], "lsn", "op", "v"), "key", "v") == [("e", "y"), ("k", "a")]
    assert rows(dedup.latest_state(c, ["key"], "lsn", "op", "v", "nullify"), "key", "v") == [("d", None), ("e", "y"), ("k", "a")]
    lsn = spark.createDataFrame([(100,), (200,)], "lsn long")
    assert tuple(dedup.advance(lsn, 0, "lsn").first()) == (2, 200)
    assert tuple(dedup.advance(lsn.filter("lsn = 100").select((F.col("lsn") - 50).alias("lsn")), 100, "lsn").first()) == (1, 100)
    table = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    assert rows(dedup.upsert(table, spark.createDataFrame([("b", 9), ("c", 3)], "key string, v int"), ["key"])) == [("a", 1), ("b", 9), ("c", 3)]
    assert rows(dedup.drop_prefix(table, "a"), "key") == [("b",)]


def test_lookups(spark):
    req = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    cache = spark.createDataFrame([("a", "cached")], "k string, v string")
    store = spark.createDataFrame([("a", "old"), ("b", "stored")], "k string, v string")
    out = lookup.cache_aside(req, cache, store, "k", "v")
    assert rows(out) == [("a", "cached", "hit"), ("b", "stored", "miss_filled"), ("c", None, "miss_absent")]
    assert tuple(lookup.hit_ratio(out.limit(0)).first()) == (0, 0, None)
    feats = "k string, value int, computed_at timestamp_ntz"
    online = spark.createDataFrame([("a", 1, at(90)), ("b", 2, at(0)), ("c", 3, at(0))], feats)
    offline = spark.createDataFrame([("b", 20, at(5))], feats)
    out = lookup.feature_lookup(req, online, offline, "k", F.lit(at(100)), 10)
    assert rows(out) == [("a", 1, "online", False), ("b", 20, "offline", True), ("c", 3, "stale", False)]


def test_point_in_time_ties_and_unmatched(spark):
    labels = spark.createDataFrame([("u", 1, at(10)), ("u", 2, at(5)), ("v", 3, at(9))], "u string, l int, t timestamp_ntz")
    feats = spark.createDataFrame([("u", 1, at(10), "x"), ("u", 2, at(10), "y"), ("u", 3, at(6), "z"), ("v", 4, at(10), "w")], "u string, n int, ft timestamp_ntz, f string")
    out = lookup.point_in_time(labels, feats, "u", "t", "ft", "f", "l", "n")
    assert rows(out, "u", "l", "f") == [("u", 1, "y")]


def test_rate_limits(spark):
    r = spark.createDataFrame([("k", k, at(s)) for k, s in enumerate([0, 1, 2, 10, 11])], "k string, n int, ts timestamp_ntz")
    out = windows.http_limit(windows.sliding_add_first(r, "k", "ts", 10, 2))
    assert rows(out, "n", "in_window", "allowed", "remaining", "status") == [(0, 1, True, 1, 200), (1, 2, True, 0, 200), (2, 3, False, 0, 429), (3, 3, False, 0, 429), (4, 3, False, 0, 429)]
    assert rows(windows.sliding_check_first(r, "k", "ts", ["n"], 10, 2), "n", "allowed") == [(0, True), (1, True), (2, False), (3, True), (4, True)]
    assert rows(windows.anchored_counter(r, "k", "ts", ["n"], 10, 2), "n", "allowed") == [(0, True), (1, True), (2, False), (3, True), (4, True)]


def test_metrics(spark):
    v = spark.createDataFrame([("a", float(x)) for x in range(1, 21)] + [("b", 7.0)], "k string, v double")
    assert rows(metrics.nearest_rank(v, ["k"], "v", 95)) == [("a", 19.0, 20), ("b", 7.0, 1)]
    h = metrics.histogram(v, ["k"], "v", [10.0, 20.0])
    assert rows(h.filter("k = 'a'"), "le", "n") == [(None, 20), (10.0, 10), (20.0, 20)]
    assert rows(metrics.histogram_quantile(h, ["k"], 0.75))[0] == ("a", 15.0)
    up = spark.createDataFrame([("k", at(0), 5), ("k", at(10), 9), ("k", at(20), 2)], "k string, ts timestamp_ntz, v long")
    assert rows(metrics.counter_increase(up, "k", "ts", "v"), "increase", "rate") == [(2, 0.2), (4, 0.4)]
    modules = spark.createDataFrame([("m", "Running")], "n string, state string")
    assert metrics.ready(modules, spark.createDataFrame([("b", False)], "n string, degraded boolean")).first().ready
    assert rows(metrics.prefixes(spark.createDataFrame([("ab",), ("",)], "n string"), "n")) == [("ab", "a"), ("ab", "ab")]


def test_sagas(spark):
    s = spark.createDataFrame([(1, 0, False), (1, 1, False), (1, 2, False), (2, 0, False), (2, 1, False), (2, 2, True), (3, 0, True)], "saga long, step int, failed boolean")
    out = machines.saga_outcomes(s, "saga", "step", F.col("failed"))
    assert rows(out, "saga", "status", "executed") == [(1, "Completed", 3), (2, "RolledBack", 2), (3, "RolledBack", 0)]
    assert rows(machines.saga_compensations(out, "saga")) == [(2, 0, 1), (2, 1, 0)]


def test_breakers(spark):
    calls = [(k, at(s), ok) for k, (s, ok) in enumerate([(0, False), (1, False), (2, True), (70, True), (71, True), (72, False)])]
    c = spark.createDataFrame(calls, "n int, ts timestamp_ntz, ok boolean").withColumn("k", F.lit("b"))
    out = machines.circuit_breaker(c, "k", "ts", ["n"], "ok", 2, 2, 60)
    assert [x[1:] for x in rows(out, "n", "admitted", "state")] == [(True, "Closed"), (True, "Open"), (False, "Open"), (True, "HalfOpen"), (True, "Closed"), (True, "Closed")]
    e = machines.endpoint_breaker(c, "k", "ts", ["n"], "ok", 2, 60)
    assert [x[1] for x in rows(e, "n", "outcome")] == ["transport_error", "transport_error", "skipped_cb_open", "sent", "sent", "transport_error"]


def test_backpressure_changes_only(spark):
    s = spark.createDataFrame([("b", 1, 0.79), ("b", 2, 0.80), ("b", 3, 0.9), ("b", 4, 0.5)], "k string, t int, r double")
    assert rows(machines.transitions(s, "k", "t", F.col("r") >= 0.8), "t", "active") == [(2, True), (4, False)]


def test_deliveries_and_retries(spark):
    a = spark.createDataFrame([(1, 1, 500), (1, 2, 200), (2, 1, 500), (2, 2, 500), (2, 3, 500), (3, 1, 503)], "e int, attempt int, status int")
    assert rows(machines.delivery_outcomes(a, ["e"], "attempt", "status", 3)) == [(1, "delivered", 2), (2, "dlq", 3), (3, "retrying", 1)]
    log = spark.createDataFrame([("k", n, ok) for n, ok in enumerate([False, False, True, False, False, False, False])], "k string, n int, ok boolean")
    out = machines.retry_tracker(log, "k", ["n"], F.col("ok"))
    assert [x[1] for x in rows(out, "n", "action")] == ["retry", "retry", "done", "retry", "retry", "dlq", "dlq"]
    m = spark.createDataFrame([("i", 1, True), ("i", 2, False), ("i", 3, False)], "id string, n int, bad boolean")
    assert [x[1] for x in rows(machines.exactly_once(m, "id", ["n"], "bad"), "n", "outcome")] == ["aborted", "committed", "duplicate"]


def test_dead_letters(spark):
    e = spark.createDataFrame([(1, "orders", None), (2, "orders", "00-t")], "n int, topic string, trace string")
    h = S.dlq_headers(F.col("topic"), F.col("n"), F.lit("poison"), F.lit(3), F.lit("permanent"), F.lit(at(0)), F.col("trace"))
    dead = outbox.dead_letters(e.withColumn("headers", h), "topic", "acme")
    assert rows(dead, "dlq_topic", F.size("headers")) == [("acme.dlq.orders", 6), ("acme.dlq.orders", 7)]
    assert rows(outbox.replay(dead, "acme.dlq.orders"), "topic") == [("orders",), ("orders",)]
    assert outbox.purge(dead, "acme.dlq.orders").count() == 0
    p = spark.createDataFrame([("{}",), ("{x",), (None,)], "p string")
    assert rows(outbox.poison_split(p, "p"), "reason") == [(None,), ("poison_pill",), ("poison_pill",)]


class Counter(Aggregate):
    def initial(self):
        return {"n": 0}

    def apply(self, state, event):
        return {"n": 0} if event["kind"] == "Reset" else {"n": state["n"] + event["by"]}


def test_aggregates(spark):
    root = Root.rehydrate(Counter(), [{"kind": "Incremented", "by": 10}, {"kind": "Incremented", "by": 5}])
    assert (root.state, root.version) == ({"n": 15}, 2)
    root.apply_new({"kind": "Reset"})
    assert root.take_pending() == [{"kind": "Reset"}] and root.take_pending() == [] and root.snapshot() == ({"n": 0}, 3)
    e = spark.createDataFrame([("a", 1, "Incremented", 10), ("a", 3, "Incremented", 2), ("a", 2, "Reset", None), ("b", 1, "Incremented", 1)], "k string, n int, kind string, by int")
    assert rows(folded(e, Counter, "k", ["n"])) == [("a", '{"n": 2}', 3), ("b", '{"n": 1}', 1)]


def test_folds_keep_a_key_whole_after_a_join(spark):
    """A join that is planned with shuffles and runs as a broadcast leaves its rows where they are; a fold deals them out itself."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for name, value in conf.items():
            spark.conf.set(name, value)
        events = spark.range(0, 400, 1, 8).select((F.col("id") % 5).alias("k"), F.col("id").alias("n"), F.lit("Incremented").alias("kind"), F.lit(1).alias("by"))
        snapshots = spark.createDataFrame([(k, '{"n": 7}', 3) for k in range(4)], "k long, state string, version long")
        assert rows(folded(events, Counter, "k", ["n"], snapshots)) == [(k, '{"n": 87}', 83) for k in range(4)] + [(4, '{"n": 80}', 80)]
        counted = sorted_fold(events.join(snapshots, "k"), ["k"], ["n"], ["by"], int, lambda n, row: (n + row[0], (n + row[0],)), "total long")
        assert rows(counted.groupBy("k").agg(F.max("total"))) == [(k, 80) for k in range(4)]
    finally:
        for name in conf:
            spark.conf.unset(name)


def test_flags(spark):
    flags = spark.createDataFrame([("gradual-rollout", True, 25), ("off", False, 100), ("all", True, None)], "name string, enabled boolean, rollout int")
    names = F.explode(F.array(*map(F.lit, ("gradual-rollout", "off", "all", "missing")))).alias("name")
    requests = spark.range(100).select(F.col("id").cast("string").alias("u"), names)
    on = {r.name: r.n for r in lookup.flag_for_entity(requests, flags, "u").groupBy("name").agg(F.count_if("is_on").alias("n")).collect()}
    assert 10 < on["gradual-rollout"] < 40 and on["off"] == 0 and on["all"] == 100 and "missing" not in on
    names = spark.createDataFrame([("all",), ("off",), ("none",)], "name string")
    got = lookup.flag_with_fallback(names, flags.filter("name = 'all'"), flags)
    assert rows(got, "name", "found_in") == [("all", "cache"), ("none", "not_found"), ("off", "store")]
    assert rows(lookup.flag_with_fallback(names, flags, flags, breaker_open=True), "name", "found_in")[0] == ("all", "store")
