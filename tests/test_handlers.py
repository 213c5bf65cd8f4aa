"""User code and store patterns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from millrace.operators import handlers as H
from millrace.sources import streams
from millrace.streaming.listener import listen
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def failing(state):
    raise H.StepFailed("no")


def broken(state):
    raise RuntimeError("boom")


def trace(name):
    return lambda state: state | {"trail": state.get("trail", "") + name}


def test_inbox_handles_new_messages_once(spark):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4)], "id string, n int")
    handled, outcomes = H.inbox(m, m.filter("id = 'c'"), "id", ["n"], lambda d: d.withColumn("done", F.lit(True)))
    assert rows(handled, "id", "n") == [("a", 1), ("b", 3)]
    assert rows(outcomes, "n", "outcome") == [(1, "new"), (2, "duplicate"), (3, "new"), (4, "duplicate")]


def test_inbox_with_a_cache_in_front(spark):
    m = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "id string, n int")
    cache, store = m.filter("id = 'b'"), m.filter("id in ('b', 'c')")
    got = lambda broken: [r[1] for r in rows(H.inbox_two_tier(m, cache, store, "id", ["n"], broken), "n", "outcome")]
    assert got(False) == ["new", "duplicate_cache", "duplicate_cache", "duplicate_store", "new"]
    assert got(True) == ["new", "duplicate_store", "duplicate_store", "duplicate_store", "new"]


def test_controls(spark):
    c = spark.createDataFrame([("p", 1, "resume"), ("p", 2, "pause"), ("p", 3, "pause"), ("p", 4, "reload"), ("p", 5, "replay"), ("p", 6, "resume"), ("q", 1, "stop")], "name string, n int, command string")
    out = rows(H.controlled(c, "name", ["n"], "command"), "name", "n", "state", "applied")
    assert [x[2:] for x in out] == [("Running", False), ("Paused", True), ("Paused", False), ("Paused", True), ("Replaying", True), ("Running", True), ("Running", False)]


def test_write_through_never_leads_the_store(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    cache = spark.createDataFrame([("b", 0, None), ("z", 9, None)], "key string, v int, expires_at timestamp_ntz")
    writes = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("c", 9, 3)], "key string, v int, seq int")
    stored, cached = H.write_through(store, cache, writes, "key", "seq", F.lit(T0))
    assert rows(stored) == [("a", 7), ("b", 2), ("c", 9)]
    assert rows(cached) == [("a", 7, T0), ("b", 0, None), ("c", 9, T0), ("z", 9, None)]


def test_saga_runs_and_compensates_backwards():
    ok = H.Saga("s").step("a", trace("a"), trace("A")).step("b", trace("b"), trace("B"))
    assert ok.run({}) == ("Completed", {"trail": "ab"}, [(0, "a", "success"), (1, "b", "success")])
    bad = H.Saga("s").step("a", trace("a"), trace("A")).step("b", trace("b"), trace("B")).step("c", failing)
    status, state, log = bad.run({})
    assert (status, state["trail"]) == ("RolledBack", "abBA")
    assert log[-2:] == [(1, "b", "compensated"), (0, "a", "compensated")]
    assert H.Saga("s").run({})[0] == "Completed"
    assert H.Saga("s").step("a", broken).run({})[0] == "Error(boom)"
    assert H.Saga("s").step("a", trace("a"), broken).step("b", failing).run({})[0] == "Failed(boom)"
    assert H.Saga("s").step("a", trace("a"), failing).step("b", failing).run({})[0] == "RolledBack"
    assert bad.run({}, start=2, compensating=True)[1]["trail"] == "BA"
    assert ok.run({}, start=1)[1]["trail"] == "b"


def test_sagas_over_rows(spark):
    saga = H.Saga("pay").step("check", lambda s: failing(s) if s["amount"] > 5 else s | {"paid": True})
    df = spark.createDataFrame([(1, 3), (2, 9)], "id long, amount int")
    out = rows(H.run_sagas(df, saga, "id"))
    assert out == [(1, "Completed", '{"amount": 3, "id": 1, "paid": true}'), (2, "RolledBack", '{"amount": 9, "id": 2}')]


def test_stores(spark):
    store = spark.createDataFrame([("a", 1), ("b", 2)], "key string, v int")
    writes = spark.createDataFrame([("a", 5, 1), ("a", 7, 2), ("c", 9, 3)], "key string, v int, seq int")
    assert rows(H.write_behind(writes, store, "key", "seq")) == [("a", 7), ("b", 2), ("c", 9)]
    flags = spark.createDataFrame([("x", True, 1)], "name string, enabled boolean, rollout int")
    assert rows(H.distribute_flags(flags, flags.filter("false"))) == [("x", True, 1)]
    schema = "k string, value int, computed_at timestamp_ntz"
    online = spark.createDataFrame([("a", 1, T0)], schema)
    offline = spark.createDataFrame([("a", 2, T0), ("b", 3, T0)], schema)
    now = F.lit(T0 + dt.timedelta(seconds=100))
    out = H.refresh_features(spark.createDataFrame([("a",), ("b",)], "k string"), online, offline, "k", now, 10)
    assert rows(out, "k", "value") == [("a", 2), ("b", 3)]


def test_cold_starts(spark):
    schema = "k string, pos long, v string"
    snap = spark.createDataFrame([("a", 5, "s"), ("b", 1, "s")], schema)
    log = spark.createDataFrame([("a", 4, "l"), ("b", 2, "l"), ("b", 9, "late")], schema)
    start = lambda how: rows(H.cold_start(how, snap, log, ["k"], "pos", 8), "k", "v")
    assert start("pg_snapshot") == [("a", "s"), ("b", "s")]
    assert start("kafka_replay") == [("a", "l"), ("b", "l")]
    assert start("dual_read") == [("a", "s"), ("b", "l")]
    with pytest.raises(ValueError):
        start("guess")


def test_administration(spark):
    s = spark.createDataFrame([("1", "StepPending(2)", 3, T0), ("2", "Completed", 4, T0 + dt.timedelta(1))], "saga_id string, status string, version long, updated_at timestamp_ntz")
    out = H.cancel_saga(H.cancel_saga(s, "1"), "2")
    assert rows(out, "saga_id", "status", "version") == [("1", "Cancelled", 4), ("2", "Completed", 4)]
    assert [r.saga_id for r in H.saga_list(s, 1).collect()] == ["2"]
    audited = H.audit(s, F.when(F.col("version") == 3, "pattern.paused").otherwise("cancel"), F.col("updated_at"), "p", "q", event_id=F.col("saga_id"))
    want = '{"log_type":"audit","schema_version":"1","timestamp":"2024-01-01T00:00:00Z","pattern_name":"p","pipeline_name":"q","operation":"pattern.paused","outcome":"success","event_id":"1"}'
    assert rows(audited) == [("pattern.paused", "2024-01-01T00:00:00Z", want)]
    with pytest.raises(ValueError):
        H.audit(s, "dlq.produce", F.col("updated_at"), "p", "q", color=F.lit("red"))
    c = spark.createDataFrame([("b", "x"), ("a", "y")], "pattern_name string, pipeline_name string")
    assert [r.pattern_name for r in H.checkpoint_list(c).collect()] == ["a", "b"]


def test_listener_counts(spark, tmp_path):
    metrics = listen(spark)
    spark.range(10).write.parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), "id long").observe("seen", F.count("*").alias("rows_seen"))
    q = stream.writeStream.queryName("counted").format("memory").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    for _ in range(50):
        if 'input_rows_total{query="counted"} 10' in metrics.text():
            break
        __import__("time").sleep(0.2)
    spark.streams.removeListener(metrics)
    assert 'input_rows_total{query="counted"} 10' in metrics.text() and 'rows_seen{query="counted"}' in metrics.text()
