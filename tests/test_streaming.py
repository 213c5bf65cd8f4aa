"""Streams: state across batches, idempotent sinks, own sources, routing, configuration."""

import datetime as dt


import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup
from millrace.plans.pipeline import Pipeline, load, rendered_key
from millrace.sources import sinks, streams
from millrace.streaming import queries as Q
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)


def test_ttl_dedup_over_batches_equals_batch(spark, tmp_path):
    data = [(k % 3, k, T0 + dt.timedelta(hours=3 * k)) for k in range(40)]
    df = spark.createDataFrame(data, "user long, n long, ts timestamp_ntz")
    for lo in range(0, 40, 10):
        df.filter(F.col("n").between(lo, lo + 9)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.file_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    out = Q.drain(Q.ttl_dedup(stream, "user", "ts", "n", 20 * 3600), str(tmp_path / "run"))
    batch = dedup.ttl_dedup(df, ["user"], "ts", ["n"], 20 * 3600)
    assert rows(out, "tie", "is_new") == rows(batch, "n", "is_new")


def test_sagas_by_bucket_equal_each_saga_alone(spark, tmp_path):
    """Steps over three batches, in sagas that fail at once, late, twice or never; state is by bucket, however many sagas there are."""
    steps = [(saga * 7919 - 50, step, (saga + 2 * step) % 5 == 0 if saga % 4 else None) for saga in range(60) for step in range(saga % 7 + 1)]
    df = spark.createDataFrame(steps, "saga_id long, step long, failed boolean")
    for lo in (0, 2, 4):
        df.filter(F.col("step").between(lo, lo + (1 if lo < 4 else 9))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    expected, over = [], set()
    for saga, step, bad in steps:
        if saga not in over and not bad:
            expected.append((saga, step, "success"))
        elif saga not in over:
            over.add(saga)
            expected += [(saga, k, "compensated") for k in range(step)]
    out = Q.drain(Q.saga(streams.file_stream(spark, str(tmp_path / "in"), df.schema, files_per_batch=1), buckets=3), str(tmp_path / "run"))
    assert sorted(tuple(r) for r in out.collect()) == sorted(expected)
    state = spark.read.format("statestore").option("stateVarName", "over").load(str(tmp_path / "run" / "checkpoint"))
    assert state.select("key").distinct().count() == 3 < len(over)


def test_sink_writes_a_batch_once(spark, tmp_path):
    df = spark.range(3)
    assert sinks.write_once(df, str(tmp_path), 7)
    assert not sinks.write_once(spark.range(100), str(tmp_path), 7)
    assert sinks.written(spark, str(tmp_path)).count() == 3


def test_counted_log_and_routes(spark, tmp_path):
    streams.register(spark)
    stream = spark.readStream.format("counted_log").options(total=100, per_batch=30, slices=3).load()
    write = sinks.routed({"even": lambda d: d.filter("value % 2 = 0"), "odd": lambda d: d.filter("value % 2 = 1")}, str(tmp_path / "r"))
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(120):
            q.processAllAvailable()
            if q.lastProgress and "100" in str(q.lastProgress["sources"][0]["endOffset"]):
                break
        assert rows(Q.status(spark), "active") == [(True,)]
    finally:
        q.stop()
    n = sum(sinks.written(spark, str(tmp_path / "r" / name)).count() for name in ("even", "odd"))
    assert n == 100


def test_key_value_table(spark):
    kv = spark.createDataFrame([("a", "1", T0)], "key string, value string, expires_at timestamp_ntz")
    changes = spark.createDataFrame([("a", "2", 1), ("a", "3", 2), ("b", "9", 1)], "key string, value string, seq int")
    now = F.lit(T0 + dt.timedelta(seconds=10))
    out = sinks.put(kv, changes, now, 300)
    assert rows(out, "key", "value") == [("a", "3"), ("b", "9")]
    assert rows(sinks.live(kv, now)) == []
    assert rows(sinks.live(sinks.put(kv, changes, now), now), "key") == [("a",), ("b",)]


def test_pipeline_and_config(spark):
    df = spark.createDataFrame([(1, "a", "{}"), (2, "b", "{x"), (3, "a", "{}")], "id int, kind string, payload string")
    bad = F.when(F.try_parse_json("payload").isNull(), "poison_pill")
    p = Pipeline(df).with_dlq(bad, "orders").filter(F.col("id") < 3).with_retry(2)
    assert rows(p.source, "id") == [(1,)] and rows(p.dead[0], "id", "dlq_topic") == [(2, "events.dlq.orders")]
    tried = []

    def write(rows_):
        tried.append(rows_.count())
        if len(tried) < 2:
            raise OSError("once")

    p.to(write)
    assert tried == [1, 1]
    assert set(p.route(a=F.col("kind") == "a", b=F.col("kind") == "b")) == {"a", "b"}
    assert df.select(rendered_key("user:{id}", {"id": F.col("id")})).first()[0] == "user:1"
    patterns = load('{"patterns": [{"name": "i", "type": "inbox", "dedup_ttl": "24h"}]}')
    assert patterns[0].millis("dedup_ttl", "1h") == 86_400_000
    for text in ('{"patterns": [{"name": "i", "type": "nope"}]}', '{"patterns": [{"name": "i", "type": "inbox", "dedup_ttl": "soon"}]}'):
        with pytest.raises(ValueError):
            load(text)


def test_distinct_drops_repeated_and_late_ids(spark, tmp_path):
    # A batch's watermark bars late rows from the batch after the next one on.
    batches = [[("a", 0), ("b", 10), ("a", 1)], [("c", 10), ("b", 10)], [("c", 10), ("late", 1), ("d", 12), ("d", 12)]]
    for k, batch in enumerate(batches):
        df = spark.createDataFrame([(i, T0 + dt.timedelta(hours=h)) for i, h in batch], "id string, ts timestamp_ntz").coalesce(1)
        df.write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = streams.file_stream(spark, str(tmp_path / "in" / "*"), df.schema, files_per_batch=1)
    out = Q.drain(Q.distinct(stream, "id", "ts", "1 hour"), str(tmp_path / "run"))
    assert sorted(r.id for r in out.collect()) == ["a", "b", "c", "d"]
