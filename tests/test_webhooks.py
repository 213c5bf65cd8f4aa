"""Webhook delivery: retries, breaker, log and dead letters, over a stand-in for the network and over a real local server."""

import datetime as dt
import hashlib
import hmac
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import machines
from millrace.plans.pipeline import of_tenant, topic_name
from millrace.sources import sinks, streams, webhooks
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
SENDS = "event_id string, event_type string, payload string, subscription_id string, endpoint_url string, secret string, offset long"


def answers(*codes):
    """A post that gives these answers in turn; None is a refused connection."""
    left = list(codes)

    def post(url, body, headers):
        code = left.pop(0)
        if code is None:
            raise ConnectionError("refused")
        return code

    return post


def one(post, most=3, endpoint=None):
    slept = []
    found = webhooks.deliver_one(post, "u", b"{}", {}, endpoint or webhooks.Endpoint(), most, slept.append, lambda: 0.0)
    return found, slept


def test_deliveries_are_retried_until_they_arrive_or_are_given_up():
    assert one(answers(500, 200)) == (("delivered", 2, 200, True, None, 2), [2])
    assert one(answers(500, None, 404)) == (("dlq", 3, None, False, "HTTP 404", 14), [2, 4, 8])
    assert one(answers(None, None, None))[0][4] == "refused"
    assert one(answers(*[503] * 8), 8)[1] == [2, 4, 8, 16, 32, 64, 64, 64]


def test_an_endpoint_is_blocked_after_failures_in_a_row():
    e = webhooks.Endpoint(failures=2, block_seconds=10)
    assert one(answers(None, 200), 3, e)[0][0] == one(answers(None, 200), 3, e)[0][0] == "delivered" and not e.blocked(0)
    assert one(answers(None, 500, None), 3, e)[0][0] == "dlq" and e.blocked(0)
    assert one(answers(), 3, e)[0] == ("skipped_cb_open", 0, None, False, None, 0)
    assert not e.blocked(10)


def test_signed_posts_over_http(spark):
    seen = []

    class Receiver(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            seen.append((self.headers["X-Event-ID"], self.headers["X-Signature"], body))
            self.send_response(500 if len(seen) == 1 else 201)
            self.end_headers()

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Receiver)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/hook"
        sends = spark.createDataFrame([("e1", "T", '{"a":1}', "s", url, "key", 5), ("e2", "T", None, "s", url, None, 6)], SENDS)
        found = webhooks.deliver(sends, sleep=lambda _: None)
        out = spark.createDataFrame(found.collect(), found.schema)
    finally:
        server.shutdown()
    assert rows(out, "event_id", "outcome", "attempts", "status") == [("e1", "delivered", 2, 201), ("e2", "delivered", 1, 201)]
    sign = "sha256=" + hmac.new(b"key", b'{"a":1}', hashlib.sha256).hexdigest()
    assert seen == [("e1", sign, b'{"a":1}')] * 2 + [("e2", None, b"")]
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    assert rows(webhooks.delivery_log(out, at), "event_id", "status", "success") == [("e1", 201, True), ("e2", 201, True)]
    assert webhooks.undelivered(out, sends, "t", at).count() == 0


def test_an_endpoint_is_polled_as_a_stream(spark, tmp_path):
    records = [{"position": n, "body": {"n": n}} for n in range(1, 24) if n % 7]

    class Records(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: int(v[0]) for k, v in parse_qs(urlparse(self.path).query).items()}
            found = records[-1:] if "last" in q else [r for r in records if q["after"] < r["position"] <= q["upto"]]
            body = json.dumps(found).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Records)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    streams.register(spark)
    try:
        stream = spark.readStream.format("http_endpoint").options(url=f"http://127.0.0.1:{server.server_port}/records", page=4).load()
        q = stream.writeStream.foreachBatch(sinks.once_per_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        try:
            for _ in range(100):
                q.processAllAvailable()
                if q.lastProgress and "23" in str(q.lastProgress["sources"][0]["endOffset"]):
                    break
        finally:
            q.stop()
    finally:
        server.shutdown()
    out = sorted(map(tuple, sinks.written(spark, str(tmp_path / "out")).collect()))
    assert out == [(r["position"], json.dumps(r["body"])) for r in records]


def test_batches_of_a_stream_are_posted_and_logged_once(spark, tmp_path):
    sends = spark.createDataFrame([("e1", "T", "{}", "s", "u", None, 1)], SENDS)
    write = webhooks.post_batches(str(tmp_path), sinks.write_once, post=lambda *_: 200)
    write(sends, 3)
    write(sends, 3)
    assert sinks.written(spark, str(tmp_path)).count() == 1


def test_times_in_any_session_zone(spark):
    df = spark.createDataFrame([(T0 + dt.timedelta(microseconds=n),) for n in (0, 123_000, 123_456)], "ts timestamp_ntz").withColumn("zoned", F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp"))))
    kept = df.select("ts", F.unix_micros("zoned").alias("us")).collect()
    want = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.123Z", "2024-01-01T00:00:00.123456Z"]
    again = spark.createDataFrame(kept, "ts timestamp_ntz, us long").withColumn("zoned", F.timestamp_micros("us"))
    try:
        for zone in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert [tuple(r) for r in again.select(S.rfc3339(F.col("ts")), S.rfc3339(F.col("zoned"))).collect()] == [(x, x) for x in want]
        autumn = spark.range(2).select(F.timestamp_micros(F.lit(1_730_610_000_000_000) + F.col("id") * 3_600_000_000).alias("t"))
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert [r[0] for r in autumn.select(S.rfc3339(F.col("t"))).collect()] == ["2024-11-03T05:00:00Z", "2024-11-03T06:00:00Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_retry_policy_and_jitter(spark):
    keys = spark.range(2000).select(S.spread(F.col("id"), 20).alias("f"))
    low, high, n = keys.select(F.min("f"), F.max("f"), F.count_distinct("f")).first()
    assert 0.8 <= low < 0.82 and 1.18 < high <= 1.2 and n > 1500
    one_row = spark.range(1).select(S.retry_delay_ms(F.lit("redis_read"), F.lit(7)), S.retry_delay_ms(F.lit("redis_read"), F.lit(8)), S.retry_delay_ms(F.lit("none"), F.lit(1)))
    assert tuple(one_row.first()) == (3200.0, None, None)


def test_half_open_gate_counts_running_calls(spark):
    calls = [("k", 1, 0, 10), ("k", 2, 1, 3), ("k", 3, 2, 9), ("k", 4, 3, 4), ("k", 5, 10, 11)]
    df = spark.createDataFrame([(k, n, T0 + dt.timedelta(seconds=a), T0 + dt.timedelta(seconds=b)) for k, n, a, b in calls], "k string, n int, a timestamp_ntz, b timestamp_ntz")
    assert [r[1] for r in rows(machines.half_open_gate(df, "k", "a", "b", ["n"], 2), "n", "admitted")] == [True, True, False, True, True]


def test_tenants(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "tenant_id string, n int")
    assert rows(of_tenant(df, "a"), "n") == [(1,)]
    assert [r[0] for r in df.orderBy("n").select(topic_name("prod", F.col("tenant_id"), "shop", F.lit("x"))).collect()] == ["prod.a.shop.x", "prod.b.shop.x", None]
    for bad in (lambda: of_tenant(df, ""), lambda: of_tenant(df.drop("tenant_id"), "a")):
        try:
            bad()
        except ValueError:
            continue
        raise AssertionError("a read without a tenant went through")


def test_maps_keep_other_fields(spark):
    maps = spark.createDataFrame([("a", {"x": "1", "y": "2"}, None), ("b", {}, T0)], "key string, fields map<string,string>, expires_at timestamp_ntz")
    changes = spark.createDataFrame([("a", "y", "3", 1), ("a", "y", "4", 2), ("c", "z", None, 1)], "key string, field string, value string, seq int")
    out = {r.key: (r.fields, r.expires_at) for r in sinks.hset(maps, changes, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), 60).collect()}
    assert out == {"a": ({"x": "1", "y": "4"}, T0 + dt.timedelta(seconds=60)), "b": ({}, T0), "c": ({"z": None}, T0 + dt.timedelta(seconds=60))}


def test_a_poller_goes_on_where_it_left(spark, tmp_path):
    table = spark.range(10).withColumnRenamed("id", "lsn")
    first = streams.ChangePoller(table, "lsn", str(tmp_path / "p"), 4)
    assert rows(first.poll()) == [(0,), (1,), (2,), (3,)]
    again = streams.ChangePoller(table, "lsn", str(tmp_path / "p"), 4)
    assert rows(again.poll()) == [(0,), (1,), (2,), (3,)]
    again.advance()
    assert rows(again.poll()) == [(4,), (5,), (6,), (7,)]
    again.advance()
    last = streams.ChangePoller(table, "lsn", str(tmp_path / "p"), 4)
    assert rows(last.poll()) == [(8,), (9,)]
    last.advance()
    assert last.poll() is None
