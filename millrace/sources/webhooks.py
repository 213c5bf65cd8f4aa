"""HTTP delivery of events to subscriptions: signed posts with retries, a delivery log, and dead letters.

Deliveries are dealt out by endpoint, and an endpoint's are posted in order by one task, which keeps the endpoint's breaker. Tasks
may be run again after a lost executor, so delivery is at-least-once; the event's id goes along for the receiver to drop copies.
"""

from __future__ import annotations

import hashlib
import hmac
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scalars import dlq_headers
from millrace.operators.folds import dealt
from millrace.operators.outbox import dead_letters

#: Takes (url, body, headers) and gives the status; raises if there is no answer.
Post = Callable[[str, bytes, dict[str, str]], int]
_LOG = "event_id string, subscription_id string, endpoint_url string, outcome string, attempts int, status int, success boolean, error string, waited_s long"


def http_post(url: str, body: bytes, headers: dict[str, str], timeout: float = 10.0) -> int:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status
    except urllib.error.HTTPError as error:
        return error.code


@dataclass
class Endpoint:
    """Breaker of one endpoint: transport failures block it for a time, unless a delivery succeeds between them; error answers change nothing."""

    failures: int = 5
    block_seconds: float = 60.0
    missed: int = 0
    until: float = 0.0

    def blocked(self, now: float) -> bool:
        return now < self.until

    def record(self, good: bool, now: float) -> None:
        self.missed = 0 if good else self.missed + 1
        if self.missed >= self.failures:
            self.missed, self.until = 0, now + self.block_seconds


def deliver_one(post: Post, url: str, body: bytes, headers: dict[str, str], endpoint: Endpoint, max_attempts: int, sleep: Callable[[float], None], clock: Callable[[], float]) -> tuple:
    """Outcome, attempts, last status, success, error and seconds waited of one delivery."""
    if endpoint.blocked(clock()):
        return "skipped_cb_open", 0, None, False, None, 0
    error, waited, status = None, 0, None
    for attempt in range(1, max_attempts + 1):
        try:
            status = post(url, body, headers)
        except Exception as failure:
            status, error = None, str(failure) or type(failure).__name__
            endpoint.record(False, clock())
        else:
            if 200 <= status < 300:
                endpoint.record(True, clock())
                return "delivered", attempt, status, True, None, waited
            error = f"HTTP {status}"
        wait = 1 << min(attempt, 6)
        sleep(wait)
        waited += wait
    return "dlq", max_attempts, None, False, error, waited


def deliver(sends: DataFrame, post: Post = http_post, max_attempts: int = 10, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic, failures: int = 5, block_seconds: float = 60.0) -> DataFrame:
    """The delivery log of ``sends(event_id, event_type, payload, subscription_id, endpoint_url, secret)``, a row each.

    Posting happens where the result is computed: write it once, and read ``delivery_log`` and ``undelivered`` from what was written.
    """
    columns = ("event_id", "event_type", "payload", "subscription_id", "endpoint_url", "secret")
    rows = sends.select(*(F.col(c).cast("string").alias(c) for c in columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, endpoint = None, Endpoint(failures, block_seconds)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["endpoint_url"] != at:
                    at, endpoint = row["endpoint_url"], Endpoint(failures, block_seconds)
                body = (row["payload"] or "").encode()
                headers = {"Content-Type": "application/json", "X-Event-ID": row["event_id"] or "", "X-Event-Type": row["event_type"] or ""}
                if row["secret"] is not None:
                    headers["X-Signature"] = "sha256=" + hmac.new(row["secret"].encode(), body, hashlib.sha256).hexdigest()
                result = deliver_one(post, at, body, headers, endpoint, max_attempts, sleep, clock)
                out.append((row["event_id"], row["subscription_id"], at, *result))
            kinds = [pa.string()] * 4 + [pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _LOG.split(", ")])

    return dealt(rows, ["endpoint_url"], ["event_id", "subscription_id"]).mapInArrow(run, _LOG)


def delivery_log(found: DataFrame, at: Column) -> DataFrame:
    """Rows for the delivery log: what was delivered, with its status, and what was given up, with its error."""
    return found.filter(F.col("outcome").isin("delivered", "dlq")).select("event_id", "subscription_id", "status", "success", "error", at.alias("delivered_at"))


def undelivered(found: DataFrame, sends: DataFrame, topic: str, at: Column) -> DataFrame:
    """Dead letters of deliveries that were given up, with their payload, key and headers."""
    lost = found.filter("outcome = 'dlq'").select("event_id", "subscription_id", "attempts", "error")
    events = sends.select(F.col("event_id").cast("string").alias("event_id"), F.col("subscription_id").cast("string").alias("subscription_id"), "payload", "offset")
    failed = lost.join(events, ["event_id", "subscription_id"]).withColumn("topic", F.lit(topic))
    headers = dlq_headers(F.col("topic"), F.col("offset"), F.col("error"), F.col("attempts"), F.lit("WebhookDeliveryFailed"), at, F.lit(None).cast("string"))
    return dead_letters(failed.withColumn("headers", headers), "topic").select("event_id", "subscription_id", "dlq_topic", F.col("event_id").alias("key"), F.col("payload").alias("value"), "headers")


def post_batches(base: str, write_once: Callable[[DataFrame, str, int], bool], **options) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that posts a batch's sends and writes their log below ``base``, once a batch."""

    def write(df: DataFrame, batch_id: int) -> None:
        write_once(deliver(df, **options), base, batch_id)

    return write
