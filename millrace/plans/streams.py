"""Streaming queries over the driver's tables, run to the end of their input; the SQL is that of their batch twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.operators import machines, outbox
from millrace.plans.monitoring import _fold
from millrace.session import shared_dir
from millrace.sources import fixtures as X
from millrace.sources import streams
from millrace.streaming import queries as Q


def _base(spark, name):
    return f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex[:12]}"


def _events(spark, d):
    # A pattern, as the stream source takes a folder or a pattern but no single file.
    return streams.file_stream(spark, f"{d}/event[s].parquet", X.table(spark, d, "events").schema)


def stream_ttl_dedup(spark, d):
    Q.with_state_store(spark)
    out = Q.drain(Q.ttl_dedup(_events(spark, d), "user_id", "ts", "event_id", 6 * 3600), _base(spark, "ttl"))
    return out.select(F.col("key").alias("user_id"), F.col("tie").alias("event_id"), "is_new")


def stream_tumbling_daily(spark, d):
    out = Q.drain(Q.tumbling(_events(spark, d), "ts", "1 day", "1 hour", ["event_type"], "value"), _base(spark, "tumbling"))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def stream_distinct_users(spark, d):
    out = Q.drain(Q.distinct(_events(spark, d).select("user_id", "event_type", "ts"), "user_id", "ts", "90 days"), _base(spark, "distinct"))
    return out.select("user_id")


def stream_saga(spark, d):
    Q.with_state_store(spark)
    base = _base(spark, "saga")
    X.saga_steps(spark, d).select("saga_id", F.col("step").cast("long").alias("step"), "failed").write.parquet(f"{base}/in")
    steps = streams.file_stream(spark, f"{base}/in", "saga_id long, step long, failed boolean")
    return Q.drain(Q.saga(steps), base)


def stream_outbox_relay(spark, d):
    base = _base(spark, "outbox")
    X.outbox(spark, d).write.parquet(f"{base}/in")
    rows = streams.file_stream(spark, f"{base}/in", X.outbox(spark, d).schema)
    return Q.drain(outbox.to_messages(outbox.pending(rows), "orders"), base)


def stream_exactly_once(spark, d):
    """Each batch's outcomes are written once, in a folder named after the batch."""
    m = lambda df: machines.exactly_once(df.withColumn("fails", F.col("event_id") % 4 == 0), "user_id", ["event_id"], "fails")
    out = Q.drain(_events(spark, d).select("event_id", "user_id"), _base(spark, "eos"), m)
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


QUERIES = {
    "stream_ttl_dedup": (
        stream_ttl_dedup,
        """WITH RECURSIVE s AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        f AS (SELECT user_id, event_id, ts, n, TRUE AS is_new, ts AS anchor FROM s WHERE n = 1
          UNION ALL SELECT s.user_id, s.event_id, s.ts, s.n, s.ts >= f.anchor + INTERVAL 6 HOUR,
            CASE WHEN s.ts >= f.anchor + INTERVAL 6 HOUR THEN s.ts ELSE f.anchor END FROM f JOIN s ON s.user_id = f.user_id AND s.n = f.n + 1)
        SELECT user_id, event_id, is_new FROM f""",
    ),
    "stream_tumbling_daily": (
        stream_tumbling_daily,
        """SELECT * FROM (SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
    ),
    "stream_distinct_users": (stream_distinct_users, "SELECT DISTINCT user_id FROM events"),
    "stream_saga": (
        stream_saga,
        f"""WITH {X.SAGA_SQL}, k AS (SELECT saga_id, min(step) FILTER (failed) AS k FROM steps GROUP BY 1)
        SELECT saga_id, step, 'success' AS outcome FROM steps JOIN k USING (saga_id) WHERE k IS NULL OR step < k
        UNION ALL SELECT saga_id, unnest(range(0, k)) AS step, 'compensated' FROM k WHERE k > 0""",
    ),
    "stream_outbox_relay": (
        stream_outbox_relay,
        f"""WITH {X.OUTBOX_SQL} SELECT id, coalesce(kafka_topic, 'orders') AS topic, coalesce(kafka_key, aggregate_id) AS key, payload AS value
        FROM outbox WHERE status = 'pending'""",
    ),
    "stream_exactly_once": (
        stream_exactly_once,
        """WITH RECURSIVE """ + _fold(
            "{'d': e.event_id % 4 <> 0, 'o': CASE WHEN e.event_id % 4 = 0 THEN 'aborted' ELSE 'committed' END}",
            "CASE WHEN f.s.d THEN {'d': TRUE, 'o': 'duplicate'} ELSE {'d': e.event_id % 4 <> 0, 'o': CASE WHEN e.event_id % 4 = 0 THEN 'aborted' ELSE 'committed' END} END",
            "s.o AS outcome, count(*) AS n",
            "event_id",
        ).removeprefix("WITH RECURSIVE ") + " GROUP BY 1",
    ),
}
