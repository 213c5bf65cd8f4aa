"""Outbox relay: pending batches, projection to messages, marking and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pending(outbox: DataFrame, batch_size: int | None = None) -> DataFrame:
    """Rows that wait to be published, in order; the filter reaches the scan, the limit is a top-k."""
    waiting = outbox.filter(F.col("status") == "pending")
    return waiting if batch_size is None else waiting.orderBy("id").limit(batch_size)


def to_messages(rows: DataFrame, default_topic: str) -> DataFrame:
    """Topic, key and value of each row: its own topic and key, else the module's topic and the aggregate's id."""
    return rows.select(
        "id",
        F.coalesce("kafka_topic", F.lit(default_topic)).alias("topic"),
        F.coalesce("kafka_key", "aggregate_id").alias("key"),
        F.col("payload").alias("value"),
    )


def mark_published(outbox: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    """The outbox after its messages with ``ids(id)`` were sent: a new snapshot."""
    sent = ids.select("id").distinct().withColumn("_sent", F.lit(True))
    now = F.col("_sent") & (F.col("status") == "pending")
    return (
        outbox.join(sent, "id", "left")
        .withColumns(
            {
                "published_at": F.when(now, at).otherwise(F.col("published_at")),
                "status": F.when(now, "published").otherwise(F.col("status")),
            }
        )
        .select(*outbox.columns)
    )


def reap(outbox: DataFrame, now: Column, retention_seconds: int | None) -> DataFrame:
    """The outbox without rows published longer ago than the retention; all of them if none is set."""
    if retention_seconds is None:
        return outbox
    old = (F.col("status") == "published") & (F.col("published_at") < now - F.make_dt_interval(secs=F.lit(retention_seconds)))
    return outbox.filter(~F.coalesce(old, F.lit(False)))


def appended(outbox: DataFrame, rows: DataFrame) -> DataFrame:
    """The outbox with new pending rows of the caller's transaction."""
    return outbox.unionByName(rows.withColumn("status", F.lit("pending")), allowMissingColumns=True)


def dead_letters(failed: DataFrame, topic: str, prefix: str = "events") -> DataFrame:
    """Failed messages as rows of their dead-letter topic."""
    return failed.withColumn("dlq_topic", F.concat_ws(".", F.lit(prefix), F.lit("dlq"), F.col(topic)))


def replay(dlq: DataFrame, topic: str) -> DataFrame:
    """Dead letters of one topic, back with the topic that their header names."""
    original = F.element_at(F.filter("headers", lambda h: h["key"] == "original-topic"), 1)["value"]
    return dlq.filter(F.col("dlq_topic") == topic).withColumn("topic", original)


def purge(dlq: DataFrame, topic: str) -> DataFrame:
    return dlq.filter(F.col("dlq_topic") != topic)


def poison_split(messages: DataFrame, payload: str) -> DataFrame:
    """``reason`` is poison_pill for payloads that are no JSON, else null; offsets of both are committed."""
    good = F.try_parse_json(F.col(payload)).isNotNull()
    return messages.withColumn("reason", F.when(~good, "poison_pill"))
