"""Streaming forms of the operators, and running them to the end of their input."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from millrace.session import STATE_STORE
from millrace.sources.sinks import once_per_batch, written


def timed(df: DataFrame, ts: str, late: str) -> DataFrame:
    """Event time as a zoned timestamp with a watermark: streams refuse one on times without zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


class _Anchored(StatefulProcessor):
    """Keeps the anchor of a key's window; rows of one batch come sorted by time and tie-break."""

    ttl_us: int = 0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.anchor = handle.getValueState("anchor", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["us", "tie"], kind="stable")
        anchor = self.anchor.get()[0] if self.anchor.exists() else None
        new = []
        for us in batch["us"]:
            fresh = anchor is None or us >= anchor + self.ttl_us
            if fresh:
                anchor = int(us)
            new.append(fresh)
        self.anchor.update((anchor,))
        yield pd.DataFrame({"key": batch["key"], "tie": batch["tie"], "is_new": new})

    def close(self) -> None:
        pass


def ttl_dedup(stream: DataFrame, key: str, ts: str, tie: str, ttl_seconds: int) -> DataFrame:
    """``(key, tie, is_new)``: deduplication with a lifetime, state per key in the state store.

    Rows of a key must come in time order between batches, as from a partitioned log.
    """
    rows = stream.select(F.col(key).cast("long").alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(tie).cast("long").alias("tie"))
    processor = type("Anchored", (_Anchored,), {"ttl_us": ttl_seconds * 1_000_000})()
    return rows.groupBy("key").transformWithStateInPandas(processor, "key long, tie long, is_new boolean", "Append", "None")


class _Sagas(StatefulProcessor):
    """Runs the sagas of a bucket forward; at its first failure a saga compensates the finished steps backwards, once.

    Only failed sagas are remembered, as one block of ids per batch: the others have nothing that later steps depend on.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.over = handle.getListState("over", "ids binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        saga, step, bad = (batch[c].astype(kind).to_numpy() for c, kind in (("saga_id", "int64"), ("step", "int64"), ("failed", "bool")))
        before = [np.frombuffer(ids, "<i8") for (ids,) in self.over.get()]
        at = np.lexsort((step, saga))
        if before:
            at = at[~np.isin(saga[at], np.concatenate(before))]
        saga, step, bad = saga[at], step[at], bad[at]
        begins = np.flatnonzero(np.diff(saga, prepend=saga[:1] - 1))
        place = np.arange(len(saga))
        failure = np.minimum.reduceat(np.where(bad, place, len(saga)), begins) if len(saga) else place
        good = place < np.repeat(failure, np.diff(begins, append=len(saga)))
        failure = failure[failure < len(saga)]
        ids, done = saga[failure], np.maximum(step[failure], 0)
        if len(ids):
            self.over.appendValue((ids.astype("<i8").tobytes(),))
        back = np.repeat(done.cumsum(), done) - 1 - np.arange(done.sum())
        outcome = np.repeat(np.array(["success", "compensated"], object), [good.sum(), len(back)])
        yield pd.DataFrame({"saga_id": np.concatenate([saga[good], np.repeat(ids, done)]), "step": np.concatenate([step[good], back]), "outcome": outcome})

    def close(self) -> None:
        pass


def saga(stream: DataFrame, buckets: int = 4096) -> DataFrame:
    """Step outcomes of a stream of ``(saga_id, step, failed)`` whose steps come in order; every step has its saga.

    State is kept by bucket, and a bucket's sagas are handled at once: a call of Python and of the state store for each saga takes many
    times as long as its steps. The number of buckets belongs to the checkpoint.
    """
    bucket = F.pmod(F.xxhash64("saga_id"), F.lit(buckets)).alias("bucket")
    rows = stream.select(bucket, "saga_id", "step", F.coalesce("failed", F.lit(False)).alias("failed"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Sagas(), "saga_id long, step long, outcome string", "Append", "None")


def tumbling(stream: DataFrame, ts: str, size: str, late: str, keys: list[str], value: str) -> DataFrame:
    """Windows emitted once, when the watermark has passed them."""
    grouped = timed(stream, ts, late).groupBy(F.window(ts, size).alias("w"), *keys)
    amount = F.sum(F.col(value).cast("decimal(18,2)")).cast("double")
    return grouped.agg(F.count("*").alias("n"), amount.alias("total")).select(*keys, F.col("w.start").alias("window_start"), "n", "total")


def distinct(stream: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """First of each id within the watermark; state of older ids is dropped."""
    return timed(stream, ts, late).dropDuplicatesWithinWatermark([key])


def drain(stream: DataFrame, base: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, mode: str = "append", timeout: int = 600) -> DataFrame:
    """Runs a stream over all input there is, with an idempotent sink and a checkpoint below ``base``; the rows written."""
    spark = stream.sparkSession
    with_state_store(spark)
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(once_per_batch(f"{base}/out", transform))
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the stream did not drain in time")
    return written(spark, f"{base}/out")


def with_state_store(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def status(spark: SparkSession) -> DataFrame:
    """Active queries: name, state, last batch, rows and rates, from their progress reports."""
    rows = [_progress(q) for q in spark.streams.active]
    return spark.createDataFrame(rows, "name string, active boolean, batch long, input_rows long, rows_per_second double")


def _progress(query: StreamingQuery) -> tuple:
    p = query.lastProgress or {}
    return query.name, query.isActive, int(p.get("batchId", -1)), int(p.get("numInputRows", 0)), float(p.get("processedRowsPerSecond", 0.0) or 0.0)
