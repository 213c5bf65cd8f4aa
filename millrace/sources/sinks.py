"""Sinks: batches written once, key-value upserts, and side outputs, for use in ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.dedup import upsert


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_once(df: DataFrame, base: str, batch_id: int) -> bool:
    """Writes a batch to the folder named after it, unless a finished one is there: replayed batches change nothing."""
    path = f"{base}/batch={batch_id}"
    if exists(df.sparkSession, f"{path}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def once_per_batch(base: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function with an idempotent Parquet sink behind it."""

    def write(df: DataFrame, batch_id: int) -> None:
        write_once(transform(df), base, batch_id)

    return write


def written(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.option("basePath", base).parquet(f"{base}/batch=*").drop("batch")


def routed(routes: dict[str, Callable[[DataFrame], DataFrame]], base: str) -> Callable[[DataFrame, int], None]:
    """One source, several filtered targets: the batch is kept while its branches are written."""

    def write(df: DataFrame, batch_id: int) -> None:
        df = df.persist()
        try:
            for name, branch in routes.items():
                write_once(branch(df), f"{base}/{name}", batch_id)
        finally:
            df.unpersist()

    return write


def put(kv: DataFrame, changes: DataFrame, now, ttl_seconds: int | None = None) -> DataFrame:
    """A key-value table (key, value, expires_at) after sets; a key's last change by ``seq`` wins."""
    last = changes.groupBy("key").agg(F.max_by("value", "seq").alias("value"))
    until = now + F.make_dt_interval(secs=F.lit(ttl_seconds)) if ttl_seconds is not None else F.lit(None)
    return upsert(kv, last.withColumn("expires_at", until.cast(kv.schema["expires_at"].dataType)), ["key"])


def delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """A key-value table without the given keys; keys that are not there change nothing."""
    return kv.join(keys.select("key").distinct(), "key", "left_anti")


def hset(maps: DataFrame, changes: DataFrame, now=None, ttl_seconds: int | None = None) -> DataFrame:
    """A table of maps (key, fields, expires_at) after changes (key, field, value, seq): a field's last change wins, others stay.

    A lifetime counts anew for the keys that changed; without one they no longer expire.
    """
    last = changes.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))
    fresh = last.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("_new"))
    until = now + F.make_dt_interval(secs=F.lit(ttl_seconds)) if ttl_seconds is not None else F.lit(None)
    none = F.create_map().cast(maps.schema["fields"].dataType)
    old = F.map_filter(F.coalesce("fields", none), lambda k, _: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False)))
    joined = maps.join(fresh, "key", "full_outer")
    expires = F.when(F.col("_new").isNull(), F.col("expires_at")).otherwise(until.cast(maps.schema["expires_at"].dataType))
    return joined.select("key", F.map_concat(old, F.coalesce("_new", none)).alias("fields"), expires.alias("expires_at"))


def live(kv: DataFrame, now) -> DataFrame:
    return kv.filter(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def published_snapshot(df: DataFrame, base: str, version: int) -> None:
    """A table as a numbered version; readers take the newest finished one."""
    df.write.mode("errorifexists").parquet(f"{base}/v={version:010d}")


def change_messages(changes: DataFrame, prefix: str, table: str, key: str, op: str, value: str, position: str) -> DataFrame:
    """Changes as messages (topic, key, value): a topic per table, ordered by key, and a null value (tombstone) for deletes."""
    body = F.to_json(F.struct(F.col(key).alias("key"), F.col(op).alias("op"), F.col(position).alias("lsn")))
    return changes.select(
        F.concat_ws(".", F.lit(prefix), F.col(table)).alias("topic"), F.col(key).cast("string").alias("key"), F.when(F.col(op) != "d", body).alias("value"), F.col(op).alias("op"), F.col(position).alias("lsn")
    )


def kafka_rows(messages: DataFrame) -> DataFrame:
    """Messages in the columns that Spark's Kafka sink takes; the sink is at-least-once."""
    return messages.select("topic", F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"))
