"""Lookups: caches, feature stores, flags, enrichment, point-in-time joins and fan-out.

Joins carry no broadcast hints: the optimizer broadcasts a side only when it knows it to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import byte_sum_bucket, md5_bucket


def cache_aside(requests: DataFrame, cache: DataFrame, store: DataFrame, key: str, value: str) -> DataFrame:
    """Each request with its value and ``outcome``: hit, miss_filled (then to be cached) or miss_absent."""
    c = cache.select(key, F.col(value).alias("_cached"), F.lit(True).alias("_hit"))
    s = store.select(key, F.col(value).alias("_stored"), F.lit(True).alias("_found"))
    joined = requests.join(c, key, "left").join(s, key, "left")
    outcome = F.when(F.col("_hit"), "hit").when(F.col("_found"), "miss_filled").otherwise("miss_absent")
    return joined.select(
        *requests.columns, F.when(F.col("_hit"), F.col("_cached")).otherwise(F.col("_stored")).alias(value), outcome.alias("outcome")
    )


def hit_ratio(outcomes: DataFrame) -> DataFrame:
    """Hits over all lookups; undefined (null) without any."""
    hits, n = F.count_if(F.col("outcome") == "hit"), F.count("*")
    return outcomes.agg(hits.alias("hits"), (n - hits).alias("misses"), (hits / F.nullif(n, F.lit(0))).alias("hit_ratio"))


def feature_lookup(requests: DataFrame, online: DataFrame, offline: DataFrame, key: str, now: Column, max_age_seconds: int) -> DataFrame:
    """Online features if fresh, else offline ones, else stale online ones; ``source`` tells which.

    ``online`` and ``offline`` have (key, value, computed_at). A row is stale when it is older than the limit.
    ``write_back`` marks values to copy to the online store.
    """
    o = online.select(key, F.col("value").alias("_on"), F.col("computed_at").alias("_on_at"))
    f = offline.select(key, F.col("value").alias("_off"), F.col("computed_at").alias("_off_at"))
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_on_at").cast("timestamp"))) / 1_000_000)
    fresh = F.col("_on_at").isNotNull() & (age <= max_age_seconds)
    has_off, has_on = F.col("_off_at").isNotNull(), F.col("_on_at").isNotNull()
    source = F.when(fresh, "online").when(has_off, "offline").when(has_on, "stale").otherwise("absent")
    value = F.when(fresh, F.col("_on")).when(has_off, F.col("_off")).otherwise(F.col("_on"))
    return (
        requests.join(o, key, "left")
        .join(f, key, "left")
        .select(*requests.columns, value.alias("value"), source.alias("source"), (~fresh & has_off).alias("write_back"))
    )


def flag_for_entity(requests: DataFrame, flags: DataFrame, entity: str) -> DataFrame:
    """Decisions for requests of ``(name, entity)``: rollout by md5 of flag:entity; no percentage, or no entity, means on.

    Requests for flags that do not exist are dropped.
    """
    both = requests.join(flags.select("name", "enabled", "rollout"), "name")
    return both.withColumn("bucket", md5_bucket(F.concat_ws(":", "name", F.col(entity).cast("string")))).withColumn(
        "is_on", F.col("enabled") & (F.col("rollout").isNull() | F.col(entity).isNull() | (F.col("bucket") < F.col("rollout")))
    )


def flag_by_name(flags: DataFrame) -> DataFrame:
    """A flag's one answer for all users: by the byte sum of its name."""
    bucket = byte_sum_bucket(F.col("name"))
    full = F.col("rollout").isNull() | (F.col("rollout") >= 100)
    return flags.withColumn("bucket", bucket).withColumn("is_on", F.col("enabled") & (full | (bucket < F.col("rollout"))))


def flag_with_fallback(names: DataFrame, cache: DataFrame, store: DataFrame, breaker_open: bool = False) -> DataFrame:
    """Flag rows by name from the cache, else from the store; only from the store while the breaker is open."""
    s = store.select("name", F.col("enabled").alias("_store"))
    if breaker_open:
        out = names.join(s, "name", "left").withColumn("_cache", F.lit(None).cast("boolean"))
    else:
        out = names.join(cache.select("name", F.col("enabled").alias("_cache")), "name", "left").join(s, "name", "left")
    found = F.when(F.col("_cache").isNotNull(), "cache").when(F.col("_store").isNotNull(), "store").otherwise("not_found")
    return out.select("name", F.coalesce("_cache", "_store").alias("enabled"), found.alias("found_in"))


def enrich(stream: DataFrame, reference: DataFrame, key: str, columns: list[str], fallback: str = "unknown") -> DataFrame:
    """Left join with a reference table; strings that are not found become the fallback. Works on streams."""
    joined = stream.join(reference.select(key, *columns), key, "left")
    kinds = dict(reference.dtypes)
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(fallback)) for c in columns if kinds[c] == "string"})


def point_in_time(labels: DataFrame, features: DataFrame, key: str, label_ts: str, feature_ts: str, feature: str, label_order: str, feature_order: str) -> DataFrame:
    """For each label the latest feature at or before it; labels without one are dropped.

    Features and labels are merged into one sorted stream per key and the last feature is carried on: one shuffle, one sort,
    no pairs. A feature at a label's time counts; of several at one time the one that sorts last.
    """
    rest = [c for c in labels.columns if c != key]
    f = features.select(
        key, F.col(feature_ts).alias("_ts"), F.lit(0).alias("_side"), F.col(feature_order).alias("_n"), F.struct(F.col(feature_ts), F.col(feature)).alias("_f"), F.lit(None).cast(labels.select(F.struct(*rest)).schema[0].dataType).alias("_l")
    )
    x = labels.select(
        key, F.col(label_ts).alias("_ts"), F.lit(1).alias("_side"), F.col(label_order).alias("_n"), F.lit(None).cast(f.schema["_f"].dataType).alias("_f"), F.struct(*rest).alias("_l")
    )
    w = Window.partitionBy(key).orderBy("_ts", "_side", "_n").rowsBetween(Window.unboundedPreceding, 0)
    carried = f.unionByName(x).withColumn("_f", F.last("_f", ignorenulls=True).over(w))
    return carried.filter("_side = 1 and _f is not null").select(key, "_l.*", "_f.*")


def fan_out(events: DataFrame, subscriptions: DataFrame, event_type: str) -> DataFrame:
    """A row per event and enabled subscription to its type, as an equality join on the exploded types."""
    wanted = subscriptions.filter("enabled").select("subscription_id", "endpoint_url", F.explode(F.array_distinct("event_types")).alias(event_type))
    return events.join(wanted, event_type)


def missing_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Rows that break a foreign key."""
    return children.filter(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")
