"""Time windows: rate limits, tumbling and rolling aggregates, conditions that hold for a while."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import sorted_fold


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sliding_add_first(requests: DataFrame, key: str, ts: str, window_seconds: int, limit: int) -> DataFrame:
    """Count in (t - window, t] including this request; allowed up to the limit. Rejected requests count too."""
    span = window_seconds * 1_000_000
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-(span - 1), 0)
    counted = requests.withColumn("_us", _micros(ts)).withColumn("in_window", F.count("*").over(w)).drop("_us")
    return limit_decision(counted, F.col("in_window"), limit, window_seconds * 1000)


def limit_decision(counted: DataFrame, count: Column, limit: int, window_ms: int | None) -> DataFrame:
    """``allowed``, what remains, and when to retry (null where the limiter gives no hint)."""
    ok = count <= limit
    retry = F.when(~ok, F.lit(window_ms)) if window_ms is not None else F.lit(None)
    return counted.withColumns(
        {"allowed": ok, "remaining": F.when(ok, limit - count).otherwise(0).cast("long"), "retry_after_ms": retry.cast("long")}
    )


def sliding_check_first(requests: DataFrame, key: str, ts: str, order: list[str], window_seconds: int, limit: int) -> DataFrame:
    """Rejects when ``limit`` accepted requests lie in (t - window, t]; rejected ones leave no trace."""
    span = window_seconds * 1_000_000

    def step(held, row):
        now = row[0]
        while held and held[0] <= now - span:
            held.popleft()
        ok = len(held) < limit
        if ok:
            held.append(now)
        return held, (ok, len(held))

    timed = requests.withColumn("_us", _micros(ts))
    return sorted_fold(timed, [key], [ts, *order], ["_us"], deque, step, "allowed boolean, in_window long").drop("_us")


def anchored_counter(requests: DataFrame, key: str, ts: str, order: list[str], window_seconds: int, limit: int) -> DataFrame:
    """A counter that expires a window after its first request; there is no gradual refill and no retry hint."""
    span = window_seconds * 1_000_000

    def step(held, row):
        start, n = held
        if start is None or row[0] >= start + span:
            start, n = row[0], 0
        return (start, n + 1), (n + 1 <= limit, n + 1)

    timed = requests.withColumn("_us", _micros(ts))
    return sorted_fold(timed, [key], [ts, *order], ["_us"], lambda: (None, 0), step, "allowed boolean, in_window long").drop("_us")


def violations(decided: DataFrame) -> DataFrame:
    return decided.filter(~F.col("allowed"))


def http_limit(decided: DataFrame) -> DataFrame:
    """Status and header of a limited route: 429 with whole seconds, one at least. Unknown outcomes pass."""
    rejected = F.coalesce(~F.col("allowed"), F.lit(False))
    seconds = F.greatest(F.lit(1), F.floor(F.col("retry_after_ms") / 1000)).cast("long")
    return decided.withColumns({"status": F.when(rejected, 429).otherwise(200), "retry_after": F.when(rejected, seconds)})


def tumbling(events: DataFrame, ts: str, size: str, keys: list[str], value: str) -> DataFrame:
    """Count, sum and mean per key and window; partial sums are combined before the shuffle. Works on streams."""
    amount = F.sum(F.col(value).cast("decimal(18,2)"))
    grouped = events.groupBy(F.window(F.col(ts), size).alias("w"), *keys)
    return grouped.agg(F.count("*").alias("n"), amount.cast("double").alias("total")).select(
        *keys, F.col("w.start").alias("window_start"), "n", "total", (F.col("total") / F.col("n")).alias("mean")
    )


def rolling_count(events: DataFrame, key: str, ts: str, days: int) -> DataFrame:
    """For each event, events of its key in the ``days`` up to it."""
    w = Window.partitionBy(key).orderBy("_us").rangeBetween(-(days * 86_400_000_000 - 1), 0)
    return events.withColumn("_us", _micros(ts)).withColumn("rolling", F.count("*").over(w)).drop("_us")


def sustained(samples: DataFrame, key: str, ts: str, condition: Column, seconds: int) -> DataFrame:
    """Stretches of samples for which a condition held without a break for at least a time: gaps and islands."""
    w = Window.partitionBy(key).orderBy(ts)
    island = F.sum(F.when(F.col("_holds"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = samples.withColumn("_holds", F.coalesce(condition, F.lit(False))).withColumn("_island", island)
    out = marked.filter("_holds").groupBy(key, "_island").agg(
        F.min(ts).alias("since"), F.max(ts).alias("until"), F.count("*").alias("samples")
    )
    lasted = (_micros("until") - _micros("since")) >= seconds * 1_000_000
    return out.filter(lasted).select(key, "since", "until", "samples")
