"""Operational metrics: counters, ratios, quantiles, histograms, rates, lag, rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def money(value: Column | str) -> Column:
    """Sums of amounts are taken over decimals, so they do not depend on the order of rows."""
    return F.sum((F.col(value) if isinstance(value, str) else value).cast("decimal(18,2)")).cast("double")


def counters(events: DataFrame, labels: list[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("n"))


def topic_lag(messages: DataFrame, topic: str = "topic", partition: str = "partition", offset: str = "offset") -> DataFrame:
    """Low and exclusive high watermark per partition, and the messages retained between them."""
    return messages.groupBy(topic, partition).agg(
        F.min(offset).alias("low"), (F.max(offset) + 1).alias("high"), (F.max(offset) + 1 - F.min(offset)).alias("lag")
    )


def error_ratio(events: DataFrame, labels: list[str], is_error: Column, threshold: float) -> DataFrame:
    """Errors over all, and whether that is above the threshold."""
    ratio = F.count_if(is_error) / F.count("*")
    return events.groupBy(*labels).agg(F.count("*").alias("n"), F.count_if(is_error).alias("errors"), ratio.alias("ratio"), (ratio > threshold).alias("breached"))


def _octave(value: Column) -> Column:
    """A number that grows with the value, eight to a doubling: a bucket that needs no knowledge of the data."""
    v = value.cast("double")
    size = 16_384 + F.floor(F.least(F.log2(F.abs(v)), F.lit(1100.0)) * 8)
    return F.when(v == 0, 0).when(F.isnan(v), 1 << 20).otherwise(F.signum(v) * size).cast("long")


def nearest_rank(values: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """Nearest-rank percentile: the smallest value that at least ``percent`` of all values do not exceed.

    Equal values are combined before the shuffle, and counted by bucket; a window over each key's few buckets finds the one that
    holds the rank, and only that bucket's values are ranked.
    """
    present = values.filter(F.col(value).isNotNull())
    names = [f"_k{k}" for k in range(len(keys))]
    distinct = present.groupBy(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), _octave(F.col(value)).alias("_b"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    per_key = Window.partitionBy(*names)
    upto = F.sum("_held").over(per_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    buckets = distinct.groupBy(*names, "_b").agg(F.sum("_n").alias("_held")).withColumns({"_upto": upto, "_all": F.sum("_held").over(per_key)})
    reached = F.col("_upto") * 100 >= F.col("_all") * percent
    before = F.col("_upto") - F.col("_held")
    target = buckets.filter(reached & (before * 100 < F.col("_all") * percent)).select(*(F.col(n).alias(f"{n}t") for n in names), F.col("_b").alias("_bt"), before.alias("_below"), "_all")
    same = F.col("_b") == F.col("_bt")
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"{n}t"))
    inside = distinct.join(target, same)
    rank = F.col("_below") + F.sum("_n").over(Window.partitionBy(*names).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_rank", rank).filter(F.col("_rank") * 100 >= F.col("_all") * percent)
    return found.groupBy(*names).agg(F.min("_v").alias(f"p{percent}"), F.max("_all").alias("n")).select(*(F.col(n).alias(k) for k, n in zip(keys, names, strict=True)), f"p{percent}", "n")


def histogram(values: DataFrame, keys: list[str], value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts per upper bound, the last one infinite (null); one pass, all bounds at once."""
    cells = [F.struct(F.lit(float(b)).alias("le"), F.count_if(F.col(value) <= b).alias("n")) for b in bounds]
    cells.append(F.struct(F.lit(None).cast("double").alias("le"), F.count(value).alias("n")))
    return values.groupBy(*keys).agg(F.array(*cells).alias("cells")).select(*keys, F.explode("cells").alias("c")).select(*keys, "c.le", "c.n")


def histogram_quantile(buckets: DataFrame, keys: list[str], q: float) -> DataFrame:
    """A quantile from cumulative buckets, linear inside its bucket; beyond the last finite bound that bound."""
    w = Window.partitionBy(*keys).orderBy(F.col("le").asc_nulls_last())
    b = buckets.withColumns(
        {
            "_from": F.coalesce(F.lag("le").over(w), F.lit(0.0)),
            "_below": F.coalesce(F.lag("n").over(w), F.lit(0)),
            "_rank": F.lit(q) * F.max("n").over(Window.partitionBy(*keys)),
        }
    )
    inside = F.col("_from") + (F.col("le") - F.col("_from")) * (F.col("_rank") - F.col("_below")) / F.nullif(F.col("n") - F.col("_below"), F.lit(0))
    return (
        b.filter((F.col("n") >= F.col("_rank")) & (F.col("_rank") > 0))
        .groupBy(*keys)
        .agg(F.min_by(F.when(F.col("le").isNull(), F.col("_from")).otherwise(inside), F.coalesce("le", F.lit(float("inf")))).alias("quantile"))
    )


def counter_increase(samples: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Increase of a counter between samples; a fall is a restart from zero. Rates divide by the time between."""
    w = Window.partitionBy(key).orderBy(ts)
    before = F.lag(value).over(w)
    step = F.when(F.col(value) >= before, F.col(value) - before).otherwise(F.col(value))
    seconds = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1_000_000
    return (
        samples.withColumns({"_seconds": seconds, "increase": F.when(before.isNotNull(), step)})
        .filter("_seconds > 0")
        .withColumn("rate", F.col("increase") / F.col("_seconds"))
        .drop("_seconds")
    )


def windowed_rate(samples: DataFrame, keys: list[str], series: str, ts: str, value: str, size: str, every: str | None = None) -> DataFrame:
    """Per-second rate of counters over time windows, by key: each series' increases in a window, summed, over its length.

    A fall is a restart from zero; the first sample of a series increases nothing. Windows overlap if ``every`` is shorter.
    """
    w = Window.partitionBy(*keys, series).orderBy(ts)
    before = F.lag(value).over(w)
    grown = samples.withColumn("_up", F.when(F.col(value) >= before, F.col(value) - before).when(before.isNotNull(), F.col(value)).otherwise(0))
    span = F.window(F.col(ts), size, every) if every else F.window(F.col(ts), size)
    seconds = (F.unix_micros(F.col("w.end").cast("timestamp")) - F.unix_micros(F.col("w.start").cast("timestamp"))) / 1_000_000
    return grown.groupBy(*keys, span.alias("w")).agg(F.sum("_up").alias("increase")).select(*keys, F.col("w.start").alias("window_start"), "increase", (F.col("increase") / seconds).alias("rate"))


def over_time(samples: DataFrame, keys: list[str], ts: str, value: str, size: str) -> DataFrame:
    """Smallest, largest, mean and last value of a gauge per key and window."""
    return samples.groupBy(*keys, F.window(F.col(ts), size).alias("w")).agg(
        F.min(value).alias("min_over_time"), F.max(value).alias("max_over_time"), money(value).alias("_sum"), F.count(value).alias("n"), F.max_by(value, ts).alias("last_over_time")
    ).select(*keys, F.col("w.start").alias("window_start"), "min_over_time", "max_over_time", (F.col("_sum") / F.nullif(F.col("n"), F.lit(0))).alias("avg_over_time"), "last_over_time")


def staleness(features: DataFrame, feature: str, event_time: str, written: str) -> DataFrame:
    """Milliseconds from event to write, per feature."""
    micros = F.unix_micros(F.col(written).cast("timestamp")) - F.unix_micros(F.col(event_time).cast("timestamp"))
    lag = F.floor(micros / 1000).cast("long")
    return features.groupBy(feature).agg(F.max(lag).alias("max_lag_ms"), F.min(lag).alias("min_lag_ms"), F.sum(lag).alias("sum_lag_ms"), F.count("*").alias("n"))


def leaderboard(events: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k keys with the largest totals, ties by key: partial sums, then top-k per task, never a full sort."""
    return events.groupBy(key).agg(money(value).alias("total")).orderBy(F.desc("total"), key).limit(k)


def daily_revenue(sales: DataFrame, seller: str, ts: str, amount: Column) -> DataFrame:
    return sales.groupBy(seller, F.to_date(ts).alias("day")).agg(money(amount).alias("revenue"), F.count("*").alias("n_sales"))


def ready(modules: DataFrame, backends: DataFrame) -> DataFrame:
    """Ready iff every module runs and no back end is degraded."""
    m = modules.agg(F.coalesce(F.every(F.col("state") == "Running"), F.lit(True)).alias("modules_ok"))
    b = backends.agg(F.coalesce(F.every(~F.col("degraded")), F.lit(True)).alias("backends_ok"))
    return m.crossJoin(b).withColumn("ready", F.col("modules_ok") & F.col("backends_ok"))


def prefix_search(names: DataFrame, name: str, prefix: str, k: int) -> DataFrame:
    """The first k names with a prefix, as a range that reaches the scan."""
    found = names.filter(F.col(name) >= prefix)
    stem = prefix.rstrip(chr(0x10FFFF))
    if stem:
        # Surrogates are no characters, so the one after them follows.
        last = ord(stem[-1]) + 1
        found = found.filter(F.col(name) < stem[:-1] + chr(0xE000 if last == 0xD800 else last))
    return found.orderBy(name).limit(k)


def prefixes(names: DataFrame, name: str) -> DataFrame:
    """All prefixes of each name, for an index of completions."""
    at = F.sequence(F.lit(1), F.length(name))
    return names.filter(F.length(name) > 0).select(name, F.explode(F.transform(at, lambda n: F.substr(F.col(name), F.lit(1), n))).alias("prefix"))
