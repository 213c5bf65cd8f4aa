"""Deduplication, idempotency and latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import sorted_fold


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each row with ``is_new``: true for the first of its keys. ``firsts`` keeps those only, without a sort."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("is_new", row == 1)


def firsts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Only the first row of each key, as one combined aggregate."""
    rest = [c for c in df.columns if c not in keys]
    smallest = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(smallest).select(*keys, "_row.*").select(*df.columns)


def ttl_dedup(df: DataFrame, keys: list[str], ts: str, order: list[str], ttl_seconds: int) -> DataFrame:
    """``is_new`` per row: accepted if no accepted row of its keys lies less than the lifetime before it.

    The window is anchored at the accepted row; duplicates do not extend it.
    """
    timed = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    ttl = ttl_seconds * 1_000_000

    def step(anchor, row):
        new = anchor == () or row[0] >= anchor[0] + ttl
        return ((row[0],) if new else anchor), (new,)

    return sorted_fold(timed, keys, [ts, *order], ["_us"], tuple, step, "is_new boolean").drop("_us")


def not_seen(df: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(seen.select(*keys).distinct(), keys, "left_anti")


def idempotent_responses(df: DataFrame, key: str, ts: str, order: list[str], response: str, ttl_seconds: int) -> DataFrame:
    """``is_new`` and ``given``: the response stored by the accepted request, which its duplicates get too.

    Requests without a key pass through with their own response.
    """
    timed = df.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))
    ttl = ttl_seconds * 1_000_000

    def step(held, row):
        us, own, name = row
        if name is None:
            return held, (True, own)
        if held == () or us >= held[0] + ttl:
            return (us, own), (True, own)
        return held, (False, held[1])

    kind = df.schema[response].dataType.simpleString()
    return sorted_fold(timed, [key], [ts, *order], ["_us", response, key], tuple, step, f"is_new boolean, given {kind}").drop("_us")


def http_gate(is_new: Column, key: Column) -> Column:
    """Status of a gate in front of a handler: pass without a key or when new, else 208."""
    return F.when(key.isNull() | is_new, F.lit(200)).otherwise(F.lit(208))


def unexpired(df: DataFrame, now: Column, expires_at: str = "expires_at") -> DataFrame:
    return df.filter(F.col(expires_at) > now)


def latest_state(changes: DataFrame, keys: list[str], position: str, op: str, value: str, on_delete: str = "remove") -> DataFrame:
    """Latest value per key of a change stream (op in c, u, r, d).

    ``remove`` drops deleted keys, ``nullify`` keeps them with a null. Upserts without a value change nothing.
    """
    relevant = changes.filter((F.col(op) == "d") | F.col(value).isNotNull())
    last = relevant.groupBy(*keys).agg(
        F.max_by(F.struct(F.col(op).alias("op"), F.col(value).alias("value")), F.col(position)).alias("s"), F.max(position).alias(position)
    )
    deleted = F.col("s.op") == "d"
    if on_delete == "remove":
        last = last.filter(~deleted)
    return last.select(*keys, position, F.when(~deleted, F.col("s.value")).alias(value))


def after_truncate(changes: DataFrame, table: str, position: str, op: str, truncate: str = "t") -> DataFrame:
    """Changes after their table's last truncation."""
    cut = changes.filter(F.col(op) == truncate).groupBy(table).agg(F.max(position).alias("_cut"))
    return (
        changes.filter(F.col(op) != truncate)
        .join(cut, table, "left")
        .filter(F.col("_cut").isNull() | (F.col(position) > F.col("_cut")))
        .drop("_cut")
    )


def advance(changes: DataFrame, last: int, position: str) -> DataFrame:
    """Published count and new position of a batch: the largest one if it is beyond the last."""
    return changes.agg(
        F.count("*").alias("published"), F.greatest(F.coalesce(F.max(position), F.lit(last)), F.lit(last)).alias("position")
    )


def newest(a: DataFrame, b: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Of a snapshot and a replay with the same columns, each key's row with the newer position."""
    both = a.unionByName(b)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_row")).select(*keys, "_row.*")


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with changes in place of rows with their keys."""
    ranked = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    return newest(ranked.limit(0), ranked, keys, "_new").drop("_new").select(*table.columns)


def version_conflicts(log: DataFrame, keys: list[str]) -> DataFrame:
    """Stream versions that were appended more than once."""
    return log.groupBy(*keys).agg(F.count("*").alias("writers")).filter("writers > 1")


def compare_and_set(attempts: DataFrame, keys: list[str], order: list[str], expected: str) -> DataFrame:
    """``accepted`` and ``version`` of ordered attempts: 0 inserts at 1 if there is no row, else the version must match.

    A version that is not 0 never matches a missing row.
    """

    def step(current, row):
        want = row[0]
        ok = want is not None and (want == current if current else want == 0)
        current += ok
        return current, (ok, current)

    return sorted_fold(attempts, keys, order, [expected], int, step, "accepted boolean, version long")


def drop_prefix(kv: DataFrame, prefix: str, key: str = "key") -> DataFrame:
    """A key-value table without one table's keys, as after a change of its definition."""
    return kv.filter(~F.col(key).startswith(prefix))
