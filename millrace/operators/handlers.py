"""Patterns around user code and stores: inbox handlers, saga steps, write-behind, refreshes, cold starts, administration."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import rfc3339

from .dedup import newest, upsert
from .folds import sorted_fold
from .lookup import feature_lookup


def inbox(messages: DataFrame, seen: DataFrame, key: str, order: list[str], handler: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(handled, outcomes)``: new messages go to the handler, once each; outcomes are new or duplicate.

    Ids are claimed by writing ``handled`` and the ids in one batch, so a failed handler claims nothing.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    known = seen.select(key).distinct().withColumn("_seen", F.lit(True))
    marked = messages.withColumn("_first", first).join(known, key, "left")
    new = F.col("_first") & F.col("_seen").isNull()
    outcomes = marked.withColumn("outcome", F.when(new, "new").otherwise("duplicate")).drop("_first", "_seen")
    return handler(outcomes.filter("outcome = 'new'").drop("outcome")), outcomes


def inbox_two_tier(messages: DataFrame, cache: DataFrame, store: DataFrame, key: str, order: list[str], breaker_open: bool = False) -> DataFrame:
    """``outcome`` per message: new, duplicate_cache or duplicate_store.

    The cache gates messages; while its breaker is open the store's ids do, so deduplication is never skipped. Ids of earlier messages
    of the batch are in both. What the cache has lost, but the store has, still ends as a duplicate of the store: its insert conflicts.
    """
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order)) == 1
    flag = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    marked = messages.withColumn("_first", first).join(flag(store, "_stored"), key, "left")
    if breaker_open:
        outcome = F.when(~F.col("_first") | F.col("_stored"), "duplicate_store").otherwise("new")
        return marked.withColumn("outcome", outcome).drop("_first", "_stored")
    marked = marked.join(flag(cache, "_cached"), key, "left")
    outcome = F.when(~F.col("_first") | F.col("_cached"), "duplicate_cache").when(F.col("_stored"), "duplicate_store").otherwise("new")
    return marked.withColumn("outcome", outcome).drop("_first", "_stored", "_cached")


@dataclass(frozen=True)
class Step:
    name: str
    execute: Callable[[dict], dict]
    compensate: Callable[[dict], dict] = lambda state: state


class StepFailed(Exception):
    """Raised by a step that failed as expected: earlier steps are compensated. Any other exception ends the run as it is.

    It is known by its mark, not by its class, as code on executors may have a copy of the class.
    """

    expected = True


@dataclass
class Saga:
    """Steps in order, built one by one."""

    name: str
    steps: list[Step] = field(default_factory=list)

    def step(self, name: str, execute: Callable[[dict], dict], compensate: Callable[[dict], dict] | None = None) -> Saga:
        self.steps.append(Step(name, execute, compensate or (lambda state: state)))
        return self

    def run(self, state: dict, start: int = 0, compensating: bool = False) -> tuple[str, dict, list[tuple[int, str, str]]]:
        """Final status, state and step log. ``start`` resumes at a step; backwards from it if compensating."""
        log: list[tuple[int, str, str]] = []
        failed = start if compensating else -1
        if not compensating:
            for k in range(start, len(self.steps)):
                try:
                    state = self.steps[k].execute(state)
                    log.append((k, self.steps[k].name, "success"))
                except Exception as error:
                    if not getattr(error, "expected", False):
                        return f"Error({error})", state, log
                    log.append((k, self.steps[k].name, "failed"))
                    failed = k
                    break
            else:
                return "Completed", state, log
        for k in range(failed - 1, -1, -1):
            try:
                state = self.steps[k].compensate(state)
            except Exception as error:
                if not getattr(error, "expected", False):
                    return f"Failed({error})", state, log
            log.append((k, self.steps[k].name, "compensated"))
        return "RolledBack", state, log


def run_sagas(inputs: DataFrame, saga: Saga, key: str) -> DataFrame:
    """``(key, status, state)``: the saga run for each row; the row is its first state. Sagas are spread over tasks."""
    import json

    kind = inputs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(row[key], *saga.run(row)[:2]) for row in batch.to_pylist()]
            keys, status, state = zip(*out, strict=True) if out else ((), (), ())
            place = batch.schema.get_field_index(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, batch.schema.field(place).type), pa.array(status, pa.string()), pa.array([json.dumps(s, sort_keys=True, default=str) for s in state], pa.string())],
                names=[key, "status", "state"],
            )

    return inputs.mapInArrow(run, f"`{key}` {kind}, status string, state string")


def write_behind(pending: DataFrame, store: DataFrame, key: str, order: str) -> DataFrame:
    """The store after a flush: each key's last pending write wins, applied in one batch."""
    rest = [c for c in pending.columns if c not in (key, order)]
    last = pending.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(key, "_row.*")
    return upsert(store, last, [key])


def distribute_flags(flags: DataFrame, cache: DataFrame) -> DataFrame:
    """The flag cache after a poll of all flags."""
    return upsert(cache, flags.select(*cache.columns), ["name"])


def refresh_features(entities: DataFrame, online: DataFrame, offline: DataFrame, key: str, now: Column, max_age_seconds: int) -> DataFrame:
    """The online store after stale or missing features of the entities were copied from the offline one."""
    found = feature_lookup(entities, online, offline, key, now, max_age_seconds).filter("write_back")
    fresh = found.select(key).join(offline, key).select(*online.columns)
    return upsert(online, fresh, [key])


def cold_start(strategy: str, snapshot: DataFrame, log: DataFrame, keys: list[str], position: str, high: int) -> DataFrame:
    """State to start from: the snapshot, the log replayed up to its high mark at the start, or the newer of both."""
    rest = [c for c in log.columns if c not in keys]
    bounded = log.filter(F.col(position) <= high).groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(position)).alias("_row")).select(*keys, "_row.*")
    if strategy == "pg_snapshot":
        return snapshot
    if strategy == "kafka_replay":
        return bounded
    if strategy == "dual_read":
        return newest(snapshot, bounded, keys, position)
    raise ValueError(f"unknown cold start: {strategy!r}")


TERMINAL = ("Completed", "RolledBack", "Failed", "Cancelled")


def cancel_saga(sagas: DataFrame, saga_id: str) -> DataFrame:
    """Sagas after one that has not ended was cancelled; a cancelled saga is terminal and gets a new version."""
    tag = F.regexp_extract("status", "^[A-Za-z]+", 0)
    hit = (F.col("saga_id") == saga_id) & ~tag.isin(*TERMINAL)
    return sagas.withColumns({"status": F.when(hit, "Cancelled").otherwise(F.col("status")), "version": F.col("version") + hit.cast("long")})


def saga_list(sagas: DataFrame, limit: int = 100) -> DataFrame:
    return sagas.orderBy(F.desc("updated_at"), "saga_id").limit(limit)


def checkpoint_list(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.orderBy("pattern_name", "pipeline_name")


#: Operations that change durable state, each of which an audit row names. Fixed values.
AUDITED = (
    "outbox.relay",
    "inbox.consume",
    "inbox.duplicate_skip",
    "cdc.event",
    "saga.step.execute",
    "saga.step.compensate",
    "saga.complete",
    "saga.failed",
    "dlq.produce",
    "dlq.replay",
    "circuit_breaker.opened",
    "circuit_breaker.closed",
    "pattern.paused",
    "pattern.resumed",
)
_AUDIT_FIELDS = ("trace_id", "span_id", "event_id", "event_type", "kafka_topic", "kafka_offset", "duration_ms", "instance_id")


def audit(events: DataFrame, operation: Column | str, at: Column, pattern: str, pipeline: str, outcome: Column | str = "success", **fields: Column) -> DataFrame:
    """Rows ``(operation, timestamp, value)`` for an append-only audit log; the value is the event as JSON, without the fields it lacks.

    An operation that is not in ``AUDITED`` gives null, and the row is left out.
    """
    unknown = set(fields) - set(_AUDIT_FIELDS)
    if unknown:
        raise ValueError(f"no audit fields: {sorted(unknown)}")
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    named = lit(operation)
    parts = {"log_type": F.lit("audit"), "schema_version": F.lit("1"), "timestamp": rfc3339(at)}
    parts |= {k: fields[k] for k in ("trace_id", "span_id") if k in fields}
    parts |= {"pattern_name": F.lit(pattern), "pipeline_name": F.lit(pipeline), "operation": named, "outcome": lit(outcome)}
    parts |= {k: fields[k] for k in _AUDIT_FIELDS[2:] if k in fields}
    value = F.to_json(F.struct(*(c.alias(k) for k, c in parts.items())))
    return events.filter(named.isin(*AUDITED)).select(named.alias("operation"), rfc3339(at).alias("timestamp"), value.alias("value"))


def write_through(store: DataFrame, cache: DataFrame, changes: DataFrame, key: str, order: str, until: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Store and cache after ordered writes: a key's last write goes to the store first, and the cache takes what the store then has.

    The cache so never holds a value that the store lacks. ``until`` is the cache rows' expiry.
    """
    rest = [c for c in changes.columns if c not in (key, order)]
    last = changes.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row")).select(key, "_row.*")
    stored = upsert(store, last, [key])
    fresh = stored.join(last.select(key), key, "left_semi")
    if "expires_at" in cache.columns:
        fresh = fresh.withColumn("expires_at", (F.lit(None) if until is None else until).cast(cache.schema["expires_at"].dataType))
    return stored, upsert(cache, fresh.select(*cache.columns), [key])


#: What each control does to a pattern in a state; others leave it as it is. Reloading restarts, replaying runs from the start.
CONTROLS = {
    ("Running", "pause"): "Paused",
    ("Paused", "resume"): "Running",
    ("Running", "replay"): "Replaying",
    ("Paused", "replay"): "Replaying",
    ("Replaying", "resume"): "Running",
    ("Running", "reload"): "Running",
    ("Paused", "reload"): "Paused",
}


def controlled(commands: DataFrame, key: str, order: list[str], command: str) -> DataFrame:
    """``state`` of a pattern after each pause, resume, replay or reload, from Running, and whether the command was ``applied``."""
    table = dict(CONTROLS)

    def step(state, row):
        after = table.get((state, row[0]))
        return after or state, (after or state, after is not None)

    return sorted_fold(commands, [key], order, [command], lambda: "Running", step, "state string, applied boolean")
