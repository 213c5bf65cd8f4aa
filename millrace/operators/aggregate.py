"""Event-sourced aggregates: user code that folds events into state, per key and in order."""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import dealt


class Aggregate(ABC):
    """State and how one event changes it. State must be JSON-serialisable."""

    @abstractmethod
    def initial(self) -> dict: ...

    @abstractmethod
    def apply(self, state: dict, event: dict) -> dict: ...


class Root:
    """An aggregate instance: state, version, and events not yet stored."""

    def __init__(self, aggregate: Aggregate, state: dict | None = None, version: int = 0):
        self.aggregate, self.version, self.pending = aggregate, version, []
        self.state = aggregate.initial() if state is None else state

    @classmethod
    def rehydrate(cls, aggregate: Aggregate, events: list[dict], snapshot: tuple[dict, int] | None = None) -> Root:
        root = cls(aggregate, *(snapshot or (None, 0)))
        for event in events:
            root.state = aggregate.apply(root.state, event)
            root.version += 1
        return root

    def apply_new(self, event: dict) -> None:
        self.state = self.aggregate.apply(self.state, event)
        self.version += 1
        self.pending.append(event)

    def take_pending(self) -> list[dict]:
        out, self.pending = self.pending, []
        return out

    def snapshot(self) -> tuple[dict, int]:
        return self.state, self.version


def folded(events: DataFrame, aggregate: Callable[[], Aggregate], key: str, order: list[str], snapshots: DataFrame | None = None) -> DataFrame:
    """``(key, state, version)``: each key's events folded by user code; state as JSON.

    Events stream in order through one state at a time, whatever a key's history. With ``snapshots(key, state, version)`` a key starts
    from its snapshot, and the events are those after it.
    """
    if snapshots is not None:
        start = snapshots.select(key, F.col("state").alias("_state"), F.col("version").alias("_version"))
        events = events.join(start, key, "left")
    kind = events.schema[key].dataType.simpleString()
    place = events.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, at, root = aggregate(), None, None
        for batch in batches:
            done = []
            for event in batch.to_pylist():
                if root is None or event[key] != at:
                    if root is not None:
                        done.append((at, json.dumps(root.state, sort_keys=True), root.version))
                    at, state = event[key], event.pop("_state", None)
                    root = Root(code, None if state is None else json.loads(state), event.pop("_version", None) or 0)
                root.state = code.apply(root.state, event)
                root.version += 1
            yield _rows(done, batch.schema.field(place).type)
            last = batch.schema.field(place).type
        if root is not None:
            yield _rows([(at, json.dumps(root.state, sort_keys=True), root.version)], last)

    def _rows(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        keys, states, versions = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(states, pa.string()), pa.array(versions, pa.int64())], names=[key, "state", "version"])

    return dealt(events, [key], order).mapInArrow(run, f"`{key}` {kind}, state string, version long")
