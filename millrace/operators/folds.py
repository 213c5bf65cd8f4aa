"""Ordered folds per key: state machines over event logs.

Rows are dealt out by key and sorted in their partition; a task then streams them, carrying one state. A key's history
is never collected, so memory is bounded however long it is; a key's rows do stay in one task, as each
step needs the one before. Where a closed form exists (first, latest, counts since a reset) operators use windows instead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

State = object
Step = Callable[[State, tuple], tuple[State, tuple]]


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows dealt out by key and sorted by key and order: what a fold's tasks stream.

    They are dealt by a hash of the keys. A shuffle by the keys themselves is left out where a join has made one, and as tasks in Arrow ask
    for no distribution, adaptive execution may then make that join a broadcast or split its large keys: a key's rows end up in many tasks.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order)


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], State], step: Step, outputs: str) -> DataFrame:
    """``df`` with ``outputs`` (a DDL of columns) from ``step(state, inputs) -> (state, outputs)``, by keys in order.

    Null keys form a key of their own. Order must be total for a definite result: end it with a unique column.
    """
    added = T.StructType.fromDDL(outputs)
    schema = T.StructType(df.schema.fields + added.fields)
    arrow = to_arrow_schema(added)
    places = [df.columns.index(c) for c in inputs]
    key_places = [df.columns.index(c) for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            made = []
            names = zip(*(batch.column(k).to_pylist() for k in key_places), strict=True)
            values = zip(*(batch.column(k).to_pylist() for k in places), strict=True)
            for key, value in zip(names, values, strict=True):
                if key != at or state is None:
                    at, state = key, start()
                state, out = step(state, value)
                made.append(out)
            columns = list(zip(*made, strict=True)) or [()] * len(arrow)
            new = [pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(list(batch.columns) + new, names=list(batch.schema.names) + arrow.names)

    return dealt(df, keys, order).mapInArrow(run, schema)
