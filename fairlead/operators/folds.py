"""Per-key recursion over ordered rows, in bounded memory.

Rows are dealt by key and sorted within partitions; a worker walks them in Arrow batches and keeps one key's state. No
key is ever held as a whole, however long its history.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


def names_of(schema: str) -> list[str]:
    return [part.strip().split()[0] for part in schema.split(",")]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = names_of(schema)
    kinds = [_TYPES[part.strip().split()[1]] for part in schema.split(",")]
    parts = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(p, k) for p, k in zip(parts, kinds, strict=True)], names)


def _dealt(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.repartition(key).sortWithinPartitions(key, *order)


def fold(rows: DataFrame, key: str, order: list[str], new_state: Callable[[], object], step: Callable[[object, dict], list[tuple]], schema: str) -> DataFrame:
    """step(state, row) -> output rows; new_state() begins a key."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            out = []
            columns = {n: c.to_pylist() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
            for values in zip(*columns.values(), strict=True):
                row = dict(zip(columns, values, strict=True))
                if row[key] != now:
                    now, state = row[key], new_state()
                out += step(state, row)
            yield _batch(out, schema)

    return _dealt(rows, key, order).mapInArrow(work, schema)


def fold_runs(rows: DataFrame, key: str, order: list[str], values: list[str], new_state: Callable[[], object], schema: str) -> DataFrame:
    """new_state() begins a key, a long that isn't null; state.feed(key, *arrays of the values) -> output rows, for the
    key's rows in each batch, nulls as NaN."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, out = batch[key].to_numpy(), []
            columns = [batch[v].to_numpy(zero_copy_only=False) for v in values]
            bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for a, b in zip(bounds, bounds[1:], strict=False):
                if a < b and keys[a] != now:
                    now, state = int(keys[a]), new_state()
                if a < b:
                    out += state.feed(now, *(c[a:b] for c in columns))
            yield _batch(out, schema)

    return _dealt(rows, key, order).mapInArrow(work, schema)
