"""Ordered scans over range partitions: last known values, values before, running sums and row numbers.

A window with one task a key (or one task for all rows) does not hold when a key has a third of the table. Here the rows are
range-partitioned by key and order, so a large key spans many partitions; each partition reports what it would hand on (one
row), a pass over these few rows gives every partition its start, and the partitions are scanned side by side.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tonemill.session import cut, share_package


@dataclass
class State:
    """What a key's rows so far hand on to its next row."""

    last: dict[str, Any] = field(default_factory=dict)
    before: dict[str, Any] = field(default_factory=dict)
    sums: dict[str, int] = field(default_factory=dict)
    rows: int = 0

    def then(self, other: State) -> State:
        """The state after other's rows, which follow this state's rows in the same key."""
        if not other.rows:
            return self
        last = {c: v if v is not None else self.last.get(c) for c, v in other.last.items()}
        return State(last, other.before, {c: n + self.sums.get(c, 0) for c, n in other.sums.items()}, self.rows + other.rows)


@dataclass
class Scan:
    """Which columns are made of which: out -> source."""

    keys: list[str]
    last: dict[str, str]
    before: dict[str, str]
    sums: dict[str, str]
    number: str | None

    def edges(self, batch: pa.RecordBatch) -> np.ndarray:
        """Where a row's key is another than that of the row before; the first row is an edge."""
        edge = np.zeros(batch.num_rows, bool)
        edge[:1] = True
        for key in self.keys:
            codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            edge[1:] |= codes[1:] != codes[:-1]
        return edge

    def key_at(self, batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(k)[row].as_py() for k in self.keys)

    def step(self, batch: pa.RecordBatch, state: State, goes_on: bool) -> tuple[list[pa.Array], State]:
        """The new columns of a batch, and the state after it. goes_on: the first row has the key of the state."""
        if not goes_on:
            state = State()
        at = np.arange(batch.num_rows)
        start = np.maximum.accumulate(np.where(self.edges(batch), at, 0))
        first, tail = start == 0, int(start[-1])
        out, after = [], State(rows=int(at[-1]) - tail + 1 + (state.rows if tail == 0 else 0))

        def taken(column: pa.Array, index: np.ndarray, carried: Any) -> pa.Array:
            """column at index where that is in the key; else, in the first key of the batch, what was carried."""
            index = np.where(index >= start, index, -1)
            both = pa.concat_arrays([pa.array([carried], column.type), column])
            return both.take(pa.array(index + 1, mask=(index < 0) & ~first))

        for name, source in self.last.items():
            column = batch.column(source)
            known = column.is_valid().to_numpy(zero_copy_only=False)
            values = taken(column, np.maximum.accumulate(np.where(known, at, -1)), state.last.get(name))
            out.append(values)
            after.last[name] = values[-1].as_py()
        for name, source in self.before.items():
            column = batch.column(source)
            out.append(taken(column, at - 1, state.before.get(name)))
            after.before[name] = column[-1].as_py()
        for name, source in self.sums.items():
            values = batch.column(source).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            upto = np.cumsum(values)
            total = upto - upto[start] + values[start] + np.where(first, state.sums.get(name, 0), 0)
            out.append(pa.array(total, pa.int64()))
            after.sums[name] = int(total[-1])
        if self.number:
            out.append(pa.array(at - start + 1 + np.where(first, state.rows, 0), pa.int64()))
        return out, after

    def run(self, batches: Iterator[pa.RecordBatch], key: tuple | None, state: State) -> Iterator[tuple[pa.RecordBatch, list[pa.Array], tuple, State, bool]]:
        """Each batch with its new columns, its last key, the state after it and whether all rows so far have one key."""
        one = True
        for batch in batches:
            if not batch.num_rows:
                continue
            own = self.key_at(batch, 0)
            one &= (key is None or own == key) and own == self.key_at(batch, batch.num_rows - 1)
            columns, state = self.step(batch, state, own == key)
            key = self.key_at(batch, batch.num_rows - 1)
            yield batch, columns, key, state, one


def starts(reports: list[tuple[int, tuple, tuple, bool, State]]) -> dict[int, tuple[tuple, State]]:
    """part -> (key, state) at its start, of (part, first key, last key, whether it has one key, state of its last key)."""
    out, key, state = {}, None, State()
    for part, first, last, one, own in sorted(reports, key=lambda r: r[0]):
        if key is not None:
            out[part] = (key, state)
        state = state.then(own) if one and first == key else own
        key = last
    return out


def scanned(df: DataFrame, keys, order, last: dict[str, str] | None = None, before: dict[str, str] | None = None, sums: dict[str, str] | None = None, number: str | None = None) -> DataFrame:
    """df, range-partitioned and sorted by keys and order, with new columns (out: source) over each key's rows in that order.

    last: the last non-null value up to and with the row. before: the value of the row before, null in the first. sums: running
    sums of integers, nulls as 0. number: 1, 2, ... Without keys all rows are one sequence. Null keys are one key. Rows that
    agree in keys and order come in any order, so order should be total. An empty table gives an empty result. The driver gets
    a row of each partition: its keys and the values that it hands on.
    """
    share_package(df.sparkSession)
    scan = Scan(list(keys), last or {}, before or {}, sums or {}, number)
    rows = cut(df.orderBy(*keys, *order))
    sources = dict.fromkeys([*scan.keys, *scan.last.values(), *scan.before.values(), *scan.sums.values()])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, end = None, None
        for batch, _, key, state, one in scan.run(batches, None, State()):
            first = scan.key_at(batch, 0) if first is None else first
            end = (key, one, state)
        if end:
            told = pickle.dumps((TaskContext.get().partitionId(), first, *end))
            yield pa.record_batch([pa.array([told], pa.binary())], ["told"])

    needed = rows.select(*sources) if sources else rows.select(rows.columns[0])
    begin = starts([pickle.loads(r["told"]) for r in needed.mapInArrow(report, "told binary").collect()])
    shared = df.sparkSession.sparkContext.broadcast(begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = shared.value.get(TaskContext.get().partitionId(), (None, State()))
        for batch, columns, *_ in scan.run(batches, key, state):
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *added])

    kinds = {name: rows.schema[source].dataType for name, source in (scan.last | scan.before).items()}
    kinds |= {name: T.LongType() for name in [*scan.sums, *([number] if number else [])]}
    added = list(kinds)
    schema = T.StructType([*rows.schema.fields, *(T.StructField(n, k) for n, k in kinds.items())])
    return rows.mapInArrow(run, schema)
