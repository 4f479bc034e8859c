"""A sequential scan in a global order, run in parallel.

Many operators need "what came before" in an order per entity: the furthest end so far, the row just before, a run of
equal values. A window per entity would bring one entity's rows into one task, and an entity may hold a third of all
rows. Here rows are range-sorted by entity *and* order, so that an entity spreads over as many partitions as it fills.
Each partition is summarised by the state it ends in; the summaries, one small row a partition, are combined
from left to right on the driver; then every partition is scanned again from the state carried into it.

The sorted rows are checkpointed in between, so both passes see the same partitions, also when executors are lost. There are as
many partitions as the rows fill, MAX_PARTITIONS at most; states are small and of a size that doesn't grow with the rows, so
those that are sent to the executors, one a partition, are bounded. A task unpickles its own only.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, partitions_for

#: Column of the sorted rows that holds the number of their partition.
PARTITION = "_partition"


class Scan:
    """What an ordered scan does. States must be picklable and small: they don't grow with the rows."""

    #: DDL of the rows that step() gives out.
    schema: str

    def step(self, state: Any, batch: pa.RecordBatch) -> tuple[Any, pa.RecordBatch | None]:
        """state is None at the very start."""
        raise NotImplementedError

    def merge(self, carry: Any, local: Any) -> Any:
        """The state after a partition, from the state before it and the one it ends in when scanned on its own."""
        return local


def ordered_scan(df: DataFrame, order: list[Any], scan: Scan, partitions: int | None = None) -> DataFrame:
    """Runs scan over df in the order of the columns given; the rows that are given out keep no particular order."""
    partitions = partitions or partitions_for(df)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    # a task's own number isn't that of the partition where the scan stands in a union: the rows say it
    ordered = checkpoint(ranged.sortWithinPartitions(*order).withColumn(PARTITION, F.spark_partition_id()))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, pid = None, None
        for batch in batches:
            if batch.num_rows:
                state, pid = scan.step(state, batch)[0], column(batch, PARTITION)[0].as_py()
        if pid is not None:
            yield pa.RecordBatch.from_pydict({"pid": pa.array([pid], pa.int32()), "state": pa.array([pickle.dumps(state)], pa.binary())})

    pids, packed, carry = [], [], None
    for pid, state in sorted(tuple(row) for row in ordered.mapInArrow(summarise, "pid int, state binary").collect()):
        if carry is not None:
            pids.append(pid)
            packed.append(pickle.dumps(carry))
        carry = pickle.loads(state) if carry is None else scan.merge(carry, pickle.loads(state))
    carried = df.sparkSession.sparkContext.broadcast((np.array(pids, np.int32), np.cumsum([0, *map(len, packed)]), b"".join(packed)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, begun = None, False
        for batch in batches:
            if batch.num_rows:
                if not begun:
                    state = _carried(carried.value, column(batch, PARTITION)[0].as_py())
                begun = True
                state, out = scan.step(state, batch)
                if out is not None and out.num_rows:
                    yield out

    return ordered.mapInArrow(run, scan.schema)


def _carried(states: tuple[np.ndarray, np.ndarray, bytes], pid: int) -> Any:
    pids, ends, packed = states
    at = int(np.searchsorted(pids, pid))
    return pickle.loads(packed[ends[at] : ends[at + 1]]) if at < len(pids) and pids[at] == pid else None


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def key_of(batch: pa.RecordBatch, names: Iterable[str], at: int) -> tuple:
    return tuple(column(batch, n)[at].as_py() for n in names)


def differs(values: pa.Array) -> np.ndarray:
    """For each row but the first: is it another value than the row before? Null equals null only."""
    if len(values) < 2:
        return np.zeros(0, bool)
    unequal = pc.not_equal(values[1:], values[:-1])
    nulls = np.asarray(values.is_null())
    return np.where(nulls[1:] | nulls[:-1], nulls[1:] != nulls[:-1], np.asarray(unequal.fill_null(False)))


def starts(batch: pa.RecordBatch, names: Iterable[str], before: tuple | None) -> np.ndarray:
    """Rows that begin another entity than the row before; before: the entity of the last row of the batch before."""
    names = list(names)
    flag = np.zeros(batch.num_rows, bool)
    for n in names:
        flag[1:] |= differs(column(batch, n))
    flag[0] = before is None or key_of(batch, names, 0) != before
    return flag


def running_max(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The greatest value so far, this row included, since the last row marked in first."""
    ranked = np.sort(values)
    rank = np.searchsorted(ranked, values)
    section = np.cumsum(first) * (len(values) + 1)
    return ranked[np.maximum.accumulate(section + rank) - section]


def last_index(flag: np.ndarray) -> np.ndarray:
    """For each row the place of the last marked row up to it, -1 if none."""
    return np.maximum.accumulate(np.where(flag, np.arange(len(flag)), -1))


def ints(values: pa.Array, null: int = 0) -> np.ndarray:
    return np.asarray(values.cast(pa.int64()).fill_null(null))

