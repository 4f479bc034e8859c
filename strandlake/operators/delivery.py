"""Exactly one copy of what was delivered at least once.

An identifier is a producer (here the acquisition) and a number (here the 128 bits of the read id, as an integer). Of each producer
the disjoint ranges of numbers seen so far are kept. In the order of arrival a number is accepted if no range covers it; it then
becomes part of the ranges, and ranges that touch are merged. Identifiers without a proper number are looked up one by
one in a table of exact keys.

Numbers are spread in blocks of consecutive ones, so that a producer with many fills many tasks, whether its numbers run on or are
random. Every task that reads rows first accepts among its own; what it finds repeated takes no further part, so
of an identifier delivered very often no more rows meet in one task than there are tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import acquisition_key
from ..session import checkpoint, repartitioned
from .ordered_scan import Scan, column, key_of, last_index, ordered_scan

#: Bytes of a number that name its block; the 24 bits after them count within it.
BLOCK_BYTES = 13
LOW = (1 << 8 * (16 - BLOCK_BYTES)) - 1
#: A key is the code of a producer (4 bytes) and a number (16), in an order that is that of the bytes.
KEY = "S20"
ROWS = "row_id long, malformed boolean, producer string, number binary, arrived timestamp, accepted boolean"
RANGES = "producer string, range_from binary, range_to binary, n_numbers long"


def _halves(keys: np.ndarray) -> np.ndarray:
    """The two 64-bit halves of the keys' numbers."""
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 20)[:, 4:]).view(">u8").reshape(-1, 2).astype(np.uint64)


def _codes(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 20)[:, :4]).view(">u4").ravel()


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint ranges, in order, those that touch as one."""
    if len(start) < 2:
        return start, end
    low, high = _halves(end[:-1]), _halves(start[1:])
    after = low[:, 1] + np.uint64(1)
    touch = (high[:, 1] == after) & (high[:, 0] == low[:, 0] + (after == 0).astype(np.uint64)) & (_codes(end[:-1]) == _codes(start[1:]))
    # the greatest number has no next one
    touch &= ~((after == 0) & (high[:, 0] == 0))
    return start[np.r_[True, ~touch]], end[np.r_[~touch, True]]


class SeenRanges:
    """The disjoint ranges of numbers seen, of all producers: some sorted lists of ranges, each longer than all that follow it, so
    that a new range is sorted in a number of times that grows with the logarithm of their count."""

    def __init__(self):
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []

    def accept(self, keys: np.ndarray) -> np.ndarray:
        """Of keys in their order of arrival those that no range covers yet, each once. They are covered from then on."""
        covered = np.zeros(len(keys), bool)
        for start, end in self.lists:
            at = np.searchsorted(start, keys, side="right") - 1
            covered |= (at >= 0) & (keys <= end[np.maximum(at, 0)])
        fresh = np.flatnonzero(~covered)
        new, first = np.unique(keys[fresh], return_index=True)
        if len(new):
            self._add(*_merged(new, new))
        out = np.zeros(len(keys), bool)
        out[fresh[first]] = True
        return out

    def _add(self, start: np.ndarray, end: np.ndarray) -> None:
        while self.lists and len(self.lists[-1][0]) <= 2 * len(start):
            start, end = self._both(self.lists.pop(), (start, end))
        self.lists.append((start, end))

    @staticmethod
    def _both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        start = np.concatenate([a[0], b[0]])
        order = np.argsort(start, kind="stable")
        return _merged(start[order], np.concatenate([a[1], b[1]])[order])

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last keys of the ranges, in order."""
        while len(self.lists) > 1:
            self.lists.append(self._both(self.lists.pop(), self.lists.pop()))
        return self.lists[0] if self.lists else (np.zeros(0, KEY), np.zeros(0, KEY))


class Acceptance:
    """What has been accepted in one task: ranges of numbers, and the exact keys of malformed identifiers."""

    def __init__(self, seen: SeenRanges | None = None):
        self.seen, self.exact, self.producers = seen or SeenRanges(), set(), {}

    def accept(self, batch: pa.RecordBatch) -> np.ndarray:
        malformed = np.asarray(column(batch, "malformed"))
        named = column(batch, "producer").dictionary_encode(null_encoding="encode")
        codes = np.array([self.producers.setdefault(p, len(self.producers)) for p in named.dictionary.to_pylist()], np.uint32)[np.asarray(named.indices)]
        number = column(batch, "number")
        out = np.zeros(batch.num_rows, bool)
        proper = np.flatnonzero(~malformed)
        if len(proper):
            fixed = number.take(pa.array(proper)).cast(pa.binary(16))
            keys = np.empty((len(proper), 20), np.uint8)
            keys[:, :4] = codes[proper].astype(">u4").view(np.uint8).reshape(-1, 4)
            keys[:, 4:] = np.frombuffer(fixed.buffers()[1], np.uint8, 16 * len(fixed), 16 * fixed.offset).reshape(-1, 16)
            out[proper] = self.seen.accept(keys.reshape(-1).view(KEY))
        for k in np.flatnonzero(malformed):
            key = int(codes[k]), number[k].as_py()
            out[k] = key not in self.exact
            self.exact.add(key)
        return out

    def ranges(self) -> pa.RecordBatch:
        start, end = self.seen.ranges()
        names = pa.array(list(self.producers), pa.string())
        plain = lambda keys: pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 20)[:, 4:]).tobytes())]).cast(pa.binary())
        n = _halves(end)[:, 1] - _halves(start)[:, 1] + np.uint64(1)  # a block has fewer numbers than 64 bits count
        return pa.RecordBatch.from_arrays([names.take(pa.array(_codes(start).astype(np.int64))), plain(start), plain(end), pa.array(n.astype(np.int64))], names=["producer", "range_from", "range_to", "n_numbers"])


def accepted_in(batches: Iterator[pa.RecordBatch], first: bool, give: str = "rows", acceptance: Acceptance | None = None) -> Iterator[pa.RecordBatch]:
    """One task's rows, sorted by arrival, with accepted; rows that were found repeated before stay so. give: rows, repeated (these
    alone), or ranges (at the end)."""
    acceptance = acceptance or Acceptance()
    for batch in batches:
        if not batch.num_rows:
            continue
        mask = np.ones(batch.num_rows, bool) if first else np.asarray(column(batch, "accepted"))
        at = np.flatnonzero(mask)
        accepted = np.zeros(batch.num_rows, bool)
        if len(at):
            accepted[at] = acceptance.accept(batch.take(pa.array(at)))
        if give == "ranges":
            continue
        names = [f.split(" ")[0] for f in ROWS.split(", ")]
        out = pa.RecordBatch.from_arrays([column(batch, c) for c in names[:-1]] + [pa.array(accepted)], names=names)
        yield out.filter(pa.array(~accepted)) if give == "repeated" else out
    if give == "ranges":
        yield acceptance.ranges()


def _accepted(rows: DataFrame, number: str, producer: str, arrived: str, row: str, give: str) -> DataFrame:
    value = F.col(number).cast("binary")
    keyed = rows.select(
        F.col(row).cast("long").alias("row_id"), (F.col(number).isNull() | (F.length(value) != 16)).alias("malformed"), acquisition_key(producer).alias("producer"),
        value.alias("number"), F.col(arrived).cast("timestamp").alias("arrived"),
    )
    order = [F.asc_nulls_last("arrived"), "row_id"]
    own = keyed.sortWithinPartitions(*order).mapInArrow(lambda batches: accepted_in(batches, True), ROWS)
    # what is repeated has no key any more: only its row goes on
    own = own.select("row_id", "malformed", "accepted", *[F.when(F.col("accepted"), F.col(c)).alias(c) for c in ("producer", "number", "arrived")])
    block = F.when(F.col("malformed"), F.col("number")).otherwise(F.substring("number", 1, BLOCK_BYTES))
    apart = repartitioned(own, F.when(~F.col("accepted"), F.col("row_id")), "producer", block)
    return apart.sortWithinPartitions(*order).mapInArrow(lambda batches: accepted_in(batches, False, give), RANGES if give == "ranges" else ROWS)


def accept(rows: DataFrame, number: str = "read_id", producer: str = "run_info", arrived: str = "received_at", row: str = "row_id", repeated_only: bool = False) -> DataFrame:
    """row_id and accepted: false for a repeated delivery; repeated_only gives out the latter alone.

    Of the rows of one identifier the first to arrive is accepted, by arrival, then by row number; an unknown time of
    arrival comes after all others. Identifiers without a proper number (null, or not of 16 bytes) are malformed: they are
    equal only if their bytes and producers are, nulls being equal to nulls. Columns besides the four named don't matter."""
    return _accepted(rows, number, producer, arrived, row, "repeated" if repeated_only else "rows").select("row_id", "accepted")


def repeated(rows: DataFrame) -> DataFrame:
    """The row_id of every row to be dropped."""
    return accept(rows, repeated_only=True).select("row_id")


class _Joined(Scan):
    """Ranges in order, those that touch brought together. State: the last range's producer and end, where the range it is part of
    begins, the first range of a partition scanned on its own, and whether all of it is one range so far."""

    schema = "producer string, range_from binary, range_to binary, n_numbers long"

    def step(self, state, batch):
        n = batch.num_rows
        start, end = column(batch, "range_from"), column(batch, "range_to")
        producer = column(batch, "producer").to_pylist()
        first, last = start.to_pylist(), end.to_pylist()
        before = [(state[0], state[1]) if state else None, *zip(producer[:-1], last[:-1], strict=True)]
        opens = np.array([b is None or not _next(b, (p, s)) for b, p, s in zip(before, producer, first, strict=True)])
        at = last_index(opens)
        begin = [first[k] if k >= 0 else state[2] for k in at]
        out = pa.RecordBatch.from_arrays([column(batch, "producer").cast(pa.string()), pa.array(begin, pa.binary()), end.cast(pa.binary()), column(batch, "n_numbers")], names=["producer", "range_from", "range_to", "n_numbers"])
        head, single = ((producer[0], first[0]), not opens[1:].any()) if state is None else (state[3], state[4] and not opens.any())
        return (*key_of(batch, ["producer", "range_to"], n - 1), begin[-1], head, bool(single)), out

    def merge(self, carry, local):
        if local[4] and _next((carry[0], carry[1]), local[3]):
            return local[0], local[1], carry[2], None, False
        return *local[:3], None, False


def _next(before: tuple, other: tuple) -> bool:
    """Does the range of other begin right after the number of before?"""
    return before[0] == other[0] and int.from_bytes(before[1], "big") + 1 == int.from_bytes(other[1], "big")


def seen_ranges(rows: DataFrame) -> DataFrame:
    """The disjoint ranges of numbers seen of each producer, as hex digits, with the count of numbers in each.

    Only ranges that reach an end of their block can go on in another one; these alone are put in order and joined."""
    found = checkpoint(_accepted(rows, "read_id", "run_info", "received_at", "row_id", "ranges"))
    low = lambda c: F.conv(F.hex(F.substring(c, BLOCK_BYTES + 1, 16 - BLOCK_BYTES)), 16, 10).cast("long")
    edge = (low("range_from") == 0) | (low("range_to") == LOW)
    joined = ordered_scan(found.filter(edge), ["producer", "range_from"], _Joined()).groupBy("producer", "range_from").agg(F.max("range_to").alias("range_to"), F.sum("n_numbers").alias("n_numbers"))
    every = found.filter(~edge).unionByName(joined)
    return every.select(F.col("producer").alias("acquisition_id"), F.lower(F.hex("range_from")).alias("range_from"), F.lower(F.hex("range_to")).alias("range_to"), "n_numbers")
