"""References to records that do not exist, or not at the time.

Keys become integers, and sets of keys become compressed bitmaps, one for each range of keys and each day: the keys that rows
refer to, and the keys whose target arrives and is never deleted. With each bit goes the first period of the day (a millisecond)
in which it was so. Going through the days of a range, the keys referred to AND NOT those in place since an earlier day are left;
of these, again, those in place since an earlier period of the same day are cleared. What survives is decoded: keys and days. Only
references to a surviving key on its day, and targets of surviving keys, are then held against each other by exact
times, in one carried scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import acquisition_key
from ..session import broadcast_if_small, checkpoint, repartitioned
from .ordered_scan import Scan, column, ints, key_of, ordered_scan, running_max, starts
from .select import numbered

#: Keys in one bitmap, and its bytes before compression.
BITS = 8192
#: Microseconds of a period and of a day; periods in a day.
PERIOD_US, DAY_US = 1000, 86_400_000_000
NEVER = DAY_US // PERIOD_US
FOREVER = 2**63 - 1
TARGET, REFERENCE = 1, 2
#: Events put into bitmaps at once within a task.
BUFFERED = 2_000_000


def dictionary(keys: DataFrame) -> DataFrame:
    """Dense integers (from 0) for the distinct values of the only column: value, key_id."""
    name = keys.columns[0]
    ordered = keys.dropna().distinct().select(F.col(name).alias("value")).sortWithinPartitions("value")
    return numbered(ordered, "key_id")


def _micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def reference_events(refs: DataFrame) -> DataFrame:
    """refs(ref_field, key_id, row_id, received_at). An unknown time counts as after all others."""
    time = F.coalesce(_micros("received_at"), F.lit(FOREVER))
    return refs.select("ref_field", "key_id", time.alias("t"), F.lit(REFERENCE).alias("kind"), F.col("row_id").cast("long").alias("row_id"), F.lit(0).cast("long").alias("until"))


def target_events(targets: DataFrame) -> DataFrame:
    """targets(ref_field, key_id, received_at, deleted_at). A target with an unknown time of arrival never lives."""
    until = F.coalesce(_micros("deleted_at"), F.lit(FOREVER))
    return targets.filter("received_at IS NOT NULL").select("ref_field", "key_id", _micros("received_at").alias("t"), F.lit(TARGET).alias("kind"), F.lit(None).cast("long").alias("row_id"), until.alias("until"))


PIECES = "ref_field string, key_range long, day long, arrived boolean, bits binary, periods binary"
_PIECES = pa.schema([("ref_field", pa.string()), ("key_range", pa.int64()), ("day", pa.int64()), ("arrived", pa.bool_()), ("bits", pa.binary()), ("periods", pa.binary())])


def _pack(raw: np.ndarray) -> bytes:
    return pa.compress(raw.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, n_bytes: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n_bytes, "zstd", asbytes=True), kind)


def _pieces(field: np.ndarray, names: list[str], arrived: np.ndarray, key: np.ndarray, t: np.ndarray) -> pa.RecordBatch:
    """A bitmap, and the first periods of its bits in the order of their keys, for each field, range, day and kind."""
    day = t // DAY_US
    period = ((t - day * DAY_US) // PERIOD_US).astype(np.uint32)
    place = key // BITS
    order = np.lexsort((period, key, arrived, day, place, field))
    field, arrived, key, day, period, place = (x[order] for x in (field, arrived, key, day, period, place))
    new = lambda *xs: np.r_[True, np.any([x[1:] != x[:-1] for x in xs], axis=0)]
    first = new(field, place, day, arrived, key)
    field, arrived, key, day, period, place = (x[first] for x in (field, arrived, key, day, period, place))
    begins = np.flatnonzero(new(field, place, day, arrived))
    bits, periods = [], []
    for a, b in zip(begins, [*begins[1:], len(key)], strict=True):
        flags = np.zeros(BITS, bool)
        flags[key[a:b] - place[a] * BITS] = True
        bits.append(_pack(np.packbits(flags, bitorder="little")))
        periods.append(_pack(period[a:b]))
    columns = [[names[k] for k in field[begins]], place[begins], day[begins], arrived[begins], bits, periods]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECES, strict=True)], schema=_PIECES)


def bitmaps(events: DataFrame) -> DataFrame:
    """Compressed bitmaps of events(ref_field, key_id, t, arrived): each task gives one for each field, range of keys, day and kind that it
    met, so that what is shuffled are bits, not rows. An unknown time is on a day behind all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        kept: list[tuple] = []

        def flush() -> pa.RecordBatch:
            field, arrived, key, t = (np.concatenate(x) for x in zip(*kept, strict=True))
            kept.clear()
            return _pieces(field, list(names), arrived, key, t)

        n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = column(batch, "ref_field").dictionary_encode()
            codes = np.array([names.setdefault(x, len(names)) for x in coded.dictionary.to_pylist()])[np.asarray(coded.indices)]
            kept.append((codes, np.asarray(column(batch, "arrived")), ints(column(batch, "key_id")), ints(column(batch, "t"))))
            n += batch.num_rows
            if n >= BUFFERED:
                yield flush()
                n = 0
        if kept:
            yield flush()

    return events.select("ref_field", "key_id", "t", "arrived").mapInArrow(run, PIECES)


class _Range:
    """The days of one range of keys, gone through in order: which keys stand since an earlier day."""

    def __init__(self):
        self.standing = np.zeros(BITS // 8, np.uint8)
        self.day, self.referred, self.arrived = None, None, None

    def begin(self, day: int) -> None:
        self.day, self.referred, self.arrived = day, (np.zeros(BITS // 8, np.uint8), np.full(BITS, NEVER, np.uint32)), (np.zeros(BITS // 8, np.uint8), np.full(BITS, NEVER, np.uint32))

    def add(self, arrived: bool, bits: bytes, periods: bytes) -> None:
        found, first = self.arrived if arrived else self.referred
        more = _unpack(bits, BITS // 8, np.uint8)
        keys = np.flatnonzero(np.unpackbits(more, bitorder="little"))
        found |= more
        first[keys] = np.minimum(first[keys], _unpack(periods, 4 * len(keys), np.uint32))

    def survivors(self) -> np.ndarray:
        """Keys referred to on this day AND NOT in place since an earlier day, or since an earlier period of this one."""
        left = self.referred[0] & ~self.standing
        keys = np.flatnonzero(np.unpackbits(left, bitorder="little"))
        keys = keys[self.referred[1][keys] <= self.arrived[1][keys]]
        self.standing |= self.arrived[0]
        return keys


def _and_not(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps in the order of field, range and day to ref_field, key_id and day of the surviving bits."""
    at, now, out = None, _Range(), []

    def close() -> None:
        if at is not None and now.day is not None:
            keys = now.survivors()
            out.append((np.repeat(at[0], len(keys)), keys + at[1] * BITS, np.full(len(keys), now.day)))

    def given() -> pa.RecordBatch:
        fields, keys, days = (np.concatenate(x) for x in zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(fields.astype(object), pa.string()), pa.array(keys.astype(np.int64)), pa.array(days.astype(np.int64))], names=["ref_field", "key_id", "day"])

    for batch in batches:
        rows = zip(*(column(batch, f.name).to_pylist() for f in _PIECES), strict=True)
        for field, place, day, arrived, bits, periods in rows:
            if (field, place) != at or day != now.day:
                close()
                if (field, place) != at:
                    at, now = (field, place), _Range()
                now.begin(day)
            now.add(arrived, bits, periods)
        if out:
            yield given()
    close()
    if out:
        yield given()


def surviving_bits(references: DataFrame, targets: DataFrame) -> DataFrame:
    """ref_field, key_id and day of references that may dangle: no target that is never deleted came in an earlier period."""
    lasting = targets.filter(F.col("until") == FOREVER).select("ref_field", "key_id", "t", F.lit(True).alias("arrived"))
    both = references.select("ref_field", "key_id", "t", F.lit(False).alias("arrived")).unionByName(lasting)
    pieces = repartitioned(bitmaps(both), "ref_field", "key_range").sortWithinPartitions("ref_field", "key_range", "day")
    return pieces.mapInArrow(_and_not, "ref_field string, key_id long, day long")


class _Dangling(Scan):
    """State: key, furthest end of life of its targets so far. Gives out references that dangle."""

    schema = "ref_field string, key_id long, row_id long"
    key = ["ref_field", "key_id"]

    def step(self, state, batch):
        first = starts(batch, self.key, state and state[0])
        t, kind, until = (ints(column(batch, c)) for c in ("t", "kind", "until"))
        lives = np.where(kind == TARGET, until, -FOREVER)
        lead = 0 if first[0] else 1
        if lead:
            first, lives = np.r_[True, first], np.r_[state[1], lives]
        lives = running_max(lives, first)
        # a target that is never deleted lives at the end of time too
        dangling = (kind == REFERENCE) & (lives[lead:] <= t) & (lives[lead:] != FOREVER)
        rows = pa.array(np.flatnonzero(dangling))
        out = pa.RecordBatch.from_arrays([column(batch, "ref_field").take(rows).cast(pa.string()), column(batch, "key_id").take(rows), column(batch, "row_id").take(rows)], names=["ref_field", "key_id", "row_id"])
        return (key_of(batch, self.key, batch.num_rows - 1), int(lives[-1])), out

    def merge(self, carry, local):
        return local if carry[0] != local[0] else (local[0], max(carry[1], local[1]))


def surviving(references: DataFrame, targets: DataFrame, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References to surviving keys on their days, and targets of surviving keys. The few bits of a small referenced table are broadcast,
    so that the many references to one of its keys stay where they are."""
    dated = references.select("*", _day("t").alias("day"))
    kept, lived = [], []
    for of in (F.col("ref_field") == "run_info", F.col("ref_field") != "run_info"):
        kept.append(dated.filter(of).join(broadcast_if_small(bits.filter(of)), ["ref_field", "key_id", "day"], "left_semi").drop("day"))
        lived.append(targets.filter(of).join(broadcast_if_small(bits.filter(of).select("ref_field", "key_id").distinct()), ["ref_field", "key_id"], "left_semi"))
    return kept[0].unionByName(kept[1]), lived[0].unionByName(lived[1])


def _day(t: str) -> Column:
    return F.expr(f"({t} - pmod({t}, {DAY_US})) div {DAY_US}")


def dangling(references: DataFrame, targets: DataFrame) -> DataFrame:
    """ref_field, key_id and row_id of references whose target had no live row at the time of the reference."""
    references, targets = surviving(references, targets, checkpoint(surviving_bits(references, targets)))
    return ordered_scan(targets.unionByName(references), ["ref_field", "key_id", "t", "kind", "row_id", "until"], _Dangling())


class Events:
    """References of reads and their targets, with keys as integers; ids: the dictionary of acquisitions."""

    def __init__(self, reads: DataFrame, signal: DataFrame, run_info: DataFrame):
        runs = reads.select(F.lit("run_info").alias("ref_field"), acquisition_key("run_info").alias("value"), "row_id", "received_at").filter("value IS NOT NULL")
        chunks = reads.select(F.lit("signal").alias("ref_field"), F.explode(F.array_distinct("signal")).alias("key_id"), "row_id", "received_at").filter("key_id IS NOT NULL")
        parents = run_info.select(acquisition_key("acquisition_id").alias("value"), "received_at", "deleted_at").filter("value IS NOT NULL")
        self.ids = broadcast_if_small(checkpoint(dictionary(runs.select("value").union(parents.select("value")))))
        runs = runs.join(self.ids, "value").select("ref_field", "key_id", "row_id", "received_at")
        parents = parents.join(self.ids, "value").select(F.lit("run_info").alias("ref_field"), "key_id", "received_at", "deleted_at")
        stored = signal.filter("row_no IS NOT NULL").select(F.lit("signal").alias("ref_field"), F.col("row_no").cast("long").alias("key_id"), "received_at", "deleted_at")
        self.references = reference_events(runs.unionByName(chunks))
        self.targets = target_events(parents.unionByName(stored))

    def named(self, found: DataFrame) -> DataFrame:
        """found with ref_key, the key as text, for key_id."""
        rest = [c for c in found.columns if c not in ("ref_field", "key_id")]
        runs = found.filter("ref_field = 'run_info'").join(self.ids, "key_id").select("ref_field", *rest, F.col("value").alias("ref_key"))
        return runs.unionByName(found.filter("ref_field = 'signal'").select("ref_field", *rest, F.col("key_id").cast("string").alias("ref_key")))


def orphan_references(reads: DataFrame, signal: DataFrame, run_info: DataFrame) -> DataFrame:
    """Every reference of reads to an acquisition or a chunk that had no row live at the read row's received_at.

    A row lives from its received_at on until before its deleted_at. Null references, null elements of signal and null
    arrays refer to nothing; a chunk named twice in one row is one reference. Reads of an unknown time are held against
    what is never deleted; rows received at an unknown time never live. Repeated rows are each looked at. Columns not
    named here don't matter, also if they clash."""
    events = Events(reads, signal, run_info)
    return events.named(checkpoint(dangling(events.references, events.targets))).select("ref_field", "row_id", "ref_key")


def doubtful_references(reads: DataFrame, signal: DataFrame, run_info: DataFrame) -> DataFrame:
    """The surviving bits: ref_field, ref_key and day (of the references, null: time unknown) of references that may dangle."""
    events = Events(reads, signal, run_info)
    bits = events.named(checkpoint(surviving_bits(events.references, events.targets)))
    return bits.select("ref_field", "ref_key", F.when(F.col("day") < FOREVER // DAY_US, F.date_from_unix_date(F.col("day").cast("int"))).alias("day"))


def orphans_by_month(orphans: DataFrame, reads: DataFrame) -> DataFrame:
    """Counts of orphan references for each referenced table and month of received_at (null: time unknown)."""
    per_row = orphans.groupBy("row_id", "ref_field").agg(F.count(F.lit(1)).alias("n"))
    day = F.date_from_unix_date(F.expr(f"floor(unix_micros(received_at) / {DAY_US}D)").cast("int"))  # in UTC whatever the session's zone
    months = reads.select("row_id", F.date_format(day, "yyyy-MM").alias("month"))
    joined = per_row.join(months, "row_id")
    name = F.when(F.col("ref_field") == "run_info", "run_info").otherwise("signal_rows").alias("ref_table")
    return joined.groupBy(name, "month").agg(F.sum("n").cast("long").alias("n_orphans"))
