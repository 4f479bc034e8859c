"""Implausible readings: spikes, stuck stretches and impossible values, each judged by its own source.

Phase-space thresholding: a reading is the point of its value, first and second difference; it is a spike if it lies outside an
ellipse in any of the three planes. All three axes come from robust spreads of the source (an acquisition), and are found
anew from the points inside until they no longer change.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import acquisition_key
from ..session import broadcast_if_small, checkpoint
from .ordered_scan import Scan, column, differs, key_of, last_index, ordered_scan, starts

#: Samples: axes of the value and its differences over the 99th percentile of their size among the points inside. Ordinary samples are
#: bounded, so that their differences reach twice and four times the bound, but seldom do: their axes are wider multiples.
CLEAR = (1.75, 2.7, 3.8)
#: The value's first axis in median deviations, and the shortest axis.
FIRST_ROUND, SHORTEST = 3.6, 2.5
#: A difference of one count is none within the resolution of a sample; a stretch without differences is too long beyond both of these.
FLAT_STEP, FLAT_LEAST, FLAT_RARE = 1, 20, 1.6
#: Readings of a read: the value's axis in robust deviations, whatever the number of readings (those of the differences are as for
#: samples); reads in succession with one value that make it stuck;
#: acquisitions with fewer readings than this borrow the usual spread of all.
READ_CLEAR, STUCK_READS, FEW = 7.5, 4, 12
#: A robust deviation is so many median deviations.
ROBUST = 1.4826
#: Rounds at most. Axes settle in two or three; those that swing between two states are taken as they are then.
ROUNDS = 12


def _quantile(values: np.ndarray, n: np.ndarray, q: float) -> float:
    """Of values in ascending order, each n times."""
    total = np.cumsum(n)
    return float(values[np.searchsorted(total, q * total[-1], side="left").clip(0, len(values) - 1)])


def _flat_series(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All samples of the batch's chunks, for each the row it is of, and where chunks begin."""
    signal = column(batch, "signal")
    size = np.asarray(signal.value_lengths().fill_null(0)).astype(np.int64)
    flat = signal.flatten()
    rows = np.repeat(np.arange(len(size)), size)
    if flat.null_count:
        there = np.asarray(flat.is_valid())
        flat, rows = flat.drop_null(), rows[there]
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.zeros(0, bool)
    return np.asarray(flat).astype(np.int64), rows, first


def _differences(v: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second differences to the samples before, 0 where a chunk has none yet."""
    d1 = np.zeros_like(v)
    d1[1:] = np.where(first[1:], 0, v[1:] - v[:-1])
    d2 = np.zeros_like(v)
    early = first.copy()
    early[1:] |= first[:-1]
    d2[1:] = np.where(early[1:], 0, d1[1:] - d1[:-1])
    return d1, d2


_COUNTS = "acquisition_id string, kind int, value long, n long"
_AXES = "level double, a double, b double, c double, flat_run double"


def _axes_columns(batch: pa.RecordBatch, names: tuple[str, ...]) -> list[np.ndarray]:
    return [np.asarray(column(batch, x).cast(pa.float64()).fill_null(np.nan)) for x in names]


def outside(u: np.ndarray, u1: np.ndarray, u2: np.ndarray) -> np.ndarray:
    """Outside an ellipse in any plane; all three in units of their axes."""
    x, y, z = u * u, u1 * u1, u2 * u2
    return np.maximum(np.maximum(x, y) + z, x + y) > 1


def _points_outside(batch: pa.RecordBatch, v: np.ndarray, d1: np.ndarray, d2: np.ndarray, rows: np.ndarray) -> np.ndarray:
    level, a, b, c = _axes_columns(batch, ("level", "a", "b", "c"))
    return outside((v - level[rows]) / a[rows], d1 / b[rows], d2 / c[rows])


def histograms(chunks: DataFrame, spikes_only: bool = False) -> DataFrame:
    """Counts of sample values (kind 0), and of the sizes of first (1) and second (2) differences, per acquisition; of the points
    outside the ellipses alone if the chunks come with axes and spikes_only is given.

    They are bounded by the 16 bits of a sample, so an acquisition's counts are small however many chunks it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, rows, first = _flat_series(batch)
            if not len(v):
                continue
            codes = column(batch, "acquisition_id").dictionary_encode(null_encoding="encode")
            source = np.asarray(codes.indices)[rows].astype(np.int64)
            d1, d2 = _differences(v, first)
            there = _points_outside(batch, v, d1, d2, rows) if spikes_only else np.ones(len(v), bool)
            inner = ~first
            twice = inner.copy()
            twice[1:] &= inner[:-1]
            for kind, values, of in ((0, v + 32768, there), (1, np.abs(d1), there & inner), (2, np.abs(d2), there & twice)):
                keys, n = np.unique((source[of] << 18) | values[of], return_counts=True)
                names = codes.dictionary.take(pa.array(keys >> 18)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.array(np.full(len(keys), kind, np.int32)), pa.array((keys & 0x3FFFF) - (32768 if kind == 0 else 0)), pa.array(n)], names=["acquisition_id", "kind", "value", "n"])

    found = chunks.select("acquisition_id", "signal", *(["level", "a", "b", "c"] if spikes_only else [])).mapInArrow(run, _COUNTS)
    return found.groupBy("acquisition_id", "kind", "value").agg(F.sum("n").alias("n"))


def _packed(table: pa.Table) -> pa.Table:
    """One row of an acquisition's counts: packed, the arrays of kind, value and n behind each other."""
    arrays = [np.asarray(table[c]).astype(np.int64) for c in ("kind", "value", "n")]
    order = np.lexsort((arrays[1], arrays[0]))
    raw = np.concatenate([x[order] for x in arrays]).tobytes()
    return pa.table({"acquisition_id": table["acquisition_id"][:1], "cells": pa.array([len(order)], pa.int64()), "packed": pa.array([pa.compress(raw, "zstd", asbytes=True)], pa.binary())})


def _unpacked(cells: int | None, packed: bytes | None) -> np.ndarray:
    if not cells:
        return np.zeros((3, 0), np.int64)
    return np.frombuffer(pa.decompress(packed, 24 * cells, "zstd", asbytes=True), np.int64).reshape(3, -1)


def axes_of(counts: np.ndarray, first: bool) -> tuple[float, ...]:
    """Level, the axes of value, first and second difference, and the length from which a flat stretch is too long, from
    rows of kind, value (ascending) and n. The first axis of the value comes from the median deviation, which spikes don't move."""
    kind, value, n = counts
    v, m = value[kind == 0].astype(float), n[kind == 0]
    level = _quantile(v, m, 0.5)

    def size(x: np.ndarray, w: np.ndarray, q: float) -> float:
        order = np.argsort(x, kind="stable")
        return _quantile(x[order], w[order], q)

    a = FIRST_ROUND * size(np.abs(v - level), m, 0.5) if first else CLEAR[0] * size(np.abs(v - level), m, 0.99)
    steps = [CLEAR[k] * _quantile(value[of].astype(float), n[of], 0.99) if (of := kind == k).any() else 0.0 for k in (1, 2)]
    of = kind == 1
    total = n[of].sum()
    share = (n[of & (value <= FLAT_STEP)].sum() + 1) / (total + 2) if total else 0.5
    longest = max(FLAT_LEAST, FLAT_RARE * math.log(total + 2) / -math.log(min(share, 0.9)))
    return level, *(max(x, SHORTEST) for x in (a, *steps)), float(longest)


def _left(every: np.ndarray, spikes: np.ndarray) -> np.ndarray:
    """The counts without those of the points outside."""
    if not spikes.shape[1]:
        return every
    place = lambda x: (x[0] << 20) + x[1] + 32768
    n = every[2].copy()
    n[np.searchsorted(place(every), place(spikes))] -= spikes[2]
    return np.vstack([every[:2], n])[:, n > 0]


def _renewed(first: bool):
    """Rows of acquisitions with their counts (and those of their spikes) to rows with their axes, and whether these changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [column(batch, c).to_pylist() for c in ("cells", "packed", *(() if first else ("spike_cells", "spikes", "level", "a", "b", "c")))]
            axes, changed = [], []
            for cells, packed, *more in zip(*given, strict=True):
                counts = _unpacked(cells, packed)
                left = counts if first else _left(counts, _unpacked(*more[:2]))
                # where no point is inside, the axes stay as they were
                axes.append(axes_of(left, first) if (left[0] == 0).any() else axes_of(counts, True))
                changed.append(first or list(axes[-1][:4]) != list(more[2:]))
            columns = [pa.array([x[k] for x in axes], pa.float64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([column(batch, "acquisition_id"), column(batch, "cells"), column(batch, "packed"), *columns, pa.array(changed)], names=["acquisition_id", "cells", "packed", "level", "a", "b", "c", "flat_run", "changed"])

    return run


def _with_axes(chunks: DataFrame, axes: DataFrame) -> DataFrame:
    return chunks.join(broadcast_if_small(axes.withColumnRenamed("acquisition_id", "source")), F.col("acquisition_id").eqNullSafe(F.col("source"))).drop("source")


def signal_axes(chunks: DataFrame) -> DataFrame:
    """One row per acquisition: level, the three axes, and the length from which a flat stretch is too long.

    Samples are counted once. Each round then counts the points outside the ellipses, takes them off, and finds level and axes anew, for
    the acquisitions whose axes changed in the round before."""
    schema = f"acquisition_id string, cells long, packed binary, {_AXES}, changed boolean"
    packing = "acquisition_id string, cells long, packed binary"
    axes = checkpoint(histograms(chunks).groupBy("acquisition_id").applyInArrow(_packed, packing).mapInArrow(_renewed(True), schema))
    for _ in range(ROUNDS):
        open_ = axes.filter("changed")
        if open_.isEmpty():
            break
        # a source of few counts by itself, however many chunks it has
        judged = _with_axes(chunks, open_.select("acquisition_id", "level", "a", "b", "c"))
        spikes = histograms(judged, spikes_only=True).groupBy("acquisition_id").applyInArrow(_packed, packing)
        spikes = checkpoint(spikes.select(F.col("acquisition_id").alias("source"), F.col("cells").alias("spike_cells"), F.col("packed").alias("spikes")))
        joined = open_.join(broadcast_if_small(spikes, 20_000), F.col("acquisition_id").eqNullSafe(F.col("source")), "left").drop("source", "changed", "flat_run")
        axes = checkpoint(axes.filter("NOT changed").unionByName(joined.mapInArrow(_renewed(False), schema)))
    return axes.drop("cells", "packed", "changed")


def possible_limits(run_info: DataFrame) -> DataFrame:
    """The widest of an acquisition's possible limits (adc_max above adc_min)."""
    rows = run_info.filter("adc_max > adc_min").select(acquisition_key("acquisition_id").alias("acquisition_id"), F.col("adc_max").cast("int").alias("high"), F.col("adc_min").cast("int").alias("low"))
    return rows.filter("acquisition_id IS NOT NULL").groupBy("acquisition_id").agg(F.max("high").alias("high"), F.min("low").alias("low"))


def judge_chunks(batch: pa.RecordBatch) -> np.ndarray:
    """For each chunk bits: 1 spike, 2 beyond the limits, 4 too flat for too long."""
    v, rows, first = _flat_series(batch)
    out = np.zeros(batch.num_rows, np.int32)
    if not len(v):
        return out
    d1, d2 = _differences(v, first)
    np.bitwise_or.at(out, rows[_points_outside(batch, v, d1, d2, rows)], 1)
    flat_run, high, low = _axes_columns(batch, ("flat_run", "high", "low"))
    with np.errstate(invalid="ignore"):
        np.bitwise_or.at(out, rows[(v > high[rows]) | (v < low[rows])], 2)
    still = ~first & (np.abs(d1) <= FLAT_STEP)
    place = np.arange(len(v))
    run = place - last_index(~still) + 1
    np.bitwise_or.at(out, rows[run >= flat_run[rows]], 4)
    return out


def odd_chunks(signal: DataFrame, run_info: DataFrame) -> DataFrame:
    """row_no and faults of chunks with samples that can't be right. Chunks without samples have none to be wrong; chunks of
    a null acquisition are one source of their own, without limits. Differences are those within a chunk."""
    chunks = signal.select(F.col("row_no").cast("long").alias("row_no"), acquisition_key("acquisition_id").alias("acquisition_id"), "signal").filter("signal IS NOT NULL")
    joined = _with_axes(chunks, checkpoint(signal_axes(chunks).join(possible_limits(run_info), "acquisition_id", "left")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            faults = judge_chunks(batch)
            at = np.flatnonzero(faults)
            yield pa.RecordBatch.from_arrays([column(batch, "row_no").take(pa.array(at)), pa.array(faults[at], pa.int32())], names=["row_no", "faults"])

    return joined.mapInArrow(run, "row_no long, faults int")


class _Readings(Scan):
    """Readings with those before them on their channel and well. State: entity and read of the last row, its value and the one before
    (null: none), the row its run of equal values began with, whether it has a place."""

    schema = "row_id long, source string, read_id binary, value double, before double, before2 double, run_id long, fresh boolean"
    entity = ["source", "channel", "well"]

    def step(self, state, batch):
        n = batch.num_rows
        first = starts(batch, self.entity, state and state[0])
        value = np.asarray(column(batch, "value"))
        b1, b2 = (np.nan, np.nan) if first[0] else (state[2], state[3])
        p1 = np.where(first, np.nan, np.r_[b1, value[:-1]])
        second = first.copy()
        second[1:] |= first[:-1]
        p2 = np.where(second, np.nan, np.r_[b2, b1, value[:-2]][:n])
        if not first[0]:
            p2[0] = b2
        placed = np.asarray(column(batch, "start").is_valid()) & np.asarray(column(batch, "channel").is_valid()) & np.asarray(column(batch, "well").is_valid())
        read = column(batch, "read_id")
        same = np.zeros(n, bool)
        same[1:] = (value[1:] == value[:-1]) & placed[1:] & placed[:-1]
        same[0] = state is not None and state[4] == value[0] and state[6] and bool(placed[0])
        same &= ~first
        row = np.asarray(column(batch, "row_id"))
        at = last_index(~same)
        run = np.where(at >= 0, row[np.maximum(at, 0)], state[5] if state else 0)
        new_read = np.ones(n, bool)
        new_read[1:] = differs(read)
        new_read[0] = state is None or state[1] != read[0].as_py()
        fresh = ~same | new_read
        # a run is of equal values; where the rows of a batch end it may go on
        maybe = placed & (same | np.r_[same[1:], True])
        out = pa.RecordBatch.from_arrays(
            [column(batch, "row_id"), column(batch, "source").cast(pa.string()), read.cast(pa.binary()), column(batch, "value"), pa.array(p1, mask=np.isnan(p1)), pa.array(p2, mask=np.isnan(p2)), pa.array(run, mask=~maybe), pa.array(fresh)],
            names=["row_id", "source", "read_id", "value", "before", "before2", "run_id", "fresh"],
        )
        last = (key_of(batch, self.entity, n - 1), read[n - 1].as_py(), float(value[-1]), float(p1[-1]), float(value[-1]), int(run[-1]), bool(placed[-1]))
        head = (key_of(batch, self.entity, 0), float(value[0]), bool(placed[0]), n == 1) if state is None else (*state[7][:3], False)
        return (*last, head, (state[8] if state is not None else True) and not (~same[1:]).any() and (state is None or bool(same[0]))), out

    def merge(self, carry, local):
        """A partition that is one run of the carried value keeps the run's beginning; the only row of one has the carried row before it."""
        head = local[7]
        goes_on = head[0] == carry[0]
        if goes_on and head[3]:
            local = (*local[:3], carry[2], *local[4:])
        if local[8] and goes_on and head[1] == carry[4] and head[2] and carry[6]:
            return (*local[:5], carry[5], *local[6:])
        return local


def _coordinates(points: DataFrame, axes: DataFrame) -> DataFrame:
    """points with u, u1 and u2, the coordinates in units of their source's axes, and inside: no ellipse is left."""
    joined = points.join(broadcast_if_small(axes), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    scaled = joined.withColumn("u", (F.col("value") - F.col("level")) / F.col("a"))
    scaled = scaled.withColumn("u1", F.coalesce(F.col("d1") / F.col("b"), F.lit(0.0))).withColumn("u2", F.coalesce(F.col("d2") / F.col("c"), F.lit(0.0)))
    return scaled.withColumn("inside", ~_outside("u", "u1", "u2"))


def _outside(u: str, u1: str | Column, u2: str | Column) -> Column:
    x, y, z = (F.pow(c, 2) for c in (F.col(u), F.col(u1) if isinstance(u1, str) else u1, F.col(u2) if isinstance(u2, str) else u2))
    return F.greatest(x + y, x + z, y + z) > 1


def reading_axes(points: DataFrame) -> DataFrame:
    """s (the source), level, and a, b and c, the axes of value, first and second difference, of points(source, value, before, before2,
    d1, d2), found anew from the points inside, and from differences between values inside, until none changes. Sources with few
    readings take at least the usual spreads of all."""
    middle = lambda c, q=0.5: F.percentile_approx(c, q, 10000)
    axes, kept, before = None, points, None
    for _ in range(ROUNDS):
        levels = checkpoint(kept.groupBy("source").agg(middle("value").alias("level"), middle(F.abs("d1"), 0.99).alias("s1"), middle(F.abs("d2"), 0.99).alias("s2"), F.count(F.lit(1)).alias("n")))
        off = kept.join(broadcast_if_small(levels.select(F.col("source").alias("s"), F.col("level").alias("at"))), F.col("source").eqNullSafe(F.col("s")))
        spread = off.groupBy("s").agg(middle(F.abs(F.col("value") - F.col("at"))).alias("s0"))
        found = checkpoint(levels.join(spread, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
        names = ("s0", "s1", "s2")
        usual = found.filter(F.col("n") >= FEW).agg(*[middle(c).alias(c) for c in names]).first()
        wide = [F.when(F.col("n") < FEW, F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(usual[c] or 0.0))).otherwise(F.coalesce(c, F.lit(0.0))) for c in names]
        times = (READ_CLEAR * ROBUST, CLEAR[1], CLEAR[2])
        axes = checkpoint(found.select(F.col("source").alias("s"), "level", *[F.greatest(w * t, F.lit(1e-6)).alias(c) for w, t, c in zip(wide, times, "abc", strict=True)]))
        now = tuple(axes.agg(F.count(F.lit(1)), *[F.sum(c) for c in ("level", "a", "b", "c")]).first())
        if now == before:
            break
        near = lambda c: F.abs(F.col(c) - F.col("level")) <= F.col("a")
        inner = _coordinates(points, axes).filter("inside")
        before, kept = now, inner.withColumn("d1", F.when(near("before"), F.col("d1"))).withColumn("d2", F.when(near("before") & near("before2"), F.col("d2"))).select(*points.columns)
    return axes


def odd_readings(reads: DataFrame) -> DataFrame:
    """row_id of rows whose median_before is a spike, or the same over several reads in succession on a channel and well.

    As differences are large on both sides of a spike, they count against a reading only if it is the most off-level one of
    those that they are made of. Null and NaN are no readings. Rows with an unknown start, channel or well are in no succession, but a
    repeated delivery with the value of a stuck read counts as stuck. Rows of a null acquisition are one source of their own."""
    readings = reads.select(
        F.col("row_id").cast("long").alias("row_id"), acquisition_key("run_info").alias("source"), F.col("channel").cast("int").alias("channel"), F.col("well").cast("int").alias("well"),
        F.col("start").cast("long").alias("start"), F.col("read_id").cast("binary").alias("read_id"), F.col("median_before").cast("double").alias("value"),
    ).filter("value IS NOT NULL AND NOT isnan(value)")
    found = checkpoint(ordered_scan(readings, ["source", "channel", "well", "start", "read_id", "row_id"], _Readings()))
    points = found.select("row_id", "source", "value", "before", "before2", (F.col("value") - F.col("before")).alias("d1"), (F.col("value") - 2 * F.col("before") + F.col("before2")).alias("d2"))
    placed = _coordinates(points, reading_axes(points.drop("row_id")))
    off = F.abs(F.col("value") - F.col("level"))
    most = (off >= F.coalesce(F.abs(F.col("before") - F.col("level")), F.lit(0.0))) & (off >= F.coalesce(F.abs(F.col("before2") - F.col("level")), F.lit(0.0)))
    counted = lambda c: F.when(most, F.col(c)).otherwise(0.0)
    spikes = placed.filter(_outside("u", counted("u1"), counted("u2"))).select("row_id")
    runs = found.filter("run_id IS NOT NULL").groupBy("run_id").agg(F.sum(F.col("fresh").cast("long")).alias("n_reads")).filter(F.col("n_reads") >= STUCK_READS)
    stuck = checkpoint(found.join(runs.select("run_id"), "run_id").select("row_id", "source", "read_id", "value"))
    same = stuck.select(F.col("source").alias("s"), F.col("read_id").alias("r"), F.col("value").alias("v")).distinct()
    copies = readings.join(broadcast_if_small(same), F.col("source").eqNullSafe(F.col("s")) & F.col("read_id").eqNullSafe(F.col("r")) & (F.col("value") == F.col("v")), "left_semi")
    return spikes.union(copies.select("row_id")).distinct()


def implausible(signal: DataFrame, reads: DataFrame, run_info: DataFrame) -> DataFrame:
    """field_name and row_key of every chunk, read row and run_info row with a reading that can't be right."""
    chunks = odd_chunks(signal, run_info).select(F.lit("signal").alias("field_name"), F.col("row_no").alias("row_key"))
    values = odd_readings(reads).select(F.lit("median_before").alias("field_name"), F.col("row_id").alias("row_key"))
    limits = run_info.filter("adc_max <= adc_min").select(F.lit("adc").alias("field_name"), F.col("info_id").cast("long").alias("row_key"))
    return chunks.union(values).union(limits)
