"""Continuous periods and gaps of overlapping, nested and broken intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import acquisition_key
from .ordered_scan import Scan, column, ints, key_of, last_index, ordered_scan, running_max, starts

ENTITY = ["acquisition_id", "channel", "well"]


class _Islands(Scan):
    """State: entity, furthest end so far, start of the open period. Gives out gaps and pieces of periods."""

    schema = "acquisition_id string, channel int, well int, kind string, from_sample long, to_sample long, n_rows long"

    def step(self, state, batch):
        first = starts(batch, ENTITY, state and state[0])
        begin, end = ints(column(batch, "start")), ints(column(batch, "stop"))
        if not first[0]:  # the carried state stands in as a row before the others
            first, begin, end = np.r_[True, first], np.r_[state[2], begin], np.r_[state[1], end]
            lead = 1
        else:
            lead = 0
        far = running_max(end, first)
        before = np.r_[end[:1], far[:-1]]
        gap = ~first & (begin > before)
        opens = first | gap
        period = begin[last_index(opens)]
        pieces = np.flatnonzero(np.r_[opens[1:], True])
        heads = np.flatnonzero(opens)
        count = pieces - heads + 1
        count[0] -= lead
        at_gap = np.flatnonzero(gap)
        rows = np.r_[at_gap, pieces] - lead
        keep = rows >= 0
        rows = rows[keep]
        low = np.r_[before[at_gap], period[pieces]][keep]
        high = np.r_[begin[at_gap], far[pieces]][keep]
        n = np.r_[np.zeros(len(at_gap), np.int64), count][keep]
        kind = np.r_[np.repeat("gap", len(at_gap)), np.repeat("period", len(pieces))][keep]
        taken = [column(batch, c).take(pa.array(rows)) for c in ENTITY]
        out = pa.RecordBatch.from_arrays([taken[0].cast(pa.string()), taken[1].cast(pa.int32()), taken[2].cast(pa.int32()), pa.array(kind, pa.string()), pa.array(low), pa.array(high), pa.array(n)], names=[*ENTITY, "kind", "from_sample", "to_sample", "n_rows"])
        return (key_of(batch, ENTITY, batch.num_rows - 1), int(far[-1]), int(period[-1])), out

    def merge(self, carry, local):
        if carry[0] != local[0]:
            return local
        return local[0], max(carry[1], local[1]), carry[2] if local[2] <= carry[1] else local[2]


def covered_ranges(reads: DataFrame) -> DataFrame:
    """The ranges [start, stop) that rows of reads cover, per acquisition, channel and well.

    Rows with a null in any of the five fields, or with no samples (or fewer), cover nothing. An end past the largest
    long is taken as the largest long. Further columns are left aside."""
    stop = F.coalesce(F.try_add(F.col("start"), F.col("num_samples").cast("long")), F.lit(2**63 - 1))
    picked = reads.select(
        acquisition_key("run_info").alias("acquisition_id"), F.col("channel").cast("int").alias("channel"), F.col("well").cast("int").alias("well"),
        F.col("start").cast("long").alias("start"), F.col("num_samples").cast("long").alias("num_samples"), stop.alias("stop"),
    )
    return picked.dropna().filter("num_samples > 0").drop("num_samples")


def islands(ranges: DataFrame) -> DataFrame:
    """Gaps and pieces of continuous periods of ranges(acquisition_id, channel, well, start, stop); ranges that touch
    are continuous. A period that runs through several partitions comes in as many pieces, with the same start.
    No rows give no rows; repeated rows count in n_rows."""
    return ordered_scan(ranges, [*ENTITY, "start", "stop"], _Islands())


def gaps(reads: DataFrame) -> DataFrame:
    """Every maximal range of samples that no row covers, between two covered ranges of the same channel and well."""
    found = islands(covered_ranges(reads)).filter("kind = 'gap'")
    return found.select(*ENTITY, F.col("from_sample").alias("gap_start"), F.col("to_sample").alias("gap_end"))


def periods(reads: DataFrame) -> DataFrame:
    """Continuous periods with the number of rows that cover them."""
    pieces = islands(covered_ranges(reads)).filter("kind = 'period'")
    whole = pieces.groupBy(*ENTITY, F.col("from_sample").alias("period_start"))
    return whole.agg(F.max("to_sample").alias("period_end"), F.sum("n_rows").alias("n_rows"))
