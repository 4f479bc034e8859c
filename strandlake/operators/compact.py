"""Fewer, well-filled files out of very many tiny ones.

Records are range-sorted by acquisition, read and record (boundaries sampled by Spark), the repeated ones marked by
looking at the record before, and each kept record is given the number of its output file from the bytes that come before it
in its acquisition. The files are written to a staging folder, counted, and swapped in by renaming only if every
record is accounted for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import acquisition_key, read_key
from ..session import checkpoint, exists, remove, rename, work_path
from .ordered_scan import Scan, column, differs, ints, key_of, last_index, ordered_scan, starts

#: Bytes of records aimed at in one output file.
TARGET_BYTES = 128 << 20


class _Place(Scan):
    """State: last acquisition and read, whether the acquisition began in this partition, bytes kept of it so far."""

    schema = "record_id long, acquisition_id string, read_id string, n_bytes long, keep boolean, out_file long"

    def __init__(self, target: int, left_out_only: bool = False):
        self.target, self.left_out_only = target, left_out_only

    def step(self, state, batch):
        n = batch.num_rows
        read = column(batch, "read_id")
        first = starts(batch, ["acquisition_id"], state and (state[0][0],))
        same = np.zeros(n, bool)
        same[1:] = ~differs(read)
        same[0] = state is not None and state[0][1] == read[0].as_py()
        keep = first | ~same | np.asarray(read.is_null())
        size = np.where(keep, np.maximum(ints(column(batch, "n_bytes")), 0), 0)
        total = np.cumsum(size)
        before = total - size
        at = last_index(first)
        base = np.where(at >= 0, before[np.maximum(at, 0)], -(state[1] if state else 0))
        out = pa.RecordBatch.from_arrays(
            [column(batch, "record_id"), column(batch, "acquisition_id").cast(pa.string()), read.cast(pa.string()), column(batch, "n_bytes"), pa.array(keep), pa.array((before - base) // self.target)],
            names=["record_id", "acquisition_id", "read_id", "n_bytes", "keep", "out_file"],
        )
        if self.left_out_only:
            out = out.filter(pa.array(~keep))
        head, own = (key_of(batch, ["acquisition_id", "read_id"], 0), int(size[0])) if state is None else (state[2], state[3])
        return (key_of(batch, ["acquisition_id", "read_id"], n - 1), int(total[-1] - base[-1]), head, own), out

    def merge(self, carry, local):
        last, total, head, own = local
        if last[0] != carry[0][0]:
            return last, total, None, 0
        # the whole partition is of the carried acquisition; its first record may repeat the last one before it
        again = own if head == carry[0] and head[1] is not None else 0
        return last, carry[1] + total - again, None, 0


def placed_records(records: DataFrame, target_bytes: int = TARGET_BYTES, left_out_only: bool = False) -> DataFrame:
    """Each record (or only those left out) with keep and out_file, its output file within the acquisition.

    The record with the smallest record_id of an acquisition's read is kept; records without read_id are all kept, a null
    acquisition is one acquisition. Unknown sizes count as 0 bytes. Columns not named here are left aside."""
    keyed = records.select(acquisition_key("acquisition_id").alias("acquisition_id"), read_key("read_id").alias("read_id"), F.col("record_id").cast("long").alias("record_id"), F.col("n_bytes").cast("long").alias("n_bytes"))
    return ordered_scan(keyed, ["acquisition_id", "read_id", "record_id"], _Place(target_bytes, left_out_only))


def left_out(records: DataFrame) -> DataFrame:
    return placed_records(records, left_out_only=True).select("record_id")


class LostRecords(RuntimeError):
    """The written files don't hold exactly the records that they should."""


def compact(spark: SparkSession, records: DataFrame, target: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Writes the kept records, with all their columns, to target as one sorted file per acquisition and out_file.

    Columns of the records named keep or out_file are written as keep_in and out_file_in. record_id must be unique.

    What stood at target is replaced only after the counts agree: records in = kept + left out, and the written rows are
    the kept ones, by acquisition and file. Returns the manifest: acquisition_id, out_file, n_records, n_bytes."""
    plan = checkpoint(placed_records(records, target_bytes))
    kept = plan.filter("keep")
    n_in, n_plan = records.count(), plan.count()
    columns = [c for c in records.columns if c not in ("acquisition_id", "read_id", "n_bytes", "record_id")]
    rest = records.select(F.col("record_id").cast("long").alias("record_id"), *[F.col(c).alias(f"{c}_in" if c in plan.columns else c) for c in columns])
    full = kept.drop("keep").join(rest, "record_id")
    staging = work_path(spark, "compact-staging")
    by = ["acquisition_id", "out_file"]
    full.repartitionByRange(*by).sortWithinPartitions(*by, "read_id", "record_id").write.partitionBy(*by).parquet(staging)
    written = spark.read.schema(full.select(*[c for c in full.columns if c not in by], *by).schema).parquet(staging)
    manifest = checkpoint(kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.coalesce("n_bytes", F.lit(0))).alias("n_bytes")))
    there = written.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    wrong = manifest.join(there, (manifest.acquisition_id.eqNullSafe(there.acquisition_id)) & (manifest.out_file == there.out_file), "full").filter("NOT (n <=> n_records)")
    differing = wrong.limit(5).collect()
    if n_in != n_plan or differing:
        remove(spark, staging)
        raise LostRecords(f"{n_in} records were read and {n_plan} placed; files that differ: {differing}")
    old = target + ".old"
    remove(spark, old)
    if exists(spark, target) and not rename(spark, target, old):
        raise LostRecords(f"{target} can't be set aside")
    if not rename(spark, staging, target):
        rename(spark, old, target)
        raise LostRecords(f"{target} can't be put in place")
    remove(spark, old)
    return manifest
