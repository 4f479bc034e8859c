"""Older reads tables brought to the newest columns, step by step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import READS_V4

#: Writers before these versions wrote tables of v0, v1, v2, v3.
STEPS = [((0, 0, 24), 0), ((0, 0, 32), 1), ((0, 0, 38), 2), ((0, 3, 30), 3)]


def table_version(writer: tuple[int, int, int]) -> int:
    return next((v for before, v in STEPS if writer < before), 4)


def _nan():
    return F.lit(float("nan")).cast("float")


def v0_to_v1(reads: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("long")
    return reads.withColumns({
        "num_minknow_events": zero, "tracked_scaling_scale": _nan(), "tracked_scaling_shift": _nan(), "predicted_scaling_scale": _nan(),
        "predicted_scaling_shift": _nan(), "num_reads_since_mux_change": zero, "time_since_mux_change": F.lit(0.0).cast("float"),
    })


class MissingChunk(ValueError):
    """A read refers to a chunk that the signal table doesn't have."""


def v1_to_v2(reads: DataFrame, signal: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """num_samples: the samples of the chunks that a read refers to (0 for none). keys must tell reads apart.

    A reference beyond the signal table raises MissingChunk, or, if not strict, counts nothing."""
    refs = reads.select(*keys, F.explode("signal").alias("row_no"))
    sized = refs.join(signal.select("row_no", "samples"), "row_no", "left")
    if strict and not sized.filter("samples IS NULL").isEmpty():
        raise MissingChunk("reads refer to chunks that aren't there")
    sums = sized.groupBy(*keys).agg(F.coalesce(F.sum("samples"), F.lit(0)).cast("long").alias("num_samples"))
    return reads.join(sums, keys, "left").withColumn("num_samples", F.coalesce("num_samples", F.lit(0).cast("long")))


def v2_to_v3(reads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structs calibration, pore, end_reason and run_info laid flat; run information becomes a table of its own."""
    info = reads.select("run_info.*").distinct() if "map" not in dict(reads.dtypes)["run_info"] else reads.select("run_info.*").dropDuplicates(["acquisition_id"])
    flat = reads.withColumns({
        "calibration_offset": F.col("calibration.offset"), "calibration_scale": F.col("calibration.scale"), "channel": F.col("pore.channel").cast("int"),
        "well": F.col("pore.well").cast("short"), "pore_type": F.col("pore.pore_type"), "end_reason_forced": F.col("end_reason.forced"),
        "end_reason": F.col("end_reason.name"), "run_info": F.col("run_info.acquisition_id"),
    })
    return flat.drop("calibration", "pore"), info


def v3_to_v4(reads: DataFrame) -> DataFrame:
    return reads.withColumn("open_pore_level", _nan())


def migrate(reads: DataFrame, version: int, signal: DataFrame | None = None, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Reads in the newest columns, and run information if it was inside them."""
    info = None
    if version < 1:
        reads = v0_to_v1(reads)
    if version < 2:
        reads = v1_to_v2(reads, signal, keys or ["read_id"])
    if version < 3:
        reads, info = v2_to_v3(reads)
    if version < 4:
        reads = v3_to_v4(reads)
    extra = [c for c in reads.columns if c not in READS_V4]
    return reads.select(*READS_V4, *extra), info


