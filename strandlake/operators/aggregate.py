"""Sums and summaries of reads and their signal chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import acquisition_key


def stored_bytes(signal: str = "signal", dtype: str = "array<smallint>") -> Column:
    """Bytes of a stored chunk: of packed signal its length, of plain signal two for each sample."""
    return (F.length(signal) if dtype == "binary" else F.when(F.col(signal).isNotNull(), 2 * F.size(signal))).cast("long")


def per_read(signal: DataFrame, key: str = "read_id") -> DataFrame:
    """Chunks, samples, bytes and compression ratio (null for no samples) of each read. Samples aren't decoded."""
    size = stored_bytes("signal", dict(signal.dtypes)["signal"])
    sums = signal.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("samples").alias("sample_count"), F.sum(size).alias("byte_count"))
    return sums.withColumn("compression_ratio", F.try_divide(F.col("byte_count").cast("double"), 2 * F.col("sample_count")))


def signal_sums(signal: DataFrame, key: str = "read_id") -> DataFrame:
    """Sum of all samples of each read; null samples and chunks add nothing."""
    chunk = F.aggregate("signal", F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0).cast("long")))
    return signal.groupBy(key).agg(F.coalesce(F.sum(chunk), F.lit(0)).alias("signal_sum"))


def debug_summary(reads: DataFrame, signal: DataFrame, batch: list[str] | None = None) -> DataFrame:
    """One row: reads, batches, samples, bytes, compression in per cent, first and last sample, run information in use.

    No reads give zeros and nulls."""
    size = stored_bytes("signal", dict(signal.dtypes)["signal"])
    of_reads = reads.agg(
        F.count(F.lit(1)).alias("n_reads"), F.countDistinct(*(batch or [F.lit(1)])).alias("n_batches"), F.coalesce(F.sum("num_samples"), F.lit(0)).alias("n_samples"),
        F.min("start").alias("first_sample"), F.max(F.try_add(F.col("start"), F.col("num_samples"))).alias("last_sample"), F.countDistinct(acquisition_key("run_info")).alias("n_run_infos"),
    )
    of_chunks = signal.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n_bytes"), F.coalesce(F.sum("samples"), F.lit(0)).alias("n_stored"))
    # one row each
    both = of_reads.withColumn("_k", F.lit(1)).join(F.broadcast(of_chunks.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return both.withColumn("percent_compressed", F.try_divide(100 * F.col("n_bytes").cast("double"), 2 * F.col("n_stored"))).drop("n_stored")


def batch_sizes(reads: DataFrame, batch: str = "_batch") -> DataFrame:
    return reads.groupBy(batch).agg(F.count(F.lit(1)).alias("n_reads"))


def distinct_run_infos(reads: DataFrame) -> DataFrame:
    """Bare identifiers of the acquisitions that reads name."""
    return reads.select(acquisition_key("run_info").alias("run_info")).dropna().distinct()


def throughput(samples: int, seconds: float) -> tuple[float, float]:
    """Megabytes of samples, and megabytes a second."""
    size = 2 * samples / 1e6
    return size, size / seconds if seconds else 0.0


def with_unit(number: float) -> str:
    for unit in ("", "K", "M", "G"):
        if abs(number) < 1000:
            return f"{number:.1f} {unit}".strip()
        number /= 1000
    return f"{number:.1f} T"
