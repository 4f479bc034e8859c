"""Reads and their signal chunks: joined by row number, put together in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def chunk_references(reads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, position and row_no of every chunk of every read, in one row each."""
    return reads.select(*keys, F.posexplode("signal").alias("position", "row_no")).filter("row_no IS NOT NULL")


def chunks_of_reads(reads: DataFrame, signal: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """The chunks that reads refer to, with their positions. Chunks that aren't there are left out. Both sides are in the key
    _file where they come from containers, as row numbers count within a file."""
    by = ["_file", "row_no"] if "_file" in keys and "_file" in signal.columns else ["row_no"]
    return chunk_references(reads, keys).join(signal.select(*by, *(columns or ["signal", "samples"])), by)


def reassemble(reads: DataFrame, signal: DataFrame, keys: list[str]) -> DataFrame:
    """keys, signal (all of the read's chunks in order) and whether the signal is complete.

    keys must tell reads apart. A read of no chunks has an empty signal; chunks that are missing or null are left out, and
    complete is then false. Packed signal must be decoded before."""
    parts = chunks_of_reads(reads, signal, keys, ["signal"]).filter("signal IS NOT NULL")
    whole = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "signal"))).alias("parts"))
    whole = whole.select(*keys, F.flatten(F.transform("parts", lambda p: p["signal"])).alias("_whole"), F.size("parts").alias("_found"))
    wanted = reads.select(*keys, F.coalesce(F.size("signal"), F.lit(0)).alias("_wanted"))
    empty = F.array().cast("array<smallint>")
    joined = wanted.join(whole, keys, "left")
    return joined.select(*keys, F.coalesce("_whole", empty).alias("signal"), (F.coalesce("_found", F.lit(0)) == F.greatest("_wanted", F.lit(0))).alias("complete"))


def rechunk(signals: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, position and signal of slices of at most size samples."""
    from ..functions.signal import chunked

    return signals.select(*keys, F.posexplode(chunked("signal", size)).alias("position", "signal"))


def row_info(signal: DataFrame, batch_rows: int) -> DataFrame:
    """row_no, batch, place in the batch, samples and stored bytes of each chunk."""
    from .aggregate import stored_bytes

    size = stored_bytes("signal", dict(signal.dtypes)["signal"])
    row = F.col("row_no")
    return signal.select("row_no", F.floor(row / batch_rows).cast("long").alias("batch"), F.pmod(row, F.lit(batch_rows)).cast("long").alias("batch_row"), "samples", size.alias("n_bytes"))


