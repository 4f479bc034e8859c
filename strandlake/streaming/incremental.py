"""Reads that keep arriving: append-only containers epoch by epoch, and one copy of each read within a watermark."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.container import write


def deduplicated(stream: DataFrame, keys: list[str], time: str = "received_at", late: str = "1 day") -> DataFrame:
    """The first delivery of each key; state is kept for as long as copies may be late."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def rates(stream: DataFrame, time: str, window: str, late: str, by: list[str]) -> DataFrame:
    """Reads and samples arriving per window of time."""
    windowed = stream.withWatermark(time, late).groupBy(F.window(time, window), *by)
    return windowed.agg(F.count(F.lit(1)).alias("n_reads"), F.sum("num_samples").alias("n_samples"))


def append(stream: DataFrame, path: str, checkpoint: str, prepare: Callable[[DataFrame], DataFrame] | None = None, **options: str) -> StreamingQuery:
    """Writes each micro-batch as containers in a folder of its own below path. An epoch that is run again, after a failure,
    replaces its folder, so none is written twice; what a crash loses is the open epoch."""

    def epoch(batch: DataFrame, number: int) -> None:
        folder = os.path.join(path, f"epoch-{number:08d}")
        shutil.rmtree(folder, ignore_errors=True)
        write(prepare(batch) if prepare else batch, folder, overwrite=True, **options)

    return stream.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
