"""Choosing reads by id or place, with the multiplicity of a bag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid_bin
from ..session import checkpoint, partitions_for


class MissingReads(ValueError):
    """Ids that were asked for and aren't there, or aren't ids."""


def pack_ids(texts: DataFrame, invalid_ok: bool = True) -> DataFrame:
    """read_id (16 bytes) of the texts in the first column; repeated ones stay. Texts that are no id are left out, or raise."""
    packed = texts.select(uuid_bin(texts.columns[0]).alias("read_id"))
    if not invalid_ok and (n := packed.filter("read_id IS NULL").count()):
        raise MissingReads(f"{n} texts are no read id")
    return packed.dropna()


def selection_counts(selection: DataFrame) -> DataFrame:
    """Each distinct id of the first column and how often it is asked for; nulls ask for nothing."""
    key = selection.columns[0]
    return selection.select(F.col(key).alias("_id")).dropna().groupBy("_id").agg(F.count(F.lit(1)).cast("int").alias("_times"))


def missing(reads: DataFrame, selection: DataFrame, key: str = "read_id") -> DataFrame:
    """Distinct ids of the selection that no row has."""
    wanted = selection.select(F.col(selection.columns[0]).alias(key)).dropna().distinct()
    return wanted.join(reads.select(key).distinct(), key, "left_anti")


def select_reads(reads: DataFrame, selection: DataFrame, key: str = "read_id", file: list[str] | None = None, order: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Rows for a bag of ids: an id asked for k times gives its row k times.

    Where rows of one file share an id, only the first in the order (of the file) is hit, so with k files it comes k times.
    Null ids are in no row and no selection. strict raises MissingReads if an id is nowhere. Columns whose names clash with the
    selection's don't matter. The rows come in no order: see storage_order."""
    side = selection_counts(selection)
    if strict:
        side = checkpoint(side)
        if n := missing(reads, side, key).count():
            raise MissingReads(f"{n} requested reads were not found")
    # a small selection is broadcast once its size is known, when it has been counted
    hits = reads.join(side, reads[key] == side["_id"])
    if order:
        row = F.struct(*[F.col(c) for c in hits.columns])
        first = hits.groupBy(*(file or []), key).agg(F.min_by(row, F.struct(*order)).alias("_row"))
        hits = first.select("_row.*")
    return hits.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*reads.columns)


def storage_order(reads: DataFrame, order: list[str]) -> DataFrame:
    return reads.orderBy(*order)


def point_lookup(reads: DataFrame, read_id: str, key: str = "read_id") -> DataFrame:
    """The row of an id written as text, or none; a text that is no id finds none."""
    return reads.filter(F.col(key) == uuid_bin(F.lit(read_id))).limit(1)


def at_places(reads: DataFrame, batches: list[int] | None = None, rows: list[int] | None = None, batch: str = "_batch", row: str = "_row") -> DataFrame:
    """Rows of the given batches, and of these the given places."""
    if batches is not None:
        reads = reads.filter(F.col(batch).isin(batches))
    return reads.filter(F.col(row).isin(rows)) if rows is not None else reads


def bucketed(rows: DataFrame, size: int, order: list[str]) -> DataFrame:
    """Numbers rows in the order, and gives each the number of its bucket of so many rows. Partition sizes are counted
    once, so no window over all rows is needed."""
    n = partitions_for(rows)
    ranged = rows.repartitionByRange(n, *order) if n else rows.repartitionByRange(*order)
    at = numbered(ranged.sortWithinPartitions(*order), "position")
    return at.withColumn("bucket", F.floor(F.col("position") / size).cast("long"))


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Rows with their number (from 0) in the order of partitions and of the rows within them."""
    placed = checkpoint(ordered.withColumns({"_pid": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before, total = [], 0
    for pid, n in sorted(tuple(r) for r in placed.groupBy("_pid").count().collect()):  # one row a partition
        before.append((pid, total))
        total += n
    offsets = F.broadcast(ordered.sparkSession.createDataFrame(before, "_pid int, _before long"))
    return placed.join(offsets, "_pid").withColumn(name, F.col("_place") + F.col("_before")).drop("_pid", "_place", "_before")


def paths_of(reads: DataFrame, selection: DataFrame, key: str = "read_id", file: str = "_file") -> DataFrame:
    """The files that hold the ids of the selection's first column: key and file, each pair once. Ids that are nowhere have none."""
    wanted = selection.select(F.col(selection.columns[0]).alias(key)).dropna().distinct()
    return reads.select(key, file).join(wanted, key, "left_semi").distinct()


def repeated_ids(reads: DataFrame, key: str = "read_id") -> DataFrame:
    """Ids in more than one row, with their number of rows."""
    return reads.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def has_duplicate(reads: DataFrame, key: str = "read_id") -> bool:
    return not repeated_ids(reads, key).isEmpty()


def sample(reads: DataFrame, fraction: float, seed: int = 0, key: str = "read_id") -> DataFrame:
    """About this part of the distinct ids, the same for the same seed however the rows are placed."""
    return reads.select(key).distinct().filter(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 20)) < int(fraction * (1 << 20)))
