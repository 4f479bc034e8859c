"""Union of read sets, and the dimension rows that go with them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import acquisition_key
from ..session import broadcast_if_small, checkpoint
from .select import repeated_ids


class DuplicateReads(ValueError):
    """The same read id in several rows of a merged output."""


class BrokenReference(ValueError):
    """A row names a dimension row that isn't there."""


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merge(parts: list[DataFrame], check: bool = True, key: str = "read_id") -> DataFrame:
    """Union of all rows; with check, an id in several rows raises DuplicateReads before anything is written."""
    out = union(parts)
    if check and (bad := repeated_ids(out.select(key), key).limit(3).collect()):
        raise DuplicateReads(f"duplicate read ids, such as {[bytes(r[0]).hex() if isinstance(r[0], (bytes, bytearray)) else r[0] for r in bad]}")
    return out


def merge_dimension(parts: list[DataFrame]) -> DataFrame:
    """Distinct dimension rows by full value; maps are compared as sets of pairs."""
    rows = union(parts)
    maps = [c for c, kind in rows.dtypes if kind.startswith("map")]
    flat = rows.select(*[F.array_sort(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in rows.columns]).distinct()
    return flat.select(*[F.map_from_entries(c).alias(c) if c in maps else F.col(c) for c in rows.columns])


def check_references(reads: DataFrame, run_info: DataFrame) -> None:
    """Raises BrokenReference if a read's run_info is no acquisition of run_info; null refers to nothing and is broken too."""
    used = checkpoint(reads.select("run_info").distinct())
    lost = used.join(run_info.select(F.col("acquisition_id").alias("run_info")).distinct(), "run_info", "left_anti")
    if bad := lost.limit(3).collect():
        raise BrokenReference(f"reads name run information that isn't there: {[r[0] for r in bad]}")


def with_run_info(reads: DataFrame, run_info: DataFrame, strict: bool = True) -> DataFrame:
    """reads with info, a struct of the run information that each names; acquisitions are compared as bare identifiers.

    Where an acquisition has several rows, one with the smallest values counts. An acquisition that isn't there, null too, raises
    BrokenReference, or, if not strict, gives a null info."""
    rows = run_info.select(acquisition_key("acquisition_id").alias("_a"), F.struct(*run_info.columns).alias("info")).dropna(subset=["_a"])
    if strict:
        check_references(reads.select(acquisition_key("run_info").alias("run_info")), rows.select(F.col("_a").alias("acquisition_id")))
    order = F.to_json("info")
    one = checkpoint(rows.groupBy("_a").agg(F.min_by("info", order).alias("info")))
    return reads.join(broadcast_if_small(one, 20_000), acquisition_key(reads["run_info"]) == F.col("_a"), "left").drop("_a")


def dimension_upsert(dimension: DataFrame, rows: DataFrame) -> DataFrame:
    """Dimension with those of rows added that it has not yet."""
    return merge_dimension([dimension, rows])
