"""Flat views of reads: a registry of fields, each with the columns it needs, and the join to run information.

Deviations kept on purpose: duration, sample_rate and filename can each be selected alone; a sample rate of 0 gives null.
"""

from __future__ import annotations

import codecs
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import uuid_str
from ..functions.keys import acquisition_key
from ..functions.records import not_set, printed
from ..session import broadcast_if_small, checkpoint, ship


class Field(NamedTuple):
    doc: str
    reads: tuple[str, ...]
    info: tuple[str, ...]
    make: Callable[[], Column]


def _plain(name: str, doc: str) -> Field:
    return Field(doc, (name,), (), lambda: F.col(name))


def _info(name: str, doc: str) -> Field:
    return Field(doc, (), (name,), lambda: not_set(name))


def _seconds(column: str) -> Callable[[], Column]:
    return lambda: F.try_divide(F.col(column).cast("double"), F.col("sample_rate"))


#: Fields in the order in which they come out.
FIELDS: dict[str, Field] = {
    "read_id": Field("Id of the read", ("read_id",), (), lambda: uuid_str("read_id")),
    "filename": Field("Name of the file the read is from", ("_file",), (), lambda: F.element_at(F.split("_file", "/"), -1)),
    "read_number": _plain("read_number", "Number of the read"),
    "channel": _plain("channel", "Channel, from 1"),
    "mux": Field("Well, from 1", ("well",), (), lambda: F.col("well")),
    "end_reason": _plain("end_reason", "Why the read ended"),
    "start_time": Field("Seconds from the start of the run to the read's first sample", ("start",), ("sample_rate",), _seconds("start")),
    "start_sample": Field("Samples from the start of the run to the read's first", ("start",), (), lambda: F.col("start")),
    "duration": Field("Seconds that the read lasts", ("num_samples",), ("sample_rate",), _seconds("num_samples")),
    "num_samples": _plain("num_samples", "Number of samples"),
    "minknow_events": Field("Number of events in the read", ("num_minknow_events",), (), lambda: F.col("num_minknow_events")),
    "sample_rate": Field("Samples a second", (), ("sample_rate",), lambda: F.col("sample_rate")),
    "median_before": _plain("median_before", "Level in the well before the read"),
    "predicted_scaling_scale": _plain("predicted_scaling_scale", "Scale of the predicted scaling"),
    "predicted_scaling_shift": _plain("predicted_scaling_shift", "Shift of the predicted scaling"),
    "tracked_scaling_scale": _plain("tracked_scaling_scale", "Scale of the tracked scaling"),
    "tracked_scaling_shift": _plain("tracked_scaling_shift", "Shift of the tracked scaling"),
    "num_reads_since_mux_change": _plain("num_reads_since_mux_change", "Reads since the well was last changed"),
    "time_since_mux_change": _plain("time_since_mux_change", "Seconds since the well was last changed"),
    "run_id": Field("Id of the protocol run", (), ("protocol_run_id",), lambda: F.col("protocol_run_id")),
    "sample_id": _info("sample_id", "Name of the sample"),
    "experiment_id": _info("experiment_name", "Name of the experiment"),
    "flow_cell_id": _info("flow_cell_id", "Id of the flow cell"),
    "pore_type": _plain("pore_type", "Type of the pore"),
    "open_pore_level": _plain("open_pore_level", "Level of the open pore"),
}


def _listed(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def select_fields(include: str | None = None, exclude: str | None = None, ids: bool = False) -> list[str]:
    """Included (all if none is named) less excluded fields, in the registry's order; ids leaves only read_id.

    Unknown fields raise KeyError, an empty selection RuntimeError."""
    if ids:
        return ["read_id"]
    included, excluded = _listed(include) or list(FIELDS), _listed(exclude)
    if unknown := [x for x in included + excluded if x not in FIELDS]:
        raise KeyError(f"unknown fields: {', '.join(unknown)}")
    chosen = [f for f in FIELDS if f in included and f not in excluded]
    if not chosen:
        raise RuntimeError("no field is left")
    return chosen


def source_columns(fields: list[str]) -> tuple[list[str], list[str]]:
    """Columns of reads and of run information that the fields need, with the keys of the join if there is one."""
    reads = list(dict.fromkeys(c for f in fields for c in FIELDS[f].reads))
    info = list(dict.fromkeys(c for f in fields for c in FIELDS[f].info))
    if info:
        reads, info = [*dict.fromkeys([*reads, "run_info"])], ["acquisition_id", *info]
    return reads, info


class AmbiguousAcquisition(ValueError):
    """An acquisition_id with several differing rows."""


def conflicting_acquisitions(run_info: DataFrame, columns: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """acquisition_id (and what else is counted by) and number of distinct rows, where there is more than one."""
    columns = [c for c in (columns or run_info.columns) if c not in ("acquisition_id", "_file")]
    plain = [F.array_sort(F.map_entries(c)) if dict(run_info.dtypes)[c].startswith("map") else F.col(c) for c in columns]
    rows = F.countDistinct(F.to_json(F.struct(*[p.alias(c) for p, c in zip(plain, columns, strict=True)]))) if columns else F.lit(1)
    return run_info.groupBy(*by, "acquisition_id").agg(rows.alias("n_rows")).filter("n_rows > 1")


def join_run_info(reads: DataFrame, run_info: DataFrame, columns: list[str], strict: bool = True) -> DataFrame:
    """Inner join of reads to the distinct rows of run information, per file where both sides name files. Acquisitions are
    compared and given out as bare identifiers.

    strict raises AmbiguousAcquisition if an acquisition's rows differ in the columns; else each is joined."""
    by_file = "_file" in reads.columns and "_file" in run_info.columns
    reads, run_info = reads.withColumn("run_info", acquisition_key("run_info")), run_info.withColumn("acquisition_id", acquisition_key("acquisition_id"))
    if strict and (bad := conflicting_acquisitions(run_info, columns, ("_file",) if by_file else ()).limit(3).collect()):
        raise AmbiguousAcquisition(f"acquisitions with differing rows: {bad}")
    dimension = checkpoint(run_info.select(*(["_file"] if by_file else []), F.col("acquisition_id").alias("_acquisition"), *[c for c in columns if c != "acquisition_id"]).distinct())
    side = broadcast_if_small(dimension.withColumnRenamed("_file", "_info_file"))
    on = reads["run_info"] == side["_acquisition"]
    if by_file:
        on &= reads["_file"] == side["_info_file"]
    return reads.join(side, on).drop("_acquisition", "_info_file")


def view(reads: DataFrame, run_info: DataFrame | None = None, include: str | None = None, exclude: str | None = None, ids: bool = False, strict: bool = True) -> DataFrame:
    """The chosen fields of every read. Only columns that the fields need are read, and run information is joined only
    if a field comes from it; reads without run information then fall away, as in any inner join."""
    fields = select_fields(include, exclude, ids)
    read_columns, info_columns = source_columns(fields)
    out = reads.select(*read_columns, *(["_file"] if "_file" in reads.columns and "_file" not in read_columns else []))
    if info_columns:
        if run_info is None:
            raise ValueError("these fields need run information")
        out = join_run_info(out, run_info, info_columns, strict)
    return out.select(*[FIELDS[f].make().alias(f) for f in fields])


def list_fields(spark) -> DataFrame:
    return spark.createDataFrame([(k, name, f.doc) for k, (name, f) in enumerate(FIELDS.items())], "position int, field string, description string")


def write_view(out: DataFrame, path: str, separator: str = "\t", header: bool = True, force: bool = False) -> None:
    """Text files of a view: null as empty text, floats with 8 digits; an existing path needs force."""
    ship(out.sparkSession)
    texts = [printed(c, 8).alias(c) if kind in ("float", "double") else F.col(c).cast("string").alias(c) for c, kind in out.dtypes]
    separator = codecs.decode(separator, "unicode_escape")
    out.select(*texts).write.mode("overwrite" if force else "error").csv(path, sep=separator, header=header, nullValue="", emptyValue="")
