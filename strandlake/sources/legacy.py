"""The older one-group-per-read HDF5 files, in and out. Needs h5py, which may not be installed; nothing else does."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession

from ..functions.records import END_REASONS, NOT_FORCED
from ..operators.select import bucketed
from .container import ReadStore, write_columns
from .container import register as register_source


class NoHdf5(ImportError):
    """h5py is needed for this and isn't there."""


def hdf5():
    try:
        import h5py
    except ImportError:
        raise NoHdf5("h5py isn't installed") from None
    return h5py


def _text(value) -> str:
    return value.decode() if isinstance(value, bytes) else "" if value is None else str(value)


def end_reason_of(code: int) -> tuple[str, bool]:
    """Codes below 2 are unknown, others one more than ours."""
    name = END_REASONS[code - 1] if 2 <= code <= len(END_REASONS) else END_REASONS[0]
    return name, name not in NOT_FORCED


def read_group(group) -> dict:
    """A read in the form the sink takes."""
    raw, channel = group["Raw"], group["channel_id"].attrs
    tracking = {k: _text(v) for k, v in group["tracking_id"].attrs.items()}
    context = {k: _text(v) for k, v in group["context_tags"].attrs.items()} if "context_tags" in group else {}
    digits = int(channel["digitisation"])
    low, high = (-4096, 4095) if digits == 8192 else (0, 2047)
    reason, forced = end_reason_of(int(raw.attrs.get("end_reason", 0)))
    acquisition = _text(group.attrs.get("run_id")) or tracking.get("run_id", "")
    get = lambda key: tracking.get(key, "")
    info = {
        "acquisition_id": acquisition, "acquisition_start_time": get("exp_start_time") or None, "adc_max": high, "adc_min": low, "context_tags": context, "tracking_id": tracking,
        "experiment_name": get("protocol_group_id"), "flow_cell_id": get("flow_cell_id"), "flow_cell_product_code": get("flow_cell_product_code"), "protocol_name": get("exp_script_name"),
        "protocol_run_id": get("protocol_run_id"), "protocol_start_time": get("protocol_start_time") or None, "sample_id": get("sample_id"), "sample_rate": int(channel["sampling_rate"]),
        "sequencing_kit": context.get("sequencing_kit", ""), "sequencer_position": get("device_id"), "sequencer_position_type": get("device_type"), "software": "strandlake", "system_name": get("host_product_serial_number"), "system_type": get("host_product_code"),
    }
    return {
        "read_id": bytes.fromhex(_text(raw.attrs["read_id"]).replace("-", "")), "read_number": int(raw.attrs["read_number"]), "start": int(raw.attrs["start_time"]), "median_before": float(raw.attrs.get("median_before", np.nan)),
        "num_minknow_events": int(raw.attrs.get("num_minknow_events", 0)), "channel": int(channel["channel_number"]), "well": int(raw.attrs["start_mux"]), "pore_type": _text(group.attrs.get("pore_type")) or "not_set",
        "calibration_offset": float(channel["offset"]), "calibration_scale": float(channel["range"]) / digits, "end_reason": reason, "end_reason_forced": forced, "run_info": acquisition,
        "signal": np.asarray(raw["Signal"], np.int16).tolist(), "info": info, "num_samples": int(raw["Signal"].shape[0]),
    }


def convert(spark: SparkSession, paths: list[str], args) -> None:
    """HDF5 files to containers, a task for each few files. Files that can't be read are skipped with a warning unless strict."""
    import pandas as pd

    hdf5()
    register_source(spark)
    strict, ddl = args.strict, write_columns(False)
    names = [part for part in ddl.split(" info ")[0].split(", ")]
    columns = [n.split(" ")[0] for n in names] + ["info", "dest"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h5py = hdf5()
        for frame in frames:
            for path, dest in zip(frame["path"], frame["dest"], strict=True):
                try:
                    with h5py.File(path) as file:
                        rows = [read_group(file[g]) | {"dest": dest} for g in file if g.startswith("read_")]
                except (OSError, KeyError, ValueError) as e:
                    if strict:
                        raise
                    print(f"{path}: {e}")
                    continue
                for row in rows:
                    for c in ("acquisition_start_time", "protocol_start_time"):
                        at = pd.to_datetime(row["info"][c] or 0, utc=True, errors="coerce")
                        row["info"][c] = pd.Timestamp(0, tz="UTC") if pd.isna(at) else at
                yield pd.DataFrame([{c: r.get(c) for c in columns} for r in rows], columns=columns)

    single = None if args.one_to_one else os.path.basename(args.output) if not os.path.isdir(args.output) else "output.container"
    folder = args.output if os.path.isdir(args.output) or args.one_to_one else os.path.dirname(os.path.abspath(args.output))
    files = spark.createDataFrame([(p, single or os.path.splitext(os.path.relpath(p, args.one_to_one))[0] + ".container") for p in paths], "path string, dest string").repartition(len(paths))
    rows = files.mapInPandas(run, ddl + ", dest string")
    rows.repartition("dest").sortWithinPartitions("dest").write.format("signal_container").option("chunksize", args.signal_chunk_size).mode("overwrite" if args.force_overwrite else "append").save(folder)


def convert_back(spark: SparkSession, paths: list[str], args) -> None:
    """Containers to HDF5 files of at most file_read_count reads each."""
    hdf5()
    store = ReadStore(spark, paths)
    rows = store.complete(decode=True)
    numbered = bucketed(rows, args.file_read_count, ["_file", "_batch", "_row"])
    folder = args.output

    def run(part) -> None:
        h5py = hdf5()
        current, file = None, None
        for row in part:
            if row.bucket != current:
                if file:
                    file.close()
                current, file = row.bucket, h5py.File(os.path.join(folder, f"output.{row.bucket}.fast5"), "w")
            name = bytes(row.read_id).hex()
            group = file.create_group(f"read_{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:]}")
            group.attrs["run_id"], group.attrs["pore_type"] = row.run_info, row.pore_type
            raw = group.create_group("Raw")
            raw.create_dataset("Signal", data=np.asarray(row.signal, np.int16), compression="gzip")
            raw.attrs.update({"read_id": group.name[6:], "read_number": row.read_number, "start_time": row.start, "start_mux": row.well, "duration": row.num_samples, "median_before": row.median_before, "end_reason": (END_REASONS.index(row.end_reason) + 1) * (row.end_reason != END_REASONS[0])})
            channel = group.create_group("channel_id")
            digits = row.info.adc_max - row.info.adc_min + 1
            channel.attrs.update({"channel_number": str(row.channel), "digitisation": digits, "offset": row.calibration_offset, "range": row.calibration_scale * digits, "sampling_rate": float(row.info.sample_rate)})
            for kind in ("tracking_id", "context_tags"):
                group.create_group(kind).attrs.update(dict(getattr(row.info, kind) or {}))
        if file:
            file.close()

    os.makedirs(folder, exist_ok=True)
    numbered.repartition("bucket").sortWithinPartitions("bucket", "position").foreachPartition(run)


