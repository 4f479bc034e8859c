"""Containers that were never closed: what can be saved of them, and updating old ones."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import format as form


def recover_file(path: str, output: str, cleanup: bool = False) -> dict:
    """Writes a container of the whole batches that can be read of an unclosed one and of the hidden files beside it.

    A read is saved if all chunks it refers to were; a file without a readable signal or reads table, or of an older version, raises
    BadContainer.
    cleanup removes the damaged files afterwards."""
    folder, stem = os.path.split(path)
    beside = {kind: os.path.join(folder, f".{stem}.tmp-{kind}") for kind in ("reads", "run-info")}
    with open(path, "rb") as f:
        if f.read(8) != form.SIGNATURE:
            raise form.BadContainer("no signature at the beginning")
    schema, chunks, why = form.stream_batches(path, 24)
    if schema is None:
        raise form.BadContainer(f"signal can't be read: {why}")
    parts, errors = {}, [why] if why else []
    for kind, at in beside.items():
        if not os.path.exists(at):
            raise form.BadContainer(f"{at} is missing")
        found, parts[kind], why = form.stream_batches(at)
        if found is None:
            raise form.BadContainer(f"{kind} can't be read: {why}")
        errors += [why] if why else []
    if parts["reads"] and parts["reads"][0].schema.names != form.READS_SCHEMA.names:
        raise form.BadContainer("the reads table is of an older version: update the file before it is recovered")
    packed = not pa.types.is_large_list(schema.field("signal").type)
    signal = pa.Table.from_batches(chunks, schema)
    infos = {row["acquisition_id"]: row for b in parts["run-info"] for row in b.to_pylist()}
    out = form.ContainerFile(output, packed)
    saved = lost = 0
    for batch in parts["reads"]:
        refs = batch.column("signal")
        flat, per = np.asarray(refs.flatten()).astype(np.int64), np.asarray(refs.value_lengths().fill_null(0))
        names = batch.column("run_info").cast(pa.string())
        beyond = np.bincount(np.repeat(np.arange(len(per)), per), flat >= signal.num_rows, len(per)) > 0
        whole = ~beyond & np.asarray(pc.is_in(names, pa.array(list(infos), pa.string())))
        lost += int((~whole).sum())
        saved += int(whole.sum())
        if not whole.any():
            continue
        kept = pa.array(np.flatnonzero(whole))
        used = signal.take(pa.array(flat[np.repeat(whole, per)]))
        ends = np.r_[0, np.cumsum(per[whole])]
        data, samples = used["signal"].combine_chunks(), used["samples"].combine_chunks()
        data = data.storage if isinstance(data, pa.ExtensionArray) else data
        columns = {c: batch.column(c) for c in batch.schema.names if c not in ("signal", "num_samples")}
        columns = {c: (x.storage if isinstance(x, pa.ExtensionArray) else x).take(kept) for c, x in columns.items()}
        columns = {c: x.cast(pa.string()) if pa.types.is_dictionary(x.type) else x for c, x in columns.items()}
        rows = pa.RecordBatch.from_pydict(columns)
        if packed:
            pairs = pa.StructArray.from_arrays([data.cast(pa.binary()), samples.cast(pa.int64())], ["packed", "samples"])
            out.extend(rows, infos, chunks=pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pairs))
        else:
            at = np.r_[0, np.cumsum(np.asarray(data.value_lengths()))][ends]
            out.extend(rows, infos, signal=pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), data.flatten()))
    counts = {"n_signal_rows": signal.num_rows, "n_run_infos": len(infos), "n_reads": saved, "n_lost": lost, "errors": "; ".join(errors)}
    out.close()
    if cleanup:
        for at in (path, *beside.values()):
            os.remove(at)
    return counts


_SCHEMA = pa.schema([("path", pa.string()), ("output", pa.string()), ("n_signal_rows", pa.int64()), ("n_run_infos", pa.int64()), ("n_reads", pa.int64()), ("n_lost", pa.int64()), ("errors", pa.string())])


def recover(spark: SparkSession, paths: list[str], suffix: str = "_recovered", cleanup: bool = False) -> DataFrame:
    """Recovers many files, one a task; a row of counts for each. Files that can't be recovered give their error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column(0).to_pylist():
                stem, dot, ending = path.rpartition(".")
                output = f"{stem}{suffix}.{ending}" if dot else path + suffix
                try:
                    rows.append({"path": path, "output": output} | recover_file(path, output, cleanup))
                except (form.BadContainer, OSError) as e:
                    rows.append({"path": path, "errors": str(e)})
            yield pa.RecordBatch.from_pylist(rows, _SCHEMA)

    from ..session import checkpoint

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    # kept: recovering is done once, however often the counts are looked at
    return checkpoint(files.mapInArrow(run, "path string, output string, n_signal_rows long, n_run_infos long, n_reads long, n_lost long, errors string"))


