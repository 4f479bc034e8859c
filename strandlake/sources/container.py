"""Containers as a Spark data source: spark.read.format("signal_container").

Files are listed on the driver, everything else (footers, tables, migration, decoding) happens in tasks. A large file is
cut into several tasks by shares of its batches. Options:

table: reads, signal, run_info or files (one row of metadata per file); columns: those to be read, as Spark doesn't prune
columns of Python sources; batches: numbers of batches; recursive, pattern: of folders; paths: a JSON list of further paths;
badFiles: fail or skip; decode: false leaves packed signal packed; splitBytes: size from which a file is cut; pushFilters: true lets
filters on _file and _batch prune what is opened, which Spark allows only where spark.sql.python.filterPushdown.enabled is set.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from .. import codec
from ..operators.migrate import table_version
from ..schema import READS, RUN_INFO, SIGNAL, SIGNAL_PACKED
from ..session import ship
from . import format as form
from .discovery import listed

META = "_file string, _batch int, _row bigint"
FILES = "_file string, identifier string, software string, version string, table_version int, packed boolean, n_reads bigint, n_signal_rows bigint, n_run_infos bigint, read_batches int, signal_batches int, " + ", ".join(f"{t}_{x} bigint" for t in ("reads", "signal", "run_info") for x in ("offset", "length"))


def _parts(ddl: str) -> dict[str, str]:
    out, depth, part = {}, 0, ""
    for c in ddl + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, _, kind = part.strip().partition(" ")
            out[name], part = kind, ""
        else:
            part += c
    return out


class Opened:
    """One container, open for reading."""

    def __init__(self, path: str, reads: set[str] | None = None, signal: set[str] | None = None):
        """reads, signal: the columns needed of these tables; None: all."""
        self.path, self.file = path, form.open_random(path)
        self.footer = form.parse_footer(self.file)
        self.reads = self._table(form.READS, reads)
        self.signal = self._table(form.SIGNAL, signal)
        found = {self._meta(r, form.KEY_IDENTIFIER) for r in (self.reads, self.signal)}
        if len(found) > 1:
            raise form.BadContainer("reads and signal are of different files")
        self.version = tuple(int(x) for x in (self._meta(self.reads, form.KEY_VERSION) or self.footer.version).split("."))
        if len(self.version) != 3:
            raise form.BadContainer(f"bad version {self.version}")
        self.table_version = table_version(self.version)
        if self.table_version < 3:  # columns are made of others
            self.reads = self._table(form.READS)
        kind = self.signal_type
        self.packed = pa.types.is_large_binary(kind) or pa.types.is_binary(kind)

    def _table(self, kind: int, columns: set[str] | None = None):
        if kind not in self.footer.tables:
            raise form.BadContainer(f"table {kind} is missing")
        reader = pa.ipc.open_file(form.table_file(self.file, self.footer.tables[kind]))
        if kind == form.SIGNAL:
            self.signal_type = reader.schema.field("signal").type
        names = reader.schema.names
        if columns is None or columns >= set(names):
            return reader
        # what isn't needed isn't read; one column is, to tell the number of rows
        kept = [k for k, name in enumerate(names) if name in columns] or [0]
        return pa.ipc.open_file(form.table_file(self.file, self.footer.tables[kind]), options=pa.ipc.IpcReadOptions(included_fields=kept))

    @staticmethod
    def _meta(reader, key: bytes) -> str:
        return ((reader.schema.metadata or {}).get(key) or b"").decode()

    def run_info_batches(self) -> list[pa.RecordBatch]:
        if self.table_version >= 3:
            reader = self._table(form.RUN_INFO)
            return [reader.get_batch(i) for i in range(reader.num_record_batches)]
        # inside the reads: the last batch's dictionary holds all of them
        last = self.reads.get_batch(self.reads.num_record_batches - 1) if self.reads.num_record_batches else None
        if last is None:
            return []
        info = last.column("run_info")
        rows = info.dictionary if isinstance(info, pa.DictionaryArray) else info
        return [pa.RecordBatch.from_struct_array(rows)]

    @cached_property
    def chunk_sizes(self) -> np.ndarray:
        table = self._table(form.SIGNAL, {"samples"})
        n = table.num_record_batches
        return np.concatenate([np.asarray(table.get_batch(i).column("samples")).astype(np.int64) for i in range(n)]) if n else np.zeros(0, np.int64)

    @cached_property
    def signal_rows(self) -> int:
        """Rows of every signal batch but the last."""
        return self._table(form.SIGNAL, {"samples"}).get_batch(0).num_rows if self.signal.num_record_batches else 0

    def n_rows(self, kind: int, column: str) -> int:
        """Of a table all of whose batches but the last have as many rows as the first; two batches are looked at."""
        table = self._table(kind, {column})
        n = table.num_record_batches
        return (n - 1) * table.get_batch(0).num_rows + table.get_batch(n - 1).num_rows if n else 0

    def migrated(self, batch: pa.RecordBatch, needed: set[str]) -> dict[str, pa.Array]:
        """Columns of a reads batch as the newest version has them."""
        out = dict(zip(batch.schema.names, batch.columns, strict=True))
        n, version = batch.num_rows, self.table_version
        nan = lambda: pa.array(np.full(n, np.nan, np.float32))
        if version < 1:
            zero = pa.array(np.zeros(n, np.int64))
            out |= {"num_minknow_events": zero, "num_reads_since_mux_change": zero, "time_since_mux_change": pa.array(np.zeros(n, np.float32))}
            out |= {f"{a}_scaling_{b}": nan() for a in ("tracked", "predicted") for b in ("scale", "shift")}
        if version < 2 and "num_samples" in needed:
            sizes, refs = self.chunk_sizes, out["signal"]
            flat = np.asarray(refs.flatten()).astype(np.int64)
            if len(flat) and (flat.min() < 0 or flat.max() >= len(sizes)):
                raise form.BadContainer("a read refers to a chunk beyond the signal table")
            total = np.r_[0, np.cumsum(sizes[flat])]
            ends = np.cumsum(np.asarray(refs.value_lengths().fill_null(0)))
            out["num_samples"] = pa.array(total[ends] - total[np.r_[0, ends[:-1]]])
        if version < 3:
            plain = lambda c: c.dictionary_decode() if isinstance(c, pa.DictionaryArray) else c
            cal, pore, end, info = (plain(out[c]) for c in ("calibration", "pore", "end_reason", "run_info"))
            out |= {"calibration_offset": pc.struct_field(cal, "offset"), "calibration_scale": pc.struct_field(cal, "scale")}
            out |= {c: pc.struct_field(pore, c) for c in ("channel", "well", "pore_type")}
            out |= {"end_reason": pc.struct_field(end, "name"), "end_reason_forced": pc.struct_field(end, "forced"), "run_info": pc.struct_field(info, "acquisition_id")}
        if version < 4:
            out["open_pore_level"] = nan()
        return out


_ARROW = {"binary": pa.binary(), "bigint": pa.int64(), "float": pa.float32(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<smallint>": pa.list_(pa.int16()), "timestamp": pa.timestamp("us", "UTC"), "map<string,string>": pa.map_(pa.string(), pa.string())}


def fit(array: pa.Array, kind: str) -> pa.Array:
    """As Spark's type; numbers beyond it raise (Arrow's checked cast)."""
    if isinstance(array, pa.ExtensionArray):
        array = array.storage
    if isinstance(array, pa.DictionaryArray):
        array = array.dictionary_decode()
    target = _ARROW[kind]
    if pa.types.is_map(target) and pa.types.is_map(array.type):
        return array.cast(target)
    return array if array.type == target else array.cast(target)


class Share(InputPartition):
    def __init__(self, path: str, part: int, of: int):
        super().__init__((path, part, of))


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict, schema: dict[str, str]):
        self.options, self.schema = options, schema
        self.table = options.get("table", "reads")
        self.batches = {int(x) for x in options["batches"].split(",") if x.strip()} if options.get("batches") else None
        self.files: set[str] | None = None

    def partitions(self):
        paths = [self.options["path"]] if self.options.get("path") else []
        paths += json.loads(self.options.get("paths", "[]"))
        found = listed(paths, self.options.get("recursive", "false") == "true", self.options.get("pattern", "*"))
        split = int(self.options.get("splitbytes", 128 << 20))
        cut = self.table in ("reads", "signal")
        return [Share(path, k, n) for path, size in found if self.files is None or path in self.files for n in [max(1, -(-size // split)) if cut else 1] for k in range(n)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        path, part, of = partition.value
        try:
            wanted = set(self.schema)
            opened = Opened(path, wanted if self.table == "reads" else set(), wanted | ({"signal"} if "n_bytes" in wanted else set()) | {"samples"} if self.table == "signal" else set())
        except (form.BadContainer, pa.ArrowException, OSError):
            if self.options.get("badfiles", "fail") == "skip":
                return
            raise
        if self.table == "files":
            yield self._summary(opened)
            return
        if self.table == "run_info":
            for k, batch in enumerate(opened.run_info_batches()):
                yield self._out(opened, dict(zip(batch.schema.names, batch.columns, strict=True)), k, 0, batch.num_rows)
            return
        reader = opened.reads if self.table == "reads" else opened.signal
        n = reader.num_record_batches
        for k in range(n * part // of, n * (part + 1) // of):
            if self.batches is None or k in self.batches:
                batch = reader.get_batch(k)
                columns = opened.migrated(batch, wanted) if self.table == "reads" else self._chunks(opened, batch, k * opened.signal_rows if "row_no" in wanted else 0)
                yield self._out(opened, columns, k, 0, batch.num_rows)

    def _chunks(self, opened: Opened, batch: pa.RecordBatch, row: int) -> dict[str, pa.Array]:
        out = dict(zip(batch.schema.names, batch.columns, strict=True))
        out["row_no"] = pa.array(np.arange(row, row + batch.num_rows))
        if "signal" in self.schema:
            signal = out["signal"].storage if isinstance(out["signal"], pa.ExtensionArray) else out["signal"]
            wanted = "binary" if self.options.get("decode", "true") == "false" else "array"
            if opened.packed and wanted == "array":
                signal = codec.decode_array(signal.cast(pa.binary()), out["samples"])
            elif not opened.packed and wanted == "binary":
                signal = codec.encode_array(signal)
            out["signal"] = signal
        if "n_bytes" in self.schema:
            raw = batch.column("signal").storage if isinstance(batch.column("signal"), pa.ExtensionArray) else batch.column("signal")
            out["n_bytes"] = pc.binary_length(raw) if opened.packed else pc.multiply(pc.list_value_length(raw).cast(pa.int64()), 2)
        return out

    def _out(self, opened: Opened, columns: dict[str, pa.Array], batch: int, first: int, n: int) -> pa.RecordBatch:
        columns |= {"_file": pa.array([opened.path] * n, pa.string()), "_batch": pa.array(np.full(n, batch, np.int32)), "_row": pa.array(np.arange(first, first + n))}
        return pa.RecordBatch.from_arrays([fit(columns[c], kind) for c, kind in self.schema.items()], names=list(self.schema))

    def _summary(self, opened: Opened) -> pa.RecordBatch:
        row = {
            "_file": opened.path, "identifier": opened.footer.identifier, "software": opened.footer.software, "version": ".".join(map(str, opened.version)), "table_version": opened.table_version,
            "packed": opened.packed, "n_reads": opened.n_rows(form.READS, "read_id"), "n_signal_rows": opened.n_rows(form.SIGNAL, "samples"), "n_run_infos": sum(b.num_rows for b in opened.run_info_batches()),
            "read_batches": opened.reads.num_record_batches, "signal_batches": opened.signal.num_record_batches,
        }
        for name, kind in form.TABLES.items():
            place = opened.footer.tables.get(kind, (None, None))
            row |= {f"{name}_offset": place[0], f"{name}_length": place[1]}
        return pa.RecordBatch.from_pylist([{c: row[c] for c in self.schema}], pa.schema([(c, _ARROW[k]) for c, k in self.schema.items()]))


class PushingReader(ContainerReader):
    def pushFilters(self, filters):
        """Filters on _batch and _file prune what is opened; Spark still applies them."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute == ("_batch",) and self.table != "files":
                self.batches = values if self.batches is None else self.batches & values
            if values is not None and f.attribute == ("_file",):
                self.files = values if self.files is None else self.files & values
            yield f


#: What the sink takes: a read a row, with its samples or packed chunks, its run information, and its output if there are several.
def write_columns(packed_chunks: bool) -> str:
    reads = ", ".join(f"{c} {k}" for c, k in _parts(READS).items() if c != "signal")
    signal = "chunks array<struct<packed:binary,samples:bigint>>" if packed_chunks else "signal array<smallint>"
    return f"{reads}, {signal}, info struct<{', '.join(f'{c}:{k}' for c, k in _parts(RUN_INFO).items())}>"


class Written(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]], reads: int):
        self.files, self.reads = files, reads


#: Outputs of tasks that write without dest.
_PART = re.compile(r"part-\d{5}\.container")


class ContainerWriter(DataSourceArrowWriter):
    """One container a task, or one for each value of dest; named only when all tasks have succeeded. Everything is written to the
    folder itself, whatever file system it is on.

    overwrite replaces files of the same names; without dest, also those that an earlier write of more tasks left."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite, self.folder = options, overwrite, options["path"]

    def _open(self, path: str) -> form.ContainerFile:
        sizes = (int(self.options.get(k, v)) for k, v in (("chunksize", 102_400), ("readsbatch", 1000), ("signalbatch", 100)))
        return form.ContainerFile(path, self.options.get("encoding", "vbz") == "vbz", *sizes)

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        system, folder = form.storage(self.folder)
        system.create_dir(folder)
        base = self.folder.rstrip("/")
        single = f"part-{task.partitionId() if task else 0:05d}.container"
        current, file, done, reads, seen = None, None, [], 0, set()
        try:
            for batch in iterator:
                at = batch.schema.get_field_index("dest")
                dests = pc.fill_null(batch.column(at), single).to_pylist() if at >= 0 else [single] * batch.num_rows
                begins = [k for k in range(len(dests)) if k == 0 or dests[k] != dests[k - 1]]
                for k, end in zip(begins, [*begins[1:], len(dests)], strict=True):
                    dest = dests[k]
                    if dest != current:
                        if file:
                            file.close()
                        if dest in seen:
                            raise form.BadContainer(f"rows of {dest} aren't together")
                        seen.add(dest)
                        current, (inner, name) = dest, os.path.split(dest)
                        hidden = os.path.join(inner, f".{name}.{task.taskAttemptId() if task else 0}")
                        system.create_dir(os.path.join(folder, inner))
                        file = self._open(f"{base}/{hidden}")
                        done.append((hidden, dest))
                    self._add(file, batch.slice(k, end - k))
                    reads += end - k
            if file:
                file.close()
        except BaseException:
            if file:
                file.discard()
            self._remove([hidden for hidden, _ in done])
            raise
        return Written(done, reads)

    @staticmethod
    def _add(file: form.ContainerFile, rows: pa.RecordBatch) -> None:
        info, named = rows.column("info"), rows.column("run_info")
        there = pc.and_(info.is_valid(), pc.equal(pc.struct_field(info, "acquisition_id"), named)).fill_null(False)
        if not pc.all(there, min_count=0).as_py():
            name = named.filter(pc.invert(there))[0].as_py()
            raise form.BadContainer(f"read names run information {name!r} that isn't given with it")
        # a file's run information is few rows, so it is unpacked once each
        found = named.dictionary_encode()
        first = np.unique(np.asarray(found.indices), return_index=True)[1]
        new = {named[int(k)].as_py(): int(k) for k in first}
        infos = {name: info[k].as_py() for name, k in new.items() if name not in file.infos}
        for x in infos.values():
            x.update({c: dict(x[c]) for c in ("context_tags", "tracking_id") if x.get(c) is not None})
        get = lambda name: rows.column(at) if (at := rows.schema.get_field_index(name)) >= 0 else None
        chunks = get("chunks")
        signal = get("signal") if chunks is None else None
        if chunks is None and signal is None:
            signal = pa.array([[]] * rows.num_rows, pa.list_(pa.int16()))
        kept = [c for c in rows.schema.names if c in form.READS_SCHEMA.names and c not in ("signal", "num_samples")]
        file.extend(rows.select(kept), infos, signal, chunks)

    def _remove(self, names: list[str]) -> None:
        system, folder = form.storage(self.folder)
        for name in names:
            if form.exists(system, at := os.path.join(folder, name)):
                system.delete_file(at)

    def commit(self, messages):
        system, folder = form.storage(self.folder)
        pairs = [p for m in messages if m for p in m.files]
        if not self.overwrite and (there := [final for _, final in pairs if form.exists(system, os.path.join(folder, final))]):
            self.abort(messages)
            raise FileExistsError(f"outputs exist already: {there[:3]}")
        for hidden, final in pairs:
            system.move(os.path.join(folder, hidden), os.path.join(folder, final))
        finals = {final for _, final in pairs}
        if self.overwrite and all(map(_PART.fullmatch, finals)) and form.exists(system, folder):
            names = [i.base_name for i in system.get_file_info(fs.FileSelector(folder))]
            self._remove([x for x in names if _PART.fullmatch(x) and x not in finals])

    def abort(self, messages):
        self._remove([hidden for m in messages if m for hidden, _ in m.files])


class ContainerSource(DataSource):
    @classmethod
    def name(cls):
        return "signal_container"

    def _columns(self) -> dict[str, str]:
        table = self.options.get("table", "reads")
        packed = self.options.get("decode", "true") == "false"
        ddl = {"reads": f"{READS}, {META}", "signal": f"{SIGNAL_PACKED if packed else SIGNAL}, row_no bigint, n_bytes bigint, {META}", "run_info": f"{RUN_INFO}, {META}", "files": FILES}[table]
        every = _parts(ddl)
        chosen = [c.strip() for c in self.options["columns"].split(",")] if self.options.get("columns") else list(every)
        if unknown := [c for c in chosen if c not in every]:
            raise KeyError(f"unknown columns: {unknown}")
        return {c: every[c] for c in chosen}

    def schema(self):
        return ", ".join(f"{c} {k}" for c, k in self._columns().items())

    def reader(self, schema):
        kind = PushingReader if self.options.get("pushfilters", "false") == "true" else ContainerReader
        return kind(dict(self.options), self._columns())

    def writer(self, schema, overwrite):
        return ContainerWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ContainerSource)


class ReadStore:
    """The tables of one or many containers, each a lazy DataFrame."""

    def __init__(self, spark: SparkSession, paths: str | list[str], recursive: bool = False, pattern: str = "*", bad_files: str = "fail"):
        register(spark)
        self.spark = spark
        self.options = {"paths": json.dumps([paths] if isinstance(paths, str) else list(paths)), "recursive": str(recursive).lower(), "pattern": pattern, "badFiles": bad_files, "pushFilters": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")}

    def table(self, name: str, columns: list[str] | None = None, **options: str) -> DataFrame:
        reader = self.spark.read.format("signal_container").options(table=name, **self.options, **options)
        return (reader.option("columns", ",".join(columns)) if columns else reader).load()

    def reads(self, columns: list[str] | None = None, batches: list[int] | None = None, selection: DataFrame | None = None, missing_ok: bool = False) -> DataFrame:
        """All reads, or those of some batches, or those of a bag of ids; batches and selection exclude each other."""
        from ..operators.select import select_reads

        if batches is not None and selection is not None:
            raise ValueError("batches and selection can't both be given")
        out = self.table("reads", columns and [*dict.fromkeys([*columns, "read_id", "_file", "_batch", "_row"])], **({"batches": ",".join(map(str, batches))} if batches is not None else {}))
        return out if selection is None else select_reads(out, selection, file=["_file"], order=["_batch", "_row"], strict=not missing_ok)

    def run_info(self) -> DataFrame:
        return self.table("run_info")

    def signal(self, decode: bool = True, columns: list[str] | None = None) -> DataFrame:
        return self.table("signal", columns, decode=str(decode).lower())

    def files(self) -> DataFrame:
        return self.table("files")

    def num_reads(self) -> int:
        """From the tables' metadata alone."""
        from pyspark.sql import functions as F

        return self.table("files", ["n_reads"]).agg(F.coalesce(F.sum("n_reads"), F.lit(0))).first()[0]

    def read_ids(self) -> DataFrame:
        from ..functions.ids import uuid_str

        return self.table("reads", ["read_id"]).select(uuid_str("read_id").alias("read_id"))

    def view(self, **how) -> DataFrame:
        from ..operators.view import select_fields, source_columns, view

        fields = select_fields(how.get("include"), how.get("exclude"), how.get("ids", False))
        reads, info = source_columns(fields)
        return view(self.table("reads", [*dict.fromkeys([*reads, "_file"])]), self.table("run_info", [*info, "_file"]) if info else None, **how)

    def complete(self, decode: bool = False) -> DataFrame:
        """Reads in the form that the sink takes: packed chunks in order, or with decode the whole signal; and run information."""
        from pyspark.sql import functions as F

        from ..operators.signal import chunks_of_reads
        from ..session import broadcast_if_small, checkpoint

        keys = ["_file", "_batch", "_row"]
        reads = self.table("reads")
        parts = chunks_of_reads(reads.select(*keys, "signal"), self.table("signal", ["row_no", "_file", "signal", "samples"], decode=str(decode).lower()), keys)
        ordered = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("position", "signal", "samples"))).alias("p"))
        if decode:
            made = F.coalesce(F.flatten(F.transform("p", lambda x: x["signal"])), F.array().cast("array<smallint>")).alias("signal")
        else:
            made = F.coalesce(F.transform("p", lambda x: F.struct(x["signal"].alias("packed"), x["samples"].alias("samples"))), F.array().cast("array<struct<packed:binary,samples:bigint>>")).alias("chunks")
        info = self.run_info().dropDuplicates(["_file", "acquisition_id"]).drop("_batch", "_row")
        info = checkpoint(info.select(F.col("_file").alias("_f"), F.col("acquisition_id").alias("_a"), F.struct(*[c for c in info.columns if c != "_file"]).alias("info")))
        joined = reads.drop("signal").join(ordered, keys, "left").join(broadcast_if_small(info, 20_000), (F.col("_f") == F.col("_file")) & (F.col("_a") == F.col("run_info")), "left")
        return joined.select(*[c for c in reads.columns if c not in ("signal", *keys)], made, "info", *keys)


def write(rows: DataFrame, path: str, overwrite: bool = False, **options: str) -> None:
    """Writes rows (as complete() gives them, further columns but dest left aside) as containers into a folder.

    With dest, rows that say where they stood (_file, _batch, _row) stand in that order in each output."""
    from ..operators.route import routed_for_writing

    register(rows.sparkSession)
    known = {*_parts(READS), "chunks", "info", "dest"}
    place = ["_file", "_batch", "_row"]
    order = place if {"dest", *place} <= set(rows.columns) else []
    rows = rows.select(*[c for c in rows.columns if c in known], *order)
    if "dest" in rows.columns:
        rows = routed_for_writing(rows, order=order).drop(*order)
    rows.write.format("signal_container").options(**options).mode("overwrite" if overwrite else "append").save(path)
