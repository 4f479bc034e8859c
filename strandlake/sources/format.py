"""The container: three Arrow tables in one file behind each other, with a footer that says where they are."""

from __future__ import annotations

import io
import os
import uuid
from typing import Any, NamedTuple

import flatbuffers
import numpy as np
import pyarrow as pa
import pyarrow.ipc
from flatbuffers import number_types
from flatbuffers.table import Table as FlatTable
from pyarrow import fs

# Fixed values of the format: marks in the file, keys of the tables' metadata, names of extension types, numbers of tables
# in the footer, and what the version of written tables is.
SIGNATURE = b"\x8bPOD\r\n\x1a\n"
FOOTER_MAGIC = b"FOOTER\0\0"
KEY_VERSION, KEY_SOFTWARE, KEY_IDENTIFIER = b"MINKNOW:pod5_version", b"MINKNOW:software", b"MINKNOW:file_identifier"
EXTENSION_NAME = b"ARROW:extension:name"
UUID_TYPE, VBZ_TYPE = b"minknow.uuid", b"minknow.vbz"
READS, SIGNAL, RUN_INFO = 0, 1, 4
VERSION = "0.3.30"

SOFTWARE = "strandlake"
TABLES = {"reads": READS, "signal": SIGNAL, "run_info": RUN_INFO}


class BadContainer(ValueError):
    """A file that is no container, or a damaged one."""


class Place(NamedTuple):
    offset: int
    length: int


class Footer(NamedTuple):
    identifier: str
    software: str
    version: str
    tables: dict[int, Place]


class _Slice(io.RawIOBase):
    """A part of an open file, as a file."""

    def __init__(self, file: Any, place: Place):
        self.file, self.place, self.at = file, place, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.place.length)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def read(self, n: int = -1) -> bytes:
        left = max(0, self.place.length - self.at)
        n = left if n is None or n < 0 else min(n, left)
        self.file.seek(self.place.offset + self.at)
        data = self.file.read(n)
        self.at += len(data)
        return bytes(data)


def storage(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def exists(system: fs.FileSystem, path: str) -> bool:
    return system.get_file_info(path).type != fs.FileType.NotFound


def open_random(path: str) -> Any:
    """A file for random access: mapped where it is local, else by its file system."""
    system, inner = storage(path)
    return pa.memory_map(inner) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(inner)


def table_file(file: Any, place: Place) -> Any:
    if isinstance(file, pa.MemoryMappedFile):
        file.seek(place.offset)
        return pa.BufferReader(file.read_buffer(place.length))
    return pa.PythonFile(_Slice(file, place), mode="r")


def parse_footer(file: Any) -> Footer:
    """Signature at both ends, then the footer before the last one, all within the file's bounds."""
    size = file.size()
    least = 2 * len(SIGNATURE) + 32 + 8 + len(FOOTER_MAGIC)
    file.seek(0)
    if size < least or bytes(file.read(8)) != SIGNATURE:
        raise BadContainer("no signature at the beginning")
    tail_at = size - 8 - 16 - 8
    file.seek(tail_at)
    tail = bytes(file.read(32))
    if tail[-8:] != SIGNATURE:
        raise BadContainer("no signature at the end; the file may not have been closed")
    length = int.from_bytes(tail[:8], "little", signed=True)
    if not 0 < length <= tail_at - 24:
        raise BadContainer(f"bad footer length {length}")
    # the length counts the padding or leaves it out: the mark in front of the footer tells
    begin = next((b for b in range(tail_at - length, max(tail_at - length - 8, 31), -1) if _read(file, b - 8, 8) == FOOTER_MAGIC), None)
    if begin is None:
        raise BadContainer("no footer where it should be")
    data = _read(file, begin, tail_at - begin)
    try:
        return _footer(data, begin)
    except BadContainer:
        raise
    except Exception as e:
        raise BadContainer(f"footer can't be read: {e}") from None


def _read(file: Any, at: int, n: int) -> bytes:
    file.seek(at)
    return bytes(file.read(n))


def _footer(data: bytes, limit: int) -> Footer:
    root = FlatTable(data, int.from_bytes(data[:4], "little"))

    def text(slot: int) -> str:
        at = root.Offset(4 + 2 * slot)
        return root.String(root.Pos + at).decode() if at else ""

    tables: dict[int, Place] = {}
    if at := root.Offset(10):
        for k in range(root.VectorLen(at)):
            entry = FlatTable(data, root.Indirect(root.Vector(at) + 4 * k))
            value = lambda slot, flags, entry=entry: entry.Get(flags, entry.Pos + o) if (o := entry.Offset(4 + 2 * slot)) else 0
            place = Place(value(0, number_types.Int64Flags), value(1, number_types.Int64Flags))
            if place.offset < 24 or place.length < 0 or place.offset + place.length > limit:
                raise BadContainer(f"bad place of a table: {place}")
            tables[value(3, number_types.Int16Flags)] = place
    return Footer(text(0), text(1), text(2), tables)


def footer_bytes(identifier: str, tables: dict[int, Place]) -> bytes:
    b = flatbuffers.Builder(512)
    entries = []
    for kind, place in tables.items():
        b.StartObject(4)
        b.PrependInt64Slot(0, place.offset, 0)
        b.PrependInt64Slot(1, place.length, 0)
        b.PrependInt16Slot(2, 0, 0)
        b.PrependInt16Slot(3, kind, 0)
        entries.append(b.EndObject())
    b.StartVector(4, len(entries), 4)
    for e in reversed(entries):
        b.PrependUOffsetTRelative(e)
    contents = b.EndVector()
    texts = [b.CreateString(x) for x in (identifier, SOFTWARE, VERSION)]
    b.StartObject(4)
    for slot, at in enumerate([*texts, contents]):
        b.PrependUOffsetTRelativeSlot(slot, at, 0)
    b.Finish(b.EndObject())
    return bytes(b.Output())


# --- tables as they are stored -------------------------------------------------------------------------------------


def _field(name: str, kind: pa.DataType, extension: bytes | None = None) -> pa.Field:
    return pa.field(name, kind, metadata={EXTENSION_NAME: extension, b"ARROW:extension:metadata": b""} if extension else None)


_TEXT = pa.dictionary(pa.int16(), pa.string())
_F32 = pa.float32()
READS_SCHEMA = pa.schema([
    _field("read_id", pa.binary(16), UUID_TYPE), _field("signal", pa.list_(pa.uint64())), _field("read_number", pa.uint32()), _field("start", pa.uint64()),
    _field("median_before", _F32), _field("num_minknow_events", pa.uint64()), _field("tracked_scaling_scale", _F32), _field("tracked_scaling_shift", _F32),
    _field("predicted_scaling_scale", _F32), _field("predicted_scaling_shift", _F32), _field("num_reads_since_mux_change", pa.uint32()),
    _field("time_since_mux_change", _F32), _field("num_samples", pa.uint64()), _field("channel", pa.uint16()), _field("well", pa.uint8()), _field("pore_type", _TEXT),
    _field("calibration_offset", _F32), _field("calibration_scale", _F32), _field("end_reason", _TEXT), _field("end_reason_forced", pa.bool_()),
    _field("run_info", _TEXT), _field("open_pore_level", _F32),
])
_TIME, _MAP = pa.timestamp("ms", "UTC"), pa.map_(pa.string(), pa.string())
RUN_INFO_SCHEMA = pa.schema([
    ("acquisition_id", pa.string()), ("acquisition_start_time", _TIME), ("adc_max", pa.int16()), ("adc_min", pa.int16()), ("context_tags", _MAP),
    *((c, pa.string()) for c in ("experiment_name", "flow_cell_id", "flow_cell_product_code", "protocol_name", "protocol_run_id")), ("protocol_start_time", _TIME),
    ("sample_id", pa.string()), ("sample_rate", pa.uint16()),
    *((c, pa.string()) for c in ("sequencing_kit", "sequencer_position", "sequencer_position_type", "software", "system_name", "system_type")), ("tracking_id", _MAP),
])


def signal_schema(packed: bool) -> pa.Schema:
    kind = _field("signal", pa.large_binary(), VBZ_TYPE) if packed else _field("signal", pa.large_list(pa.int16()))
    return pa.schema([_field("read_id", pa.binary(16), UUID_TYPE), kind, _field("samples", pa.uint32())])


class _Shifted(io.RawIOBase):
    """Writes to a file from its end on, counting from 0, as an embedded file does."""

    def __init__(self, file: Any):
        self.file, self.begin = file, file.tell()

    def writable(self) -> bool:
        return True

    def write(self, data: Any) -> int:
        return self.file.write(data)

    def tell(self) -> int:
        return self.file.tell() - self.begin

    def flush(self) -> None:
        if not self.file.closed:
            self.file.flush()


class ContainerFile:
    """Writes one container. Signal goes to the file itself, batch by batch; reads and run information to hidden files
    beside it, appended when the file is closed. What a crash loses is the open batches."""

    def __init__(self, path: str, packed: bool = True, chunk: int = 102_400, reads_batch: int = 1000, signal_batch: int = 100):
        self.system, self.inner = storage(path)
        if exists(self.system, self.inner):
            raise FileExistsError(path)
        self.path, self.packed, self.chunk, self.reads_batch, self.signal_batch = path, packed, chunk, reads_batch, signal_batch
        self.identifier, self.marker = str(uuid.uuid4()), uuid.uuid4().bytes
        self.meta = {KEY_VERSION: VERSION.encode(), KEY_SOFTWARE: SOFTWARE.encode(), KEY_IDENTIFIER: self.identifier.encode()}
        folder, stem = os.path.split(self.inner)
        self.beside = {kind: os.path.join(folder, f".{stem}.tmp-{kind}") for kind in ("reads", "run-info")}
        self.file = self.system.open_output_stream(self.inner)
        self.file.write(SIGNATURE + self.marker)
        self.signal_begin = self.file.tell()
        options = pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True)
        self.signal_schema = signal_schema(packed).with_metadata(self.meta)
        self.signal_writer = pa.ipc.new_file(pa.PythonFile(_Shifted(self.file), mode="w"), self.signal_schema)
        self.open = {kind: self.system.open_output_stream(at) for kind, at in self.beside.items()}
        self.schemas = {"reads": READS_SCHEMA.with_metadata(self.meta), "run-info": RUN_INFO_SCHEMA.with_metadata(self.meta)}
        self.writers = {kind: pa.ipc.new_file(f, self.schemas[kind], options=options) for kind, f in self.open.items()}
        self.row_no, self.chunks, self.reads, self.infos = 0, [], [], {}
        self.words: dict[str, dict[str, int]] = {c: {} for c in ("pore_type", "end_reason", "run_info")}

    def add(self, read: dict, info: dict | None, signal: Any = None, chunks: list[tuple[bytes, int]] | None = None) -> None:
        """A read with its run information, and its samples or its packed chunks with their sample counts."""
        if info is None or read.get("run_info") != info.get("acquisition_id"):
            raise BadContainer(f"read names run information {read.get('run_info')!r} that isn't given with it")
        columns = {f.name: pa.array([read[f.name]], f.type.value_type if pa.types.is_dictionary(f.type) else f.type) for f in READS_SCHEMA if f.name in read and f.name not in ("signal", "num_samples")}
        one = pa.RecordBatch.from_pydict(columns)
        if chunks is None:
            self.extend(one, {info["acquisition_id"]: info}, signal=pa.array([[] if signal is None else np.asarray(signal, np.int16)], pa.list_(pa.int16())))
        else:
            kind = pa.list_(pa.struct([("packed", pa.binary()), ("samples", pa.int64())]))
            self.extend(one, {info["acquisition_id"]: info}, chunks=pa.array([[{"packed": data, "samples": n} for data, n in chunks]], kind))

    def extend(self, reads: pa.RecordBatch, infos: dict[str, dict], signal: pa.Array | None = None, chunks: pa.Array | None = None) -> None:
        """Reads as columns, with their samples or their packed chunks, and the run information of those whose is new to the file."""
        from .. import codec

        n = reads.num_rows
        for name in reads.column("run_info").unique().to_pylist():
            if name not in self.infos and name not in infos:
                raise BadContainer(f"reads name run information {name!r} that isn't given with them")
            self._info(infos.get(name) or self.infos[name])
        given = signal if chunks is None else chunks
        size = np.asarray(given.value_lengths().fill_null(0)).astype(np.int64)
        flat = given.flatten()
        if chunks is None:
            if flat.null_count:
                raise BadContainer("signal holds nulls")
            per = -(-size // self.chunk)
            owner = np.repeat(np.arange(n), per)
            at = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
            begin = (np.cumsum(size) - size)[owner] + at * self.chunk
            ends = np.r_[begin, len(flat)]
            samples = np.diff(ends)
            if self.packed:
                data = codec.encode_array(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat))
            else:
                data = pa.LargeListArray.from_arrays(pa.array(ends), flat)
        else:
            per, owner = size, np.repeat(np.arange(n), size)
            samples = np.asarray(flat.field("samples")).astype(np.int64) if len(flat) else np.zeros(0, np.int64)
            data = flat.field("packed") if self.packed else codec.decode_array(flat.field("packed"), flat.field("samples"))
        ids = _no_nulls(reads.column("read_id"), pa.binary(16))
        columns = [ids.take(pa.array(owner)), data.cast(self.signal_schema.field("signal").type), pa.array(samples, pa.uint32())]
        self.chunks.append(pa.RecordBatch.from_arrays(columns, schema=self.signal_schema))
        refs = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array((self.row_no + np.arange(len(owner))).astype(np.uint64)))
        self.row_no += len(owner)
        made = {"read_id": ids, "signal": refs, "num_samples": pa.array(np.bincount(owner, samples, n).astype(np.uint64))}
        self.reads.append([made[f.name] if f.name in made else self._stored(f, reads) for f in READS_SCHEMA])
        self._flush_signal(self.signal_batch)
        self._flush_reads(self.reads_batch)

    def _stored(self, f: pa.Field, reads: pa.RecordBatch) -> pa.Array:
        """A column as it is stored, of words their codes."""
        at = reads.schema.get_field_index(f.name)
        if not pa.types.is_dictionary(f.type):
            return _no_nulls(reads.column(at) if at >= 0 else pa.nulls(reads.num_rows, f.type), f.type)
        words = _no_nulls(reads.column(at) if at >= 0 else pa.nulls(reads.num_rows, pa.string()), pa.string()).dictionary_encode()
        known = self.words[f.name]
        codes = np.array([known.setdefault(w, len(known)) for w in words.dictionary.to_pylist()], np.int64)
        if len(known) >= 32_767:
            raise BadContainer(f"too many values of {f.name}")
        return pa.array(codes[np.asarray(words.indices)].astype(np.int16))

    def _info(self, info: dict) -> None:
        key = info["acquisition_id"]
        if key not in self.infos:
            self.infos[key] = info
            self._write("run-info", pa.RecordBatch.from_pylist([{f.name: _filled(info.get(f.name), f.type) for f in RUN_INFO_SCHEMA}], self.schemas["run-info"]))

    def _write(self, kind: str, batch: pa.RecordBatch) -> None:
        self.writers[kind].write_batch(batch)
        self.open[kind].flush()

    def _flush_signal(self, size: int, all_: bool = False) -> None:
        if not (all_ or sum(b.num_rows for b in self.chunks) >= size):
            return
        for part, whole in _slices(pa.concat_batches(self.chunks) if len(self.chunks) > 1 else self.chunks[0], size) if self.chunks else ():
            if not whole and not all_:
                self.chunks = [part]
                return
            self.signal_writer.write_batch(part)
            self.file.flush()
        self.chunks = []

    def _flush_reads(self, size: int, all_: bool = False) -> None:
        if not (all_ or sum(len(r[0]) for r in self.reads) >= size):
            return
        columns = [pa.concat_arrays(x) for x in zip(*self.reads, strict=True)]
        for part, whole in _slices(pa.RecordBatch.from_arrays(columns, names=READS_SCHEMA.names), size) if columns else ():
            if not whole and not all_:
                self.reads = [part.columns]
                return
            stored = [pa.DictionaryArray.from_arrays(c, pa.array(list(self.words[f.name]), pa.string())) if pa.types.is_dictionary(f.type) else c for f, c in zip(READS_SCHEMA, part.columns, strict=True)]
            self._write("reads", pa.RecordBatch.from_arrays(stored, schema=self.schemas["reads"]))
        self.reads = []

    def close(self) -> None:
        self._flush_signal(self.signal_batch, True)
        self._flush_reads(self.reads_batch, True)
        self.signal_writer.close()
        tables = {SIGNAL: Place(self.signal_begin, self.file.tell() - self.signal_begin)}
        self._pad()
        for kind, number in (("run-info", RUN_INFO), ("reads", READS)):
            self.writers[kind].close()
            self.open[kind].close()
            begin = self.file.tell()
            with self.system.open_input_stream(self.beside[kind]) as part:
                while block := part.read(1 << 20):
                    self.file.write(block)
            tables[number] = Place(begin, self.file.tell() - begin)
            self._pad()
        footer = footer_bytes(self.identifier, tables)
        footer += bytes(-len(footer) % 8)
        self.file.write(FOOTER_MAGIC + footer + len(footer).to_bytes(8, "little", signed=True) + self.marker + SIGNATURE)
        self.file.close()
        for at in self.beside.values():
            self.system.delete_file(at)

    def _pad(self) -> None:
        self.file.write(bytes(-self.file.tell() % 8) + self.marker)

    def abandon(self) -> None:
        """Closes what is open and leaves the files as they are, as a crash would."""
        for f in (self.file, *self.open.values()):
            f.close()

    def discard(self) -> None:
        self.abandon()
        for at in (self.inner, *self.beside.values()):
            if exists(self.system, at):
                self.system.delete_file(at)


def _slices(batch: pa.RecordBatch, size: int):
    """Parts of so many rows, and whether they are whole."""
    for k in range(0, batch.num_rows, size):
        part = batch.slice(k, size)
        yield part, part.num_rows == size


def _no_nulls(values: pa.Array, kind: pa.DataType) -> pa.Array:
    """The values in a stored type, nulls filled as the writer fills them; numbers beyond it raise (Arrow's checked cast)."""
    found = values if values.type == kind else values.cast(kind)
    return found.fill_null(pa.scalar(_filled(None, kind), kind)) if found.null_count else found


def _filled(value: Any, kind: pa.DataType) -> Any:
    """The writer stores no nulls: NaN for floats, 0, false, empty text, map or list. Only unknown times stay null, as every
    number is a time; their place in the column holds 0, which readers that know of no nulls take for the epoch."""
    if value is not None:
        return list(value.items()) if pa.types.is_map(kind) and isinstance(value, dict) else value
    if pa.types.is_timestamp(kind):
        return None
    if pa.types.is_floating(kind):
        return float("nan")
    if pa.types.is_dictionary(kind) or pa.types.is_string(kind):
        return ""
    if pa.types.is_map(kind) or pa.types.is_list(kind):
        return []
    if pa.types.is_fixed_size_binary(kind):
        return bytes(16)
    return False if pa.types.is_boolean(kind) else 0


def stream_batches(path: str, begin: int = 0) -> tuple[pa.Schema | None, list[pa.RecordBatch], str]:
    """The whole batches of a possibly cut-off Arrow file from begin on, up to the first that can't be read, and why it ended."""
    batches, schema = [], None
    try:
        with open(path, "rb") as f:
            f.seek(begin)
            if f.read(8) != b"ARROW1\0\0":
                return None, [], "no Arrow file"
            reader = pa.ipc.open_stream(f)
            schema = reader.schema
            for batch in reader:
                batch.validate(full=True)
                batches.append(batch)
    except (pa.ArrowException, OSError, ValueError, EOFError) as e:
        return schema, batches, str(e)
    return schema, batches, ""
