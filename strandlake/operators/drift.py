"""Records whose schema drifts from file to file: one consistent table, and the list of changes.

A file's schema is the set of its keys and their types; its fingerprint names it. The registry holds for each producer the versions that
it has written, and for each version its migration: which key holds which field (rename), which fields it lacks (default), and which
types must change (cast). Keys that no step knows are matched, from a file to its next, with fields that go away; such renames become
steps of the producer's versions like those that are known beforehand. Every record is then routed by its file's version through these
steps, as expressions over parsed JSON.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import END_REASONS
from ..session import broadcast_if_small, checkpoint
from .ordered_scan import Scan, ordered_scan

#: Fields of the consistent table and their types.
FIELDS = {
    "read_id": "string", "read_number": "long", "start": "long", "median_before": "float", "num_minknow_events": "long",
    "tracked_scaling_scale": "float", "tracked_scaling_shift": "float", "predicted_scaling_scale": "float", "predicted_scaling_shift": "float",
    "num_reads_since_mux_change": "long", "time_since_mux_change": "float", "num_samples": "long", "channel": "int", "well": "short",
    "pore_type": "string", "calibration_offset": "float", "calibration_scale": "float", "end_reason": "string", "end_reason_forced": "boolean",
    "run_info": "string", "open_pore_level": "float",
}

#: Migration steps: other keys under which producers wrote a field. Each is a rename of the step's version.
RENAMES = {
    1: {"sample_count": "num_samples", "n_samples": "num_samples", "length_in_samples": "num_samples"},
    2: {"open_pore_pa": "open_pore_level", "pore_level_open": "open_pore_level"},
    3: {"trk_scale": "tracked_scaling_scale", "tracked_scaling.scale": "tracked_scaling_scale", "tracked_scaling.shift": "tracked_scaling_shift", "predicted_scaling.scale": "predicted_scaling_scale", "predicted_scaling.shift": "predicted_scaling_shift"},
    4: {"pore_kind": "pore_type", "mux": "well"},
    5: {"median_before_pa": "median_before", "read_end_reason": "end_reason", "end_reason.name": "end_reason", "end_reason.forced": "end_reason_forced", "calibration.offset": "calibration_offset", "calibration.scale": "calibration_scale"},
}
_PLAIN = {re.sub(r"[^a-z0-9]", "", f): f for f in FIELDS}

WHOLE, DECIMAL, TEXT, OTHER = "whole", "decimal", "text", "other"


def chained(name: str) -> str:
    """A key after all migration steps in their order."""
    for step in sorted(RENAMES):
        name = RENAMES[step].get(name, name)
    return name


@lru_cache(maxsize=10_000)
def field_of(path: str) -> str | None:
    """The field that a key (with dots between the names of nested objects) holds, None if it is none that is known.

    In turn: the field's own name, the renames, the last name of a nested key, and the same name in another spelling."""
    for name in (path, path.rpartition(".")[2]):
        if chained(name) in FIELDS:
            return chained(name)
        plain = re.sub(r"[^a-z0-9]", "", name.lower())
        if plain in _PLAIN:
            return _PLAIN[plain]
    return _PLAIN.get(re.sub(r"[^a-z0-9]", "", path.lower()))


Key = tuple[str, ...]
_NAME = re.compile(r"`((?:[^`]|``)*)`|([^`:<>,]+)")


def leaves_of(shape: str) -> list[tuple[Key, str | None]]:
    """Names (of nested objects, outermost first) and kind of every key of a shape, the type of a parsed payload as Spark writes it. A kind
    of None: only null."""
    out: list[tuple[Key, str | None]] = []

    def read(at: int, names: Key) -> int:
        """Reads the type that begins at a place; returns the place behind it."""
        if shape.startswith("OBJECT<", at):
            at += 7
            while shape[at] != ">":
                name = _NAME.match(shape, at)
                at = read(name.end() + 2, (*names, name.group(2) if name.group(1) is None else name.group(1).replace("``", "`")))
                at += 2 if shape.startswith(", ", at) else 0
            return at + 1
        end, depth = at, 0
        while end < len(shape) and (depth or shape[end] not in ",>"):
            # names within an array's objects are quoted if they hold brackets
            end = _NAME.match(shape, end).end() if shape[end] == "`" else end + 1
            depth += (shape[end - 1] in "<(") - (shape[end - 1] in ">)") if shape[end - 1] != "`" else 0
        out.append((names, kind_of(shape[at:end])))
        return end

    read(0, ())
    return out


def kind_of(type_: str) -> str | None:
    if type_.startswith("DECIMAL("):
        digits, scale = map(int, type_[8:-1].split(","))
        # a whole number beyond 64 bits; a decimal one that happens to be whole has fewer digits
        return WHOLE if scale == 0 and digits > 18 else DECIMAL
    return {"VOID": None, "BIGINT": WHOLE, "DOUBLE": DECIMAL, "FLOAT": DECIMAL, "STRING": TEXT}.get(type_, OTHER)


def json_path(names: Key) -> str:
    """The path of a key in Spark's language for parsed JSON."""
    return "$" + "".join(f'["{n}"]' if "'" in n else f"['{n}']" for n in names)


def parsed(exports: DataFrame) -> DataFrame:
    """Rows with v, the parsed payload, and shape, its type, both null if the payload is null, can't be read, or is no object."""
    rows = exports.select(
        F.col("rec_id").cast("long").alias("rec_id") if "rec_id" in exports.columns else F.lit(None).cast("long").alias("rec_id"), "producer",
        F.col("file_seq").cast("long").alias("file_seq"), F.col("file_id").cast("long").alias("file_id"), F.try_parse_json("payload").alias("v"),
    )
    shaped = rows.withColumn("shape", F.schema_of_variant("v"))
    known = F.col("shape").startswith("OBJECT<")
    return shaped.withColumn("v", F.when(known, F.col("v"))).withColumn("shape", F.when(known, F.col("shape")))


_KEYS = pa.schema([("producer", pa.string()), ("file_seq", pa.int64()), ("file_id", pa.int64()), ("path", pa.string()), ("json_path", pa.string()), ("kind", pa.string())])
_KEY_ARRAY = "array<struct<path:string,json_path:string,kinds:array<string>>>"


def file_schemas(exports: DataFrame) -> DataFrame:
    """One row per file: producer, file_seq, file_id and its keys as an array of (path, json_path, kinds); files without a
    readable payload have an empty one. A file's keys are few, however many records it holds.

    Only the distinct shapes of a file's payloads leave the JVM."""
    shapes = parsed(exports).groupBy("producer", "file_seq", "file_id", "shape").agg(F.count(F.lit(1)).alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=10_000)(leaves_of)
        for batch in batches:
            seen = {}
            for producer, seq, file, shape in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                seen[producer, seq, file, None, None, None] = None
                for names, kind in known(shape) if shape else ():
                    seen[producer, seq, file, ".".join(names), json_path(names), kind] = None
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*seen, strict=True), _KEYS, strict=True)], schema=_KEYS) if seen else pa.RecordBatch.from_pylist([], _KEYS)

    found = shapes.select("producer", "file_seq", "file_id", "shape").mapInArrow(run, "producer string, file_seq long, file_id long, path string, json_path string, kind string")
    paths = found.groupBy("producer", "file_seq", "file_id", "path", "json_path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    key = F.when(F.col("path").isNotNull(), F.struct("path", "json_path", "kinds"))
    return paths.groupBy("producer", "file_seq", "file_id").agg(F.array_sort(F.collect_list(key)).alias("keys"))


def resolve(keys: list[dict], aliases: dict[str, str] | None = None) -> dict[str, tuple[frozenset, str | None]]:
    """Field (or ? and the key's own name, if it is of none that is known) to its keys and its type."""
    out: dict[str, tuple[frozenset, set]] = {}
    for key in keys:
        name = field_of(key["path"]) or (aliases or {}).get(key["path"]) or "?" + key["path"]
        paths, kinds = out.get(name, (frozenset(), set()))
        out[name] = paths | {key["path"]}, kinds | set(key["kinds"])
    return {name: (paths, _one(kinds)) for name, (paths, kinds) in out.items()}


def _one(kinds: set) -> str | None:
    """The one type of a field's non-null values: of whole and decimal numbers decimal, of other mixtures text."""
    if len(kinds) < 2:
        return next(iter(kinds), None)
    return DECIMAL if kinds <= {WHOLE, DECIMAL} else TEXT


def fingerprint(schema: dict) -> str:
    text = json.dumps(sorted((name, sorted(paths), kind or "") for name, (paths, kind) in schema.items()))
    return hashlib.sha256(text.encode()).hexdigest()[:16]


#: Likeness of two names from which a key is taken for another's new name though others could be meant.
ALIKE = 0.5


def inferred_renames(old: dict, new: dict) -> list[tuple[str, str]]:
    """Pairs of what went away and what came that are one field under two names, at least one of them unknown (with ?).

    Both have the same type, as far as it is told; the most alike names are paired first; of what is left, the only one
    that went and the only one that came of a type are a pair, however they are called."""
    lost, gained = [f for f in old if f not in new], [f for f in new if f not in old]
    fits = lambda a, b: old[a][1] == new[b][1] or None in (old[a][1], new[b][1])
    alike = lambda a, b: SequenceMatcher(None, *(re.sub(r"[^a-z0-9]", "", x.lower()) for x in (a, b)), autojunk=False).ratio()
    pairs = sorted(((-alike(a, b), a, b) for a in lost for b in gained if "?" in (a[0], b[0]) and fits(a, b)))
    out = []
    for likeness, a, b in pairs:
        if -likeness >= ALIKE and a in lost and b in gained:
            out.append((a, b))
            lost.remove(a)
            gained.remove(b)
    for kind in (WHOLE, DECIMAL, TEXT, OTHER):
        went, came = [f for f in lost if old[f][1] == kind], [f for f in gained if new[f][1] == kind]
        if len(went) == len(came) == 1 and "?" in (went[0][0], came[0][0]):
            out.append((went[0], came[0]))
    return out


def changes(old: dict, new: dict) -> list[tuple[str, str, str | None, str | None]]:
    """Field, kind of change, what was, what is."""
    say = lambda x: "+".join(sorted(x[0])) if x else None
    out = [(f.lstrip("?"), "removed", say(old[f]), None) for f in old if f not in new]
    out += [(f.lstrip("?"), "added", None, say(new[f])) for f in new if f not in old]
    for f in new.keys() & old.keys():
        if old[f][0] != new[f][0]:
            out.append((f.lstrip("?"), "renamed", say(old[f]), say(new[f])))
        if old[f][1] and new[f][1] and old[f][1] != new[f][1]:
            out.append((f.lstrip("?"), "retyped", old[f][1], new[f][1]))
    return sorted(out)


def _in_order() -> list:
    """Files of a producer by file_seq, then file_id."""
    return ["producer", F.asc_nulls_first("file_seq"), "file_id"]


class _Inferred(Scan):
    """State: the producer and schema of the file before. Gives out names that one file has for what the one before it called otherwise."""

    schema = "producer string, file_seq long, name string, other string"

    def step(self, state, batch):
        out = []
        for row in batch.to_pylist():
            now = resolve(row["keys"])
            if state is not None and state[0] == row["producer"]:
                for a, b in inferred_renames(state[1], now):
                    out.append({"producer": row["producer"], "file_seq": row["file_seq"], "name": b if b[0] == "?" else a, "other": a if b[0] == "?" else b})
            state = row["producer"], now
        return state, pa.RecordBatch.from_pylist(out, _LINKS)


_LINKS = pa.schema([("producer", pa.string()), ("file_seq", pa.int64()), ("name", pa.string()), ("other", pa.string())])


def _aliases(table: pa.Table) -> pa.Table:
    """Of one producer's links between names, the unknown keys that come down to a field, by the earliest link of each."""
    links: dict[str, list[str]] = {}
    for row in sorted(table.to_pylist(), key=lambda r: (r["file_seq"] is None, r["file_seq"], r["name"], r["other"])):
        links.setdefault(row["name"], []).append(row["other"])
        if row["other"][0] == "?":
            links.setdefault(row["other"], []).append(row["name"])
    known: dict[str, str] = {}
    for name in links:
        queue, met = [name], {name}
        while queue and name not in known:
            for other in links.get(queue.pop(0), ()):
                if other[0] != "?":
                    known[name] = other
                    break
                if other not in met:
                    met.add(other)
                    queue.append(other)
    pairs = sorted((name[1:], field) for name, field in known.items())
    return pa.table({"of": table["producer"][:1], "aliases": pa.array([pairs], pa.map_(pa.string(), pa.string()))})


def learnt_names(files: DataFrame) -> DataFrame:
    """of (a producer) and aliases, its unknown keys and the fields that they were found to hold. Names are few, however many files."""
    links = ordered_scan(files, _in_order(), _Inferred()).groupBy("producer", "name", "other").agg(F.min("file_seq").alias("file_seq"))
    return links.select("producer", "file_seq", "name", "other").groupBy("producer").applyInArrow(_aliases, "of string, aliases map<string,string>")


def _with_names(exports: DataFrame) -> DataFrame:
    """Files with their keys and the names learnt of their producer."""
    files = checkpoint(file_schemas(exports))
    names = broadcast_if_small(checkpoint(learnt_names(files)), 20_000)
    return files.join(names, F.col("producer").eqNullSafe(F.col("of")), "left").drop("of")


class _Versions(Scan):
    """State: the producer and schema of the file before. Gives out the changes of each file."""

    schema = "file_id long, producer string, file_seq long, fingerprint string, field_name string, change_kind string, was string, now string"

    def step(self, state, batch):
        out = []
        for row in batch.to_pylist():
            now = resolve(row["keys"], dict(row["aliases"] or ()))
            base = {"file_id": row["file_id"], "producer": row["producer"], "file_seq": row["file_seq"], "fingerprint": fingerprint(now)}
            if state is None or state[0] != row["producer"]:
                out.append(base | {"change_kind": "first"})
            else:
                out += [base | dict(zip(("field_name", "change_kind", "was", "now"), c, strict=True)) for c in changes(state[1], now)]
            state = row["producer"], now
        return state, pa.RecordBatch.from_pylist(out, _CHANGES)


_CHANGES = pa.schema([("file_id", pa.int64()), ("producer", pa.string()), ("file_seq", pa.int64()), ("fingerprint", pa.string()), *((x, pa.string()) for x in ("field_name", "change_kind", "was", "now"))])


def schema_changes(exports: DataFrame) -> DataFrame:
    """Every change of a file's schema against the producer's file before (by file_seq, then file_id), and one row of
    change_kind 'first' for each producer's first file. Null payloads and those that can't be read (a key that stands twice in an
    object is among the reasons) say nothing; a file with none that can be read has no fields. A null producer is one producer."""
    return ordered_scan(_with_names(exports), _in_order(), _Versions())


def found_changes(exports: DataFrame) -> DataFrame:
    return schema_changes(exports).filter("change_kind <> 'first'").select("file_id", "field_name", "change_kind")


_STEP = pa.struct([("field", pa.string()), ("action", pa.string()), ("paths", pa.list_(pa.string())), ("kind", pa.string())])
_REST = pa.list_(pa.struct([("name", pa.string()), ("path", pa.string())]))
_MIGRATION = pa.schema([("producer", pa.string()), ("file_seq", pa.int64()), ("file_id", pa.int64()), ("fingerprint", pa.string()), ("steps", pa.list_(_STEP)), ("paths", pa.map_(pa.string(), pa.list_(pa.string()))), ("rest", _REST)])
_EXPECTED = {"string": TEXT, "long": WHOLE, "int": WHOLE, "short": WHOLE, "float": DECIMAL, "boolean": OTHER}


def migration(keys: list[dict], aliases: dict[str, str]) -> dict:
    """Fingerprint, steps, paths of each field, and the keys of none, of a file with these keys.

    A field's keys are tried from the last one on; steps: rename for a field under another key, cast for one of another type, default for
    one that isn't there, keep for the others."""
    schema = resolve(keys, aliases)
    places = {k["path"]: k["json_path"] for k in keys}
    steps, paths = [], {}
    for field, type_ in FIELDS.items():
        if field not in schema:
            steps.append({"field": field, "action": "default", "paths": [], "kind": None})
            continue
        found, kind = schema[field]
        paths[field] = [places[p] for p in sorted(found)]
        actions = [*(["rename"] if found != {field} else []), *(["cast"] if kind not in (None, _EXPECTED[type_]) else [])] or ["keep"]
        steps += [{"field": field, "action": a, "paths": sorted(found), "kind": kind} for a in actions]
    rest = [{"name": p, "path": places[p]} for name, (found, _) in sorted(schema.items()) if name[0] == "?" for p in sorted(found)]
    return {"fingerprint": fingerprint(schema), "steps": steps, "paths": list(paths.items()), "rest": rest}


def migrations(exports: DataFrame) -> DataFrame:
    """The version and the migration of each file: producer, file_seq, file_id, fingerprint, steps, paths, rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{c: row[c] for c in ("producer", "file_seq", "file_id")} | migration(row["keys"], dict(row["aliases"] or ())) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, _MIGRATION)

    schema = "producer string, file_seq long, file_id long, fingerprint string, steps array<struct<field:string,action:string,paths:array<string>,kind:string>>, paths map<string,array<string>>, rest array<struct<name:string,path:string>>"
    return _with_names(exports).mapInArrow(run, schema)


def registry(exports: DataFrame) -> DataFrame:
    """The versions of each producer: since (the first file_seq that has it), fingerprint, the number of its files, and the steps that
    bring its records into the consistent table."""
    versions = migrations(exports).groupBy("producer", "fingerprint").agg(F.min("file_seq").alias("since"), F.count(F.lit(1)).alias("n_files"), F.min_by("steps", F.struct("file_seq", "file_id")).alias("steps"))
    return versions.select("producer", "since", "fingerprint", "n_files", "steps")


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def cast_rule(text: Column, kind: str) -> Column:
    """The text of a value cast to a field's type, null if it can't be. Whole numbers may be written with a point or an exponent;
    a field of true and false takes these words alone."""
    if kind == "string":
        return text
    if kind == "boolean":
        word = F.lower(F.trim(text))
        return F.when(word == "true", True).when(word == "false", False)
    number = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    if kind == "float":
        return F.when(F.lower(F.trim(text)) == "nan", F.lit(float("nan"))).otherwise(number).cast("float")
    exact = F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long"))
    rounded = F.when((number == F.floor(number)) & (F.abs(number) < 2.0**63), number.try_cast("long"))
    return F.coalesce(exact, rounded).try_cast(kind)


def consistent_table(exports: DataFrame) -> DataFrame:
    """Every record in the types of FIELDS: keys renamed, what is missing null, values cast, as the steps of its file's version say.

    A payload that can't be read gives a row of nulls with readable false; values that can't be cast become null and
    their fields are named in uncast; keys of no known field stay, as JSON, in extra. Where a record holds a field under several keys of
    its file, the last one (by name) that isn't null counts. A number for end_reason is its code."""
    file = ("producer", "file_seq", "file_id")
    plans = checkpoint(migrations(exports).select(*[F.col(c).alias(f"of_{c}") for c in file], "paths", "rest"))
    rows = parsed(exports).select("rec_id", *file, "v", F.col("shape").isNotNull().alias("readable"))
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in file]
    routed = rows.join(broadcast_if_small(plans, 20_000), same[0] & same[1] & same[2], "left")
    text, out, failed = {}, {}, []
    for field, kind in FIELDS.items():
        paths = F.col("paths")[field]
        many = F.element_at(F.filter(F.transform(paths, lambda p: F.try_variant_get("v", p, "string")), lambda x: x.isNotNull()), -1)
        raw = F.when(F.size(paths) == 1, F.try_variant_get("v", F.try_element_at(paths, F.lit(1)), "string")).when(F.size(paths) > 1, F.when(F.exists(paths, lambda p: F.try_variant_get("v", p, "string").isNotNull()), many))
        if field == "end_reason":
            coded = F.exists(paths, lambda p: F.schema_of_variant(F.try_variant_get("v", p, "variant")) == "BIGINT")
            code = F.when(coded, raw.try_cast("int"))
            names = F.array(*map(F.lit, END_REASONS))
            raw = F.when((code >= 0) & (code < len(END_REASONS)), F.try_element_at(names, code + 1)).otherwise(raw)
        text[field] = raw.alias(f"t_{field}")
        out[field] = cast_rule(F.col(f"t_{field}"), kind).alias(field)
        failed.append(F.when(F.col(f"t_{field}").isNotNull() & cast_rule(F.col(f"t_{field}"), kind).isNull(), F.lit(field)))
    more = F.filter(F.transform("rest", lambda r: F.struct(r["name"], F.try_variant_get("v", r["path"], "variant").alias("value"))), lambda x: x["value"].isNotNull())
    read = routed.select("rec_id", "file_id", "readable", *text.values(), F.when(F.size(more) > 0, F.to_json(F.map_from_entries(more))).alias("extra"))
    return read.select("rec_id", "file_id", "readable", *out.values(), F.array_compact(F.array(*failed)).alias("uncast"), "extra")
