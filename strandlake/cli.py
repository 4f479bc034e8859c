"""Command line: python -m strandlake.cli COMMAND ..."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.ids import is_strict_uuid, uuid_bin, uuid_str
from .functions.records import fixed, printed
from .operators import aggregate, merge, route, select, view
from .session import local_session
from .sources import mapping, recovery
from .sources.container import ReadStore, write
from .sources.discovery import existing, listed


def _store(spark: SparkSession, args: argparse.Namespace, bad_files: str = "fail") -> ReadStore:
    return ReadStore(spark, existing(args.inputs, args.recursive), bad_files=bad_files)


def _writable(path: str, force: bool, inputs: list[str] = ()) -> str:
    if any(os.path.realpath(path) == os.path.realpath(i) for i in inputs):
        raise FileExistsError(f"{path} is an input")
    if os.path.exists(path) and not force:
        raise FileExistsError(f"{path} exists; use --force-overwrite")
    return path


def _print(rows: DataFrame, separator: str = "\t", header: bool = True) -> None:
    if header:
        print(separator.join(rows.columns))
    texts = rows.select(*[printed(c, 8).alias(c) if kind in ("float", "double") else F.col(c).cast("string").alias(c) for c, kind in rows.dtypes])
    for row in texts.toLocalIterator():
        print(separator.join("" if x is None else x for x in row))


def do_view(spark, args) -> None:
    if args.list_fields:
        _print(view.list_fields(spark))
        return
    out = _store(spark, args).view(include=args.include, exclude=args.exclude, ids=args.ids)
    if args.output:
        path = os.path.join(args.output, "view.txt") if os.path.isdir(args.output) else args.output
        view.write_view(out, _writable(path, args.force_overwrite), args.separator, not args.no_header, args.force_overwrite)
    else:
        _print(out, args.separator.encode().decode("unicode_escape"), not args.no_header)


def inspected(store: ReadStore) -> DataFrame:
    """Reads with their stored bytes and compression, as text where that is asked for."""
    sizes = store.table("signal", ["_file", "read_id", "samples", "n_bytes"]).groupBy("_file", "read_id").agg(F.sum("n_bytes").alias("byte_count"), F.sum("samples").alias("stored"))
    pair = lambda name: F.concat(F.lit("("), fixed(f"{name}_scaling_scale", 1), F.lit(", "), fixed(f"{name}_scaling_shift", 1), F.lit(")")).alias(f"{name}_scaling")
    rows = store.table("reads").join(sizes, ["_file", "read_id"], "left")
    return rows.select(
        uuid_str("read_id").alias("read_id"), "channel", "well", "pore_type", "read_number", F.col("start").alias("start_sample"), "end_reason", fixed("median_before", 1).alias("median_before"),
        "num_samples", F.coalesce("byte_count", F.lit(0)).alias("byte_count"), fixed(F.try_divide(F.col("byte_count").cast("double"), 2 * F.col("stored")), 3).alias("signal_compression_ratio"),
        "num_minknow_events", pair("tracked"), pair("predicted"), "num_reads_since_mux_change", "time_since_mux_change", "open_pore_level",
    )


def do_inspect(spark, args) -> None:
    for path in existing(args.inputs, args.recursive):
        store = ReadStore(spark, path)
        try:
            if args.what == "summary":
                _print(store.files())
                _print(aggregate.batch_sizes(store.table("reads", ["_batch"])).orderBy("_batch"))
            elif args.what == "reads":
                _print(inspected(store), ",")
            elif args.what == "read":
                if spark.range(1).select(uuid_bin(F.lit(args.read_id))).first()[0] is None:
                    print(f"{args.read_id} is no read id", file=sys.stderr)
                else:
                    _print(select.point_lookup(store.reads(), args.read_id).select(uuid_str("read_id").alias("read_id"), "read_number", "channel", "well", "end_reason", "num_samples", "start", "run_info"))
            else:
                _print(aggregate.debug_summary(store.reads(), store.signal(decode=False), ["_batch"]))
        except Exception as e:
            print(f"{path}: {str(e).splitlines()[0]}", file=sys.stderr)


def _write_one(rows: DataFrame, path: str, force: bool, inputs: list[str]) -> None:
    """One container at path."""
    _writable(path, force, inputs)
    folder, name = os.path.split(os.path.abspath(path))
    write(rows.withColumn("dest", F.lit(name)), folder, overwrite=force)


def do_filter(spark, args) -> None:
    inputs = existing(args.inputs, args.recursive)
    rows = ReadStore(spark, inputs).complete()
    kept = route.filter_ids(rows, mapping.read_id_list(spark, args.ids), args.missing_ok)
    _write_one(kept, args.output, args.force_overwrite, inputs)


def do_subset(spark, args) -> None:
    inputs = existing(args.inputs, args.recursive)
    if args.csv:
        targets = mapping.read_csv_mapping(spark, args.csv)
    else:
        columns = [c for part in args.columns for c in part.split(",") if c]
        # mapping files must have the strict form
        rows = mapping.read_table(spark, args.table, columns, args.read_id_column).filter(is_strict_uuid(args.read_id_column))
        targets = route.mapping_of_table(rows, columns, args.read_id_column, args.template, args.ignore_incomplete_template)
    rows = route.subset(ReadStore(spark, inputs).complete(), targets, args.missing_ok)
    if not args.force_overwrite:
        for (dest,) in targets.select("dest").distinct().toLocalIterator():
            _writable(os.path.join(args.output, dest), False)
    write(rows, args.output, overwrite=args.force_overwrite)


def do_merge(spark, args) -> None:
    inputs = existing(args.inputs, args.recursive)
    rows = merge.merge([ReadStore(spark, inputs).complete()])
    _write_one(rows, args.output, args.force_overwrite, inputs)


def do_repack(spark, args) -> None:
    """Each input copied to a container of the same name; also brings old tables up to date."""
    inputs = existing(args.inputs, args.recursive)
    names = [os.path.basename(p) for p in inputs]
    if len(set(names)) < len(names):
        raise ValueError("inputs have the same name")
    for p in inputs:
        _writable(os.path.join(args.output, os.path.basename(p)), args.force_overwrite, inputs)
    rows = ReadStore(spark, inputs).complete().withColumn("dest", F.element_at(F.split("_file", "/"), -1))
    write(rows, args.output, overwrite=args.force_overwrite)


def do_recover(spark, args) -> None:
    found = recovery.recover(spark, [p for p, _ in listed(args.inputs, args.recursive)], cleanup=args.cleanup)
    _print(found)
    _print(found.agg(*[F.sum(c).alias(c) for c in ("n_reads", "n_signal_rows", "n_run_infos", "n_lost")], F.count(F.when(F.col("errors") != "", 1)).alias("n_errors")))


def do_convert(spark, args) -> None:
    from .sources import legacy

    (legacy.convert if args.what == "fast5" else legacy.convert_back)(spark, existing(args.inputs, args.recursive), args)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandlake")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, output: bool | None = True):
        p = commands.add_parser(name)
        if name == "inspect":
            p.add_argument("what", choices=("summary", "reads", "read", "debug"))
        if name == "convert":
            p.add_argument("what", choices=("fast5", "to_fast5"))
        p.add_argument("inputs", nargs="*" if name == "view" else "+")
        p.add_argument("-r", "--recursive", action="store_true")
        p.add_argument("-f", "--force-overwrite", action="store_true")
        p.add_argument("-t", "--threads", type=int, default=min(4, os.cpu_count() or 1))
        if output is not None:
            p.add_argument("-o", "--output", required=output)
        p.set_defaults(run=run)
        return p

    p = command("view", do_view, False)
    p.add_argument("-H", "--no-header", action="store_true")
    p.add_argument("--separator", default="\\t")
    p.add_argument("-I", "--ids", action="store_true")
    p.add_argument("-i", "--include")
    p.add_argument("-x", "--exclude")
    p.add_argument("-L", "--list-fields", action="store_true")
    p = command("inspect", do_inspect, None)
    p.add_argument("--read-id")
    p = command("filter", do_filter)
    p.add_argument("-i", "--ids", required=True)
    p.add_argument("-M", "--missing-ok", action="store_true")
    p = command("subset", do_subset)
    p.add_argument("--csv")
    p.add_argument("-s", "--summary", "--table", dest="table")
    p.add_argument("-R", "--read-id-column", default="read_id")
    p.add_argument("-c", "--columns", nargs="+", default=[])
    p.add_argument("--template")
    p.add_argument("-T", "--ignore-incomplete-template", action="store_true")
    p.add_argument("-M", "--missing-ok", action="store_true")
    command("merge", do_merge)
    command("repack", do_repack)
    command("update", do_repack)
    command("recover", do_recover, None).add_argument("--cleanup", action="store_true")
    p = command("convert", do_convert)
    p.add_argument("--strict", action="store_true")
    p.add_argument("-O", "--one-to-one")
    p.add_argument("--signal-chunk-size", type=int, default=102_400)
    p.add_argument("--file-read-count", type=int, default=4000)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        args.run(spark or local_session(args.threads), args)
    except Exception as e:
        if os.environ.get("STRANDLAKE_DEBUG"):
            raise
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
