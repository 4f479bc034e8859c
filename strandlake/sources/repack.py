"""Building outputs from parts of inputs, and comparing containers."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.merge import merge
from ..operators.select import select_reads
from .container import ReadStore, write


class Output:
    def __init__(self, path: str, check: bool, options: dict[str, str]):
        self.path, self.check, self.options, self.parts = os.path.abspath(path), check, options, []


class Repacker:
    """Collects what goes to which output; nothing is read or written before finish()."""

    def __init__(self, spark: SparkSession):
        self.spark, self.outputs, self.finished = spark, [], False

    def add_output(self, path: str, check_duplicate_reads: bool = True, **options: str) -> Output:
        """An output file that doesn't exist yet; options are those of the sink."""
        if self.finished:
            raise RuntimeError("already finished")
        if os.path.exists(path):
            raise FileExistsError(path)
        if os.path.abspath(path) in [o.path for o in self.outputs]:
            raise ValueError(f"{path} is an output already")
        self.outputs.append(Output(path, check_duplicate_reads, options))
        return self.outputs[-1]

    def add_all(self, output: Output, store: ReadStore) -> None:
        output.parts.append(store.complete())

    def add_selected(self, output: Output, store: ReadStore, selection: DataFrame) -> None:
        """The reads of a bag of ids (16 bytes); ids that aren't there raise when finished."""
        output.parts.append(select_reads(store.complete(), selection, file=["_file"], order=["_batch", "_row"], strict=True))

    def finish(self) -> dict[str, int]:
        """Writes all outputs; returns the number of reads in each. Outputs of a failed run are removed."""
        done: dict[str, int] = {}
        try:
            for o in self.outputs:
                folder, name = os.path.split(o.path)
                if o.parts:
                    write(merge(o.parts, o.check).withColumn("dest", F.lit(name)), folder, **o.options)
                done[o.path] = ReadStore(self.spark, o.path).num_reads() if os.path.exists(o.path) else 0
        except Exception:
            for o in self.outputs:
                if os.path.exists(o.path):
                    os.remove(o.path)
            raise
        self.finished = True
        return done


def differences(left: ReadStore, right: ReadStore) -> DataFrame:
    """read_id and the names of fields that differ between the reads of two stores, signal and run information among them.

    Reads are matched by id and, where an id repeats, by their number in storage order; a read that only one side has
    differs in 'read'. Nulls equal nulls, and NaN equals NaN. No rows: the stores hold the same."""
    fields = [c for c in left.complete(decode=True).columns if c not in ("read_id", "info", "_file", "_batch", "_row")]

    def side(store: ReadStore, name: str) -> DataFrame:
        rows = store.complete(decode=True)
        info = F.to_json(F.struct(*[F.array_sort(F.map_entries(f"info.{c}")).alias(c) if c in ("context_tags", "tracking_id") else F.col(f"info.{c}").alias(c) for c in rows.schema["info"].dataType.names]))
        flat = rows.select("read_id", F.struct("_file", "_batch", "_row").alias("at"), F.struct(*fields, info.alias("info")).alias(name))
        # the rows of one id are few
        listed = flat.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("at", name))).alias("l"))
        return listed.select("read_id", F.posexplode("l").alias("number", "x")).select("read_id", "number", f"x.{name}")

    both = side(left, "a").join(side(right, "b"), ["read_id", "number"], "full")
    wrong = F.filter(F.array(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in [*fields, "info"]]), lambda x: x.isNotNull())
    out = F.when(F.col("a").isNull() | F.col("b").isNull(), F.array(F.lit("read"))).otherwise(wrong)
    return both.select("read_id", out.alias("fields")).filter(F.size("fields") > 0)
