"""Sending reads to one or many outputs by a mapping."""

from __future__ import annotations

from functools import reduce
from operator import and_
from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import canonical, uuid_bin
from ..session import broadcast_if_small, checkpoint, repartitioned
from .merge import DuplicateReads
from .select import MissingReads

#: What output names end in unless a template says otherwise.
EXTENSION = ".container"


def default_template(columns: list[str]) -> str:
    return "_".join(f"{c}-{{{c}}}" for c in columns) + EXTENSION


def template_keys(template: str, columns: list[str], unused_ok: bool = False) -> list[str]:
    """Keys of a template such as "{a}_{b}"; positional ones count through the columns. KeyError for a key that is no column,
    and for columns that aren't used, unless unused_ok."""
    keys, free = [], iter(columns)
    for _, field, _, _ in Formatter().parse(template):
        if field is None:
            continue
        name = next(free, None) if field == "" else columns[int(field)] if field.isdigit() and int(field) < len(columns) else field
        if name not in columns:
            raise KeyError(f"the template's key {field!r} is none of {columns}")
        keys.append(name)
    if (unused := [c for c in columns if c not in keys]) and not unused_ok:
        raise KeyError(f"columns that the template leaves out: {unused}")
    return keys


def templated(template: str, columns: list[str], unused_ok: bool = False) -> Column:
    """The template filled with a row's values; null if one of them is null."""
    keys = iter(template_keys(template, columns, unused_ok))
    parts: list[Column] = []
    for text, field, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if field is not None:
            parts.append(F.col(next(keys)).cast("string"))
    return F.concat(*parts)


def mapping_of_table(table: DataFrame, columns: list[str], read_id: str = "read_id", template: str | None = None, unused_ok: bool = False) -> DataFrame:
    """read_id (text) and dest from a table with a row per read. Ids are told by their 32 hex digits and given out in the
    canonical form; rows with nulls and with what is no id are dropped."""
    named = table.select(canonical(read_id).alias("_id"), *columns).dropna()
    return named.select(F.col("_id").alias("read_id"), templated(template or default_template(columns), columns, unused_ok).alias("dest"))


def subset(reads: DataFrame, mapping: DataFrame, missing_ok: bool = False, key: str = "read_id", check: bool = True) -> DataFrame:
    """reads with dest, a row for each output that mapping(read_id as text or bytes, dest) sends it to.

    Repeated pairs of the mapping count once. Ids of the mapping that no read has raise MissingReads unless missing_ok; an id
    that would stand twice in one output raises DuplicateReads, as reads hold it twice."""
    pairs = mapping.select((uuid_bin("read_id") if dict(mapping.dtypes)["read_id"] == "string" and dict(reads.dtypes)[key] == "binary" else F.col("read_id")).alias("_id"), "dest").dropna()
    pairs = checkpoint(pairs.distinct())
    if not missing_ok:
        lost = pairs.select("_id").distinct().join(reads.select(F.col(key).alias("_id")).distinct(), "_id", "left_anti").count()
        if lost:
            raise MissingReads(f"{lost} reads of the mapping were not found")
    side = broadcast_if_small(pairs)
    out = reads.join(side, reads[key] == side["_id"]).drop("_id")
    if check and (bad := out.groupBy("dest", key).count().filter("count > 1").limit(3).collect()):
        raise DuplicateReads(f"reads twice in one output: {bad}")
    return out


def filter_ids(reads: DataFrame, ids: DataFrame, missing_ok: bool = False, key: str = "read_id") -> DataFrame:
    """Reads whose id is in the first column of ids (text or bytes, as the reads have it)."""
    column = ids.columns[0]
    wanted = ids.select((uuid_bin(column) if dict(ids.dtypes)[column] == "string" and dict(reads.dtypes)[key] == "binary" else F.col(column)).alias(key)).dropna().distinct()
    wanted = checkpoint(wanted)
    if not missing_ok and (lost := wanted.join(reads.select(key).distinct(), key, "left_anti").count()):
        raise MissingReads(f"{lost} reads were not found")
    return reads.join(broadcast_if_small(wanted), key, "left_semi")


#: Reads in one container; an output with more is written as several.
READS_A_FILE = 400_000


def routed_for_writing(routed: DataFrame, reads_a_file: int = READS_A_FILE, order: list[str] | None = None) -> DataFrame:
    """One output in one partition and after the other, so a task holds one open file at a time.

    order names where rows stood, in files, their batches and places in these: an output then holds its rows in that order.
    An output of more than reads_a_file rows becomes as many containers as it fills, numbered before the extension
    (x.container: x-00000.container and so on), so that no output is written by one task however large it is."""
    sizes = checkpoint(routed.groupBy("dest").agg(F.count(F.lit(1)).alias("_n"))).select(F.col("dest").alias("_dest"), F.ceil(F.col("_n") / reads_a_file).cast("int").alias("_of"))
    large = sizes.filter("_of > 1")
    if not large.isEmpty():
        split = routed.join(broadcast_if_small(large), F.col("dest").eqNullSafe(F.col("_dest")), "left")
        if order:
            # a place in the output: the rows of the batches before it, few counts each, and those before it in its own batch
            batch = ["dest", *order[:-1]]
            counts = routed.groupBy(*batch).agg(F.count(F.lit(1)).alias("_k"))
            before = F.sum("_k").over(Window.partitionBy("dest").orderBy(*order[:-1])) - F.col("_k")
            begins = checkpoint(counts.select(*[F.col(c).alias(f"_b{k}") for k, c in enumerate(batch)], before.alias("_before")))
            same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(batch)])
            split = split.withColumn("_in", F.row_number().over(Window.partitionBy(*batch).orderBy(order[-1])) - 1)
            split = split.join(broadcast_if_small(begins), same).drop(*[f"_b{k}" for k in range(len(batch))])
            part = F.floor((F.col("_before") + F.col("_in")) / reads_a_file).cast("long")
        else:
            part = F.pmod(F.monotonically_increasing_id(), F.col("_of"))
        number = F.format_string("-%05d", part)
        stem, ending = F.regexp_extract("dest", r"^(.*?)(\.[^./]*)?$", 1), F.regexp_extract("dest", r"^(.*?)(\.[^./]*)?$", 2)
        routed = split.withColumn("dest", F.when(F.col("_of").isNull(), F.col("dest")).otherwise(F.concat(stem, number, ending))).drop("_dest", "_of", "_in", "_before")
    return repartitioned(routed, "dest").sortWithinPartitions("dest", *(order or []))
