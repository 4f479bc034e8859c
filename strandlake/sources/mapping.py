"""Text files that name reads: lists of ids, mappings to outputs, tables with a row per read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import is_strict_uuid


class EmptyMapping(ValueError):
    """A mapping without a single valid row."""


def _checked(rows: DataFrame, path: str) -> DataFrame:
    if rows.isEmpty():
        raise EmptyMapping(f"{path} names no read")
    return rows


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """read_id: one a line; comments (#), blanks, a header and whatever else is no id are left out, repeated ids too."""
    lines = spark.read.schema("read_id string").csv(path, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return _checked(lines.dropna().filter(is_strict_uuid("read_id")).distinct(), path)


def read_csv_mapping(spark: SparkSession, path: str) -> DataFrame:
    """dest and read_id, without header; rows with nulls and with ids of another form are left out."""
    rows = spark.read.schema("dest string, read_id string").csv(path, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return _checked(rows.dropna().filter(is_strict_uuid("read_id")), path)


def separator_of(line: str) -> str:
    """Tab if a line has at least as many tabs as commas."""
    return "\t" if line.count("\t") >= line.count(",") else ","


def read_table(spark: SparkSession, path: str, columns: list[str], read_id: str = "read_id") -> DataFrame:
    """The named columns of a table with header, as text. KeyError if one isn't there."""
    first = spark.read.text(path).limit(1).collect()
    head = first[0][0] if first else ""
    table = spark.read.csv(path, sep=separator_of(head), header=True, comment="#")
    if lost := [c for c in (read_id, *columns) if c not in table.columns]:
        raise KeyError(f"{path} lacks {lost}; it has {table.columns}")
    return table.select(F.col(read_id), *columns)
