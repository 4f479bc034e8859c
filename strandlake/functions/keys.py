"""Column expressions for keys: acquisition keys and read ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def acquisition_key(col: Column | str) -> Column:
    """The bare identifier: lower case, no surrounding blanks or braces; null stays null."""
    return F.lower(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"^[\s{}]+|[\s{}]+$", ""))


def read_key(col: Column | str) -> Column:
    """The 32 hex digits of a read id written as text, whatever its case, braces and hyphens; a text that has not
    32 such digits is left as it is, without surrounding blanks."""
    text = F.trim(F.col(col) if isinstance(col, str) else col)
    digits = F.lower(F.regexp_replace(text, r"[\s{}\-]", ""))
    return F.when(digits.rlike("^[0-9a-f]{32}$"), digits).otherwise(text)
