"""Read ids: 16 bytes in tables, 8-4-4-4-12 hex digits in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the stricter form that mapping files must have.
STRICT = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def dashed(digits: Column) -> Column:
    """32 hex digits as 8-4-4-4-12."""
    return F.concat_ws("-", *[F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def uuid_str(raw: Column | str) -> Column:
    """Canonical text of 16 bytes; null for null and for any other length."""
    raw = F.col(raw) if isinstance(raw, str) else raw
    return F.when(F.length(raw) == 16, dashed(F.lower(F.hex(raw))))


def uuid_bin(text: Column | str) -> Column:
    """16 bytes of an id in any case, with hyphens anywhere or nowhere and perhaps in one pair of braces; null if it is none."""
    text = F.col(text) if isinstance(text, str) else text
    inner = F.when(text.rlike(r"^\{.*\}$"), F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    digits = F.regexp_replace(inner, "-", "")
    return F.when(digits.rlike("^[0-9A-Fa-f]{32}$"), F.unhex(digits))


def canonical(text: Column | str) -> Column:
    """An id written as text in its canonical form, as uuid_str(uuid_bin(text)) gives it, without leaving the text."""
    text = F.trim(F.col(text) if isinstance(text, str) else text)
    digits = F.regexp_replace(F.regexp_extract(text, r"^\{?([0-9A-Fa-f-]*)\}?$", 1), "-", "")
    braces = F.startswith(text, F.lit("{")) == F.endswith(text, F.lit("}"))
    return F.when(braces & (F.length(digits) == 32), F.lower(F.regexp_replace(digits, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")))


def is_strict_uuid(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.rlike(STRICT), F.lit(False))
