"""Scalar functions on the fields of reads and run information."""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: End reasons in the order of their numbers, and those that don't count as forced.
END_REASONS = ["unknown", "mux_change", "unblock_mux_change", "data_service_unblock_mux_change", "signal_positive", "signal_negative", "api_request", "device_data_error", "analysis_config_change", "paused"]
NOT_FORCED = ["unknown", "signal_positive", "signal_negative"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def end_reason_code(name: Column | str) -> Column:
    """Number of an end reason; 0 (unknown) for any other text and for null."""
    known = F.create_map(*[F.lit(x) for pair in zip(END_REASONS, range(len(END_REASONS)), strict=True) for x in pair])
    return F.coalesce(F.try_element_at(known, _col(name)), F.lit(0))


def end_reason_name(code: Column | str) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, END_REASONS)), _col(code).cast("int")), F.lit("unknown"))


def forced_by_default(name: Column | str) -> Column:
    return ~F.coalesce(_col(name).isin(NOT_FORCED), F.lit(True))


def end_reason_of_legacy_code(code: Column | str) -> Column:
    """End reasons of the older format: below 2 unknown, else one less."""
    code = _col(code).cast("int")
    return end_reason_name(F.when(code < 2, 0).otherwise(code - 1))


def legacy_code_of_end_reason(name: Column | str) -> Column:
    code = end_reason_code(name)
    return F.when(code == 0, 0).otherwise(code + 1)


def epoch_millis(at: Column | str) -> Column:
    return F.unix_millis(_col(at))


def of_epoch_millis(ms: Column | str) -> Column:
    return F.timestamp_millis(_col(ms).cast("long"))


def lenient_timestamp(text: Column | str) -> Column:
    """ISO 8601 text as a time; 1970-01-01 00:00:00 UTC for null and for what is none."""
    return F.coalesce(_col(text).try_cast("timestamp"), F.timestamp_millis(F.lit(0).cast("long")))


def map_get(entries: Column | str, key: str, default: str = "") -> Column:
    return F.coalesce(F.try_element_at(_col(entries), F.lit(key)), F.lit(default))


def pairs(entries: Column | str) -> Column:
    """Map to array of pairs, sorted by key."""
    return F.array_sort(F.map_entries(_col(entries)))


def of_pairs(entries: Column | str) -> Column:
    """Array of pairs to map; of repeated keys the last wins."""
    listed = _col(entries)
    last = F.filter(listed, lambda x, i: ~F.exists(F.slice(listed, i + 2, F.greatest(F.size(listed), F.lit(1))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def version_parts(text: Column | str) -> Column:
    """A version of exactly three whole numbers as a comparable struct, else null."""
    text = _col(text)
    part = F.split(text, r"\.")
    return F.when(text.rlike(r"^\d{1,9}\.\d{1,9}\.\d{1,9}$"), F.struct(*[F.get(part, F.lit(i)).try_cast("int").alias(n) for i, n in enumerate(("major", "minor", "patch"))]))


def guessed_adc(digits: Column | str) -> Column:
    """adc_min and adc_max guessed from a digitisation, and whether it is that of the wide converter."""
    wide = F.coalesce(_col(digits) == 8192, F.lit(False))
    return F.struct(F.when(wide, -4096).otherwise(0).alias("adc_min"), F.when(wide, 4095).otherwise(2047).alias("adc_max"), wide.alias("wide"))


def fixed(number: Column | str, digits: int) -> Column:
    """A number as text with so many digits behind the point; null for null."""
    number = _col(number).cast("double")
    return F.when(number.isNotNull(), F.format_string(f"%.{digits}f", number))


@cache
def _printing(digits: int):
    form = f"%.{digits}f"

    def run(numbers: pa.Array) -> pa.Array:
        return pa.array([None if x is None else "NaN" if x != x else form % x for x in numbers.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")


def printed(number: Column | str, digits: int) -> Column:
    """A number as text with so many digits behind the point, as printf gives it: of the exact binary value, ties to the even
    digit, where Spark's format_string rounds the shortest decimal number up. NaN, inf and -inf; null for null."""
    return _printing(digits)(_col(number).cast("double"))


def not_set(text: Column | str) -> Column:
    """'not_set' for an empty text; null stays null."""
    text = _col(text)
    return F.when(F.length(text) == 0, "not_set").otherwise(text)


def same_record(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """All fields equal, nulls equal to nulls and NaN to NaN."""
    out = F.lit(True)
    for name in left:
        out = out & left[name].eqNullSafe(right[name])
    return out


def dictionary_index(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Adds name_index, the number of the value among the sorted distinct values, for columns of few values."""
    from ..operators.select import bucketed
    from ..session import broadcast_if_small, checkpoint

    for name in names:
        values = checkpoint(bucketed(df.select(F.col(name).alias("_v")).dropna().distinct(), 1, ["_v"]).select("_v", F.col("position").alias(f"{name}_index")))
        df = df.join(broadcast_if_small(values), F.col(name) == F.col("_v"), "left").drop("_v")
    return df
