"""Array functions on signals, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples of a chunk unless said otherwise.
CHUNK = 102_400


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def calibrate(signal: Column | str, offset: Column | str, scale: Column | str) -> Column:
    """(sample + offset) * scale in single precision. Null samples stay null."""
    offset, scale = _col(offset).cast("float"), _col(scale).cast("float")
    return F.transform(_col(signal), lambda x: (x.cast("float") + offset) * scale)


def digitisation(adc_max: Column | str, adc_min: Column | str) -> Column:
    return _col(adc_max).cast("int") - _col(adc_min).cast("int") + 1


def calibration_range(scale: Column | str, adc_max: Column | str, adc_min: Column | str) -> Column:
    return _col(scale).cast("double") * digitisation(adc_max, adc_min)


def scale_from_range(adc_range: Column | str, digits: Column | str) -> Column:
    """Null for no digits."""
    return F.try_divide(_col(adc_range).cast("double"), _col(digits))


def signal_length(signal: Column | str) -> Column:
    """Null for null (not -1)."""
    return F.when(_col(signal).isNotNull(), F.size(_col(signal)).cast("long"))


def signal_sum(signal: Column | str) -> Column:
    """Null samples add nothing."""
    return F.aggregate(_col(signal), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x.cast("long"), F.lit(0).cast("long")))


def chunked(signal: Column | str, size: int = CHUNK) -> Column:
    """Slices of at most size samples in order; an empty signal has none."""
    signal = _col(signal)
    count = F.ceil(F.size(signal) / size).cast("int")
    return F.when(signal.isNull(), None).when(F.size(signal) == 0, F.slice(F.array(signal), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(signal, i * size + 1, size)))


def chunk_lengths(signal: Column | str, size: int = CHUNK) -> Column:
    return F.transform(chunked(signal, size), lambda c: F.size(c))


def chunk_at(chunks: Column | str, number: Column | int) -> Column:
    """A chunk by its number from 0; null beyond the last."""
    return F.try_element_at(_col(chunks), (number if isinstance(number, Column) else F.lit(number)) + 1)


def time_axis(signal: Column | str, sample_rate: Column | str) -> Column:
    """Seconds of each sample; null for a null or zero rate, empty for an empty signal."""
    signal, rate = _col(signal), _col(sample_rate)
    axis = F.transform(F.sequence(F.lit(0), F.size(signal) - 1), lambda i: F.try_divide(i.cast("double"), rate))
    return F.when(F.coalesce(rate, F.lit(0)) == 0, None).when(F.size(signal) == 0, F.array().cast("array<double>")).when(signal.isNotNull(), axis)


def vbz_max_size(samples: Column | str) -> Column:
    """Largest size in bytes that so many samples can have when encoded: keys and two bytes each, in the bound of the outer
    compression; null for more than 2**32 - 1 samples."""
    n = _col(samples).cast("long")
    inner = F.shiftright(n + 7, 3) + 2 * n
    small = F.lit(128 << 10)
    bound = inner + F.shiftright(inner, 8) + F.when(inner < small, F.shiftright(small - inner, 11)).otherwise(0)
    return F.when((n >= 0) & (n <= 2**32 - 1), bound.cast("long"))
