"""The signal codec: differences, zigzag, one or two bytes by a key bit, zstd around it; and its Spark functions."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Level of the outer compression.
LEVEL = 1
MAX_SAMPLES = 2**32 - 1


class CorruptSignal(ValueError):
    """Bytes that no signal of the stated length encodes to."""


def encode(samples: np.ndarray) -> bytes:
    """Encodes int16 samples; none give an empty frame."""
    x = np.ascontiguousarray(samples, np.int16)
    if len(x) > MAX_SAMPLES:
        raise ValueError(f"{len(x)} samples are too many")
    step = np.diff(x.view(np.uint16), prepend=np.uint16(0)).astype(np.uint16)
    value = ((step << np.uint16(1)) ^ (step.view(np.int16) >> 15).view(np.uint16)).astype("<u2")
    wide = value > 255
    keys = np.packbits(wide, bitorder="little").tobytes()
    both = value.view(np.uint8).reshape(-1, 2)
    keep = np.ones_like(both, bool)
    keep[:, 1] = wide
    return zstandard.ZstdCompressor(level=LEVEL).compress(keys + both[keep].tobytes())


def decode(packed: bytes, count: int) -> np.ndarray:
    """The samples; raises CorruptSignal unless the bytes are exactly those of count samples."""
    if not 0 <= count <= MAX_SAMPLES:
        raise CorruptSignal(f"{count} samples")
    n_keys = (count + 7) // 8
    try:
        size = zstandard.frame_content_size(packed)
        if size < 0 or not n_keys + count <= size <= n_keys + 2 * count:
            raise CorruptSignal(f"{size} bytes can't hold {count} samples")
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=n_keys + 2 * count, allow_extra_data=False)
    except zstandard.ZstdError as e:
        raise CorruptSignal(str(e)) from None
    if len(raw) != size:
        raise CorruptSignal("the frame ends early")
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, n_keys), bitorder="little")
    wide = bits[:count].astype(bool)
    if bits[count:].any():
        raise CorruptSignal("keys beyond the last sample")
    data = np.frombuffer(raw, np.uint8, offset=n_keys)
    if len(data) != count + int(wide.sum()):
        raise CorruptSignal("data doesn't fit its keys")
    at = np.cumsum(1 + wide) - 1 - wide
    value = data[at].astype(np.uint16)
    value[wide] |= data[at[wide] + 1].astype(np.uint16) << np.uint16(8)
    step = (value >> np.uint16(1)) ^ (np.uint16(0) - (value & np.uint16(1)))
    return np.cumsum(step, dtype=np.uint16).view(np.int16)


def decode_chunks(packed: list[bytes], counts: list[int]) -> np.ndarray:
    """One signal of its chunks in order; as many counts as chunks, none give an empty signal."""
    if len(packed) != len(counts):
        raise ValueError(f"{len(packed)} chunks and {len(counts)} counts")
    return np.concatenate([decode(p, n) for p, n in zip(packed, counts, strict=True)]) if packed else np.zeros(0, np.int16)


def encode_chunks(samples: np.ndarray, size: int) -> tuple[list[bytes], list[int]]:
    parts = [samples[i : i + size] for i in range(0, len(samples), size)]
    return [encode(p) for p in parts], [len(p) for p in parts]


#: Samples of many chunks that are worked on at once.
SLICE = 4_000_000


def _slices(counts: np.ndarray) -> list[tuple[int, int]]:
    """Runs of chunks of about SLICE samples, at least one chunk each."""
    group = np.cumsum(counts) // SLICE
    cuts = np.flatnonzero(np.diff(group)) + 1
    return list(zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(counts)].tolist(), strict=True)) if len(counts) else []


def _encode_many(flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """encode() of consecutive chunks of flat, their bytes made together."""
    chunk = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    place = np.arange(len(flat)) - begin[chunk]
    step = np.diff(flat.view(np.uint16), prepend=np.uint16(0)).astype(np.uint16)
    heads = begin[counts > 0]
    step[heads] = flat.view(np.uint16)[heads]
    value = ((step << np.uint16(1)) ^ (step.view(np.int16) >> 15).view(np.uint16)).astype("<u2")
    wide = value > 255
    n_keys = (counts + 7) // 8
    key_at = np.cumsum(n_keys) - n_keys
    bits = np.zeros(int(n_keys.sum()) * 8, bool)
    bits[key_at[chunk] * 8 + place] = wide
    keys = np.packbits(bits, bitorder="little").tobytes()
    both = value.view(np.uint8).reshape(-1, 2)
    keep = np.ones_like(both, bool)
    keep[:, 1] = wide
    data = both[keep].tobytes()
    so_far = np.r_[0, np.cumsum(1 + wide)]
    cuts = so_far[np.r_[begin, len(flat)]].tolist()
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    return [compress(keys[k : k + n] + data[cuts[i] : cuts[i + 1]]) for i, (k, n) in enumerate(zip(key_at.tolist(), n_keys.tolist(), strict=True))]


def encode_array(signal: pa.Array) -> pa.Array:
    """List of int16 to binary, null to null."""
    counts = np.asarray(signal.value_lengths().fill_null(0)).astype(np.int64)
    flat = np.ascontiguousarray(np.asarray(signal.flatten().cast(pa.int16())), np.int16)
    begin = np.cumsum(counts) - counts
    out: list[bytes | None] = []
    for lo, hi in _slices(counts):
        first = int(begin[lo])
        out += _encode_many(flat[first : first + int(counts[lo:hi].sum())], counts[lo:hi])
    return pa.array([x if ok else None for x, ok in zip(out, np.asarray(signal.is_valid()).tolist(), strict=True)], pa.binary())


def _decode_many(packed: list[bytes], counts: np.ndarray) -> np.ndarray:
    """decode() of many chunks one behind the other, with the same checks."""
    decompress = zstandard.ZstdDecompressor().decompress
    raws = []
    for data, n in zip(packed, counts.tolist(), strict=True):
        if not 0 <= n <= MAX_SAMPLES:
            raise CorruptSignal(f"{n} samples")
        least = (n + 7) // 8 + n
        try:
            size = zstandard.frame_content_size(data)
            if size < 0 or not least <= size <= least + n:
                raise CorruptSignal(f"{size} bytes can't hold {n} samples")
            raws.append(decompress(data, max_output_size=least + n, allow_extra_data=False))
        except zstandard.ZstdError as e:
            raise CorruptSignal(str(e)) from None
        if len(raws[-1]) != size:
            raise CorruptSignal("the frame ends early")
    sizes = np.array([len(r) for r in raws], np.int64)
    raw = np.frombuffer(b"".join([*raws, b"\0"]), np.uint8)
    raw_at = np.cumsum(sizes) - sizes
    chunk = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    place = np.arange(int(counts.sum())) - begin[chunk]
    wide = (raw[raw_at[chunk] + (place >> 3)] >> (place & 7).astype(np.uint8) & 1).astype(bool)
    n_keys = (counts + 7) // 8
    odd = (counts & 7) > 0
    if (raw[(raw_at + n_keys - 1)[odd]] >> (counts[odd] & 7).astype(np.uint8)).any():
        raise CorruptSignal("keys beyond the last sample")
    so_far = np.r_[0, np.cumsum(wide)]
    wides = so_far[begin + counts] - so_far[begin]
    if (sizes != n_keys + counts + wides).any():
        raise CorruptSignal("data doesn't fit its keys")
    at = (raw_at + n_keys - so_far[begin])[chunk] + place + so_far[:-1]
    value = raw[at].astype(np.uint16)
    value |= np.where(wide, raw[at + 1], 0).astype(np.uint16) << np.uint16(8)
    step = (value >> np.uint16(1)) ^ (np.uint16(0) - (value & np.uint16(1)))
    total = np.r_[np.uint16(0), np.cumsum(step, dtype=np.uint16)]
    return (total[1:] - total[begin][chunk]).astype(np.uint16).view(np.int16)


def decode_array(packed: pa.Array, counts: pa.Array) -> pa.Array:
    """Binary and counts to lists of int16; null where either is."""
    valid = np.asarray(packed.is_valid()) & np.asarray(counts.is_valid())
    data = [p for p, ok in zip(packed.to_pylist(), valid.tolist(), strict=True) if ok]
    sizes = np.where(valid, np.asarray(counts.cast(pa.int64()).fill_null(0)), 0)
    own = sizes[valid]
    parts = [_decode_many(data[lo:hi], own[lo:hi]) for lo, hi in _slices(np.maximum(own, 0))]
    values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int16), pa.int16())
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), values, mask=pa.array(~valid))


@cache
def _functions() -> tuple:
    """Made once, when a session is there."""

    def pack(signal: pa.Array) -> pa.Array:
        return encode_array(signal)

    def unpack(packed: pa.Array, counts: pa.Array) -> pa.Array:
        return decode_array(packed, counts)

    return F.arrow_udf(pack, "binary"), F.arrow_udf(unpack, "array<smallint>")


def vbz_encode(signal: Column | str) -> Column:
    return _functions()[0](signal)


def vbz_decode(packed: Column | str, samples: Column | str) -> Column:
    return _functions()[1](packed, samples)


def register(spark: SparkSession) -> None:
    """vbz_encode and vbz_decode, uuid_str and uuid_bin for SQL."""
    spark.udf.register("vbz_encode", _functions()[0])
    spark.udf.register("vbz_decode", _functions()[1])
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION uuid_str(b BINARY) RETURNS STRING RETURN CASE WHEN length(b) = 16 THEN regexp_replace(lower(hex(b)), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '$1-$2-$3-$4-$5') END")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION uuid_bin(t STRING) RETURNS BINARY RETURN CASE WHEN regexp_replace(regexp_replace(t, '^[{](.*)[}]$', '$1'), '-', '') RLIKE '^[0-9A-Fa-f]{32}$' THEN unhex(regexp_replace(regexp_replace(t, '^[{](.*)[}]$', '$1'), '-', '')) END")
