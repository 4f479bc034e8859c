import datetime as dt

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from strandlake import codec
from strandlake.functions import ids, keys, records
from strandlake.functions import signal as sig

ID = "0000173c-bf67-44e7-9a9c-1ad0bc728e74"


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return list(row)


def test_ids(spark):
    texts = [ID, ID.upper(), "{" + ID + "}", ID.replace("-", ""), "{" + ID, ID + "0", ID[:-1] + "g", "", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ids.uuid_str(ids.uuid_bin("t"))).collect()]
    assert got == [ID] * 4 + [None] * 5
    strict = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(ids.is_strict_uuid("t")).collect()]
    assert strict == [True] + [False] * 8
    assert one(spark, ids.uuid_str(F.unhex(F.lit("00")))) == [None]
    assert one(spark, keys.acquisition_key(F.lit(" {AbC}\t")), keys.read_key(F.lit("{" + ID.upper() + "}")), keys.read_key(F.lit(" odd "))) == ["abc", ID.replace("-", ""), "odd"]


def test_signal_functions(spark):
    s = F.array(*[F.lit(x).cast("smallint") for x in (1, 2, 3, 4, 5)])
    none, empty = F.lit(None).cast("array<smallint>"), F.slice(s, 1, 0)
    assert one(spark, sig.chunked(s, 2), sig.chunked(empty, 2), sig.chunked(none, 2)) == [[[1, 2], [3, 4], [5]], [], None]
    assert one(spark, sig.chunk_lengths(s, 2), sig.chunk_at(sig.chunked(s, 2), 2), sig.chunk_at(sig.chunked(s, 2), 3)) == [[2, 2, 1], [5], None]
    assert one(spark, sig.signal_sum(s), sig.signal_sum(empty), sig.signal_sum(none), sig.signal_length(none)) == [15, 0, None, None]
    assert one(spark, sig.time_axis(s, F.lit(2)), sig.time_axis(s, F.lit(0)), sig.time_axis(empty, F.lit(2))) == [[0.0, 0.5, 1.0, 1.5, 2.0], None, []]
    pa_ = one(spark, sig.calibrate(s, F.lit(21), F.lit(0.1755)))[0]
    assert np.allclose(pa_, (np.arange(1, 6, dtype=np.float32) + np.float32(21)) * np.float32(0.1755), rtol=0, atol=0)
    assert one(spark, sig.digitisation(F.lit(4095).cast("smallint"), F.lit(-4096).cast("smallint")), sig.scale_from_range(F.lit(1.0), F.lit(0))) == [8192, None]


def test_record_functions(spark):
    assert one(spark, records.end_reason_code(F.lit("api_request")), records.end_reason_code(F.lit("x")), records.end_reason_code(F.lit(None).cast("string")), records.end_reason_name(F.lit(99))) == [6, 0, 0, "unknown"]
    assert one(spark, *[records.end_reason_of_legacy_code(F.lit(k)) for k in range(7)]) == ["unknown", "unknown", *records.END_REASONS[1:6]]
    assert one(spark, records.forced_by_default(F.lit("mux_change")), records.forced_by_default(F.lit("signal_positive"))) == [True, False]
    assert one(spark, *[records.version_parts(F.lit(v)) for v in ("10.200.3", "1.2.3.4", "1.2.3-pre", "")])[0] == (10, 200, 3)
    assert one(spark, *[records.version_parts(F.lit(v)) for v in ("1.2.3.4", "1.2.3-pre", "")]) == [None] * 3
    assert one(spark, records.lenient_timestamp(F.lit("2019-05-13T11:11:43Z")), records.lenient_timestamp(F.lit("nonsense"))) == [dt.datetime(2019, 5, 13, 11, 11, 43), dt.datetime(1970, 1, 1)]
    assert one(spark, records.not_set(F.lit("")), records.not_set(F.lit(None).cast("string")), records.fixed(F.lit(1.23456), 3)) == ["not_set", None, "1.235"]
    doubled = F.array(F.struct(F.lit("a").alias("key"), F.lit("1").alias("value")), F.struct(F.lit("a").alias("key"), F.lit("2").alias("value")))
    assert one(spark, records.of_pairs(doubled), records.map_get(records.of_pairs(doubled), "b", "-")) == [{"a": "2"}, "-"]
    nan = F.lit(float("nan"))
    assert one(spark, records.same_record({"a": nan}, {"a": nan}), records.same_record({"a": F.lit(None)}, {"a": F.lit(1)})) == [True, False]
    assert one(spark, records.guessed_adc(F.lit(8192)), records.guessed_adc(F.lit(2048))) == [(-4096, 4095, True), (0, 2047, False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-32768, 32767), max_size=300))
def test_codec_round_trip(samples):
    x = np.array(samples, np.int16)
    packed = codec.encode(x)
    assert (codec.decode(packed, len(x)) == x).all()
    parts, counts = codec.encode_chunks(x, 7)
    assert (codec.decode_chunks(parts, counts) == x).all()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.integers(-32768, 32767), max_size=40)), max_size=12), st.integers(1, 60))
def test_many_chunks_as_one_by_one(chunks, slice_):
    import pyarrow as pa

    codec.SLICE, before = slice_, codec.SLICE
    try:
        packed = codec.encode_array(pa.array(chunks, pa.list_(pa.int16())))
        assert packed.to_pylist() == [None if c is None else codec.encode(np.array(c, np.int16)) for c in chunks]
        back = codec.decode_array(packed, pa.array([None if c is None else len(c) for c in chunks], pa.int64()))
        assert back.to_pylist() == chunks
        for k, c in enumerate(chunks):
            if c:
                with pytest.raises(codec.CorruptSignal):
                    codec.decode_array(packed, pa.array([None if x is None else len(x) + (j == k) * 9 for j, x in enumerate(chunks)], pa.int64()))
    finally:
        codec.SLICE = before


def test_codec_layout():
    """Keys first, a bit a sample from the lowest on, then a byte or two each: 1 -> 2, 300 after it -> 598, -1 after it -> 601."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(codec.encode(np.array([1, 300, -1], np.int16)))
    assert raw == bytes([0b110, 2]) + (598).to_bytes(2, "little") + (601).to_bytes(2, "little")


@pytest.mark.parametrize("count", [0, 999, 1001, -1, 2**33])
def test_codec_refuses_other_counts(count):
    with pytest.raises(codec.CorruptSignal):
        codec.decode(codec.encode(np.arange(1000, dtype=np.int16) * 40), count)


def test_codec_refuses_damage():
    packed = codec.encode(np.arange(1000, dtype=np.int16))
    for bad in (packed[:-3], packed + b"x", b"", b"\0" * 50):
        with pytest.raises(codec.CorruptSignal):
            codec.decode(bad, 1000)
    with pytest.raises(ValueError):
        codec.decode_chunks([packed], [])


def test_codec_in_spark(spark):
    codec.register(spark)
    df = spark.createDataFrame([(1, [1, -5, 32767]), (2, []), (3, None)], "k int, s array<smallint>").repartition(2)
    df.createOrReplaceTempView("signals")
    got = dict(spark.sql("SELECT k, vbz_decode(vbz_encode(s), size(s)) FROM signals WHERE s IS NOT NULL").collect())
    assert got == {1: [1, -5, 32767], 2: []}
    assert df.filter("s IS NULL").select(codec.vbz_encode("s")).first()[0] is None
    assert spark.sql(f"SELECT uuid_str(uuid_bin('{ID.upper()}'))").first()[0] == ID


def test_printed_as_printf_does(spark):
    numbers = [186.923828125, 186.923828145, -302.384765625, 0.001953125, 0.005859375, 123456789.123, 1e30, 5e-9, 1.5e-8, -0.0, -1e-12, 0.0, 1e300, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(numbers)], "k int, x double")
    texts = [r.t for r in df.select("k", records.printed("x", 8).alias("t")).orderBy("k").collect()]
    assert texts[:5] == ["186.92382812", "186.92382814", "-302.38476562", "0.00195312", "0.00585938"]
    assert texts[5:13] == [f"{x:.8f}" for x in numbers[5:13]] and texts[13:] == ["NaN", "inf", "-inf", None]
    assert one(spark, records.printed(F.lit(0.0625), 3), records.printed(F.lit(186.25).cast("float"), 1), records.printed(F.lit(7), 2)) == ["0.062", "186.2", "7.00"]


def test_views_are_written_as_printf_does(spark, tmp_path, capsys):
    from strandlake import cli
    from strandlake.operators import view

    df = spark.createDataFrame([("a", 186.923828125, None)], "name string, level float, none float").coalesce(1)
    view.write_view(df, f"{tmp_path}/v")
    cli._print(df)
    text = "".join(p.read_text() for p in (tmp_path / "v").glob("*.csv"))
    assert text == capsys.readouterr().out == "name\tlevel\tnone\na\t186.92382812\t\n"
