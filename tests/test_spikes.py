import numpy as np
from conftest import rows
from strandlake.operators import spikes

SIGNAL = "row_no bigint, acquisition_id string, signal array<smallint>, level string"
INFO = "info_id bigint, acquisition_id string, adc_max smallint, adc_min smallint"
READS = "row_id bigint, run_info string, channel int, well smallint, start bigint, read_id binary, median_before float"


def test_chunks(spark):
    rng = np.random.default_rng(5)
    data = []
    for k in range(300):
        v = 500 + rng.integers(-60, 61) * 0 + rng.integers(-50, 51, 90)
        data.append([k, "A" if k % 2 else "b ", v])
    data[10][2][40] = 900  # spike
    data[11][2][5] = -4000  # spike beyond the limits
    data[12][2][20:60] = 510 + rng.integers(0, 2, 40)  # too flat for too long
    data[13][2][20:26] = 510  # short enough
    table = [(k, a, [int(x) for x in v], "x") for k, a, v in data] + [(900, "A", None, "x"), (901, "A", [], "x"), (902, None, [1, 2], "x"), (903, "b", [None, 500], "x")]
    info = [(1, "a", 1000, 0), (2, "b", 1000, 0), (3, "a", 0, 1000), (4, "c", 5, 5), (5, None, None, 3)]
    signal, infos = spark.createDataFrame(table, SIGNAL), spark.createDataFrame(info, INFO)
    got = dict(rows(spikes.odd_chunks(signal, infos)))
    assert set(got) == {10, 11, 12} and got[11] & 2 and got[12] & 4 and not got[10] & 2
    reads = spark.createDataFrame([], READS)
    assert rows(spikes.implausible(signal, reads, infos)) == [("adc", 3), ("adc", 4), ("signal", 10), ("signal", 11), ("signal", 12)]


def test_jumps_that_only_the_differences_show(spark):
    """A slow wave, in which a sample far off its neighbours is still within the range of values."""
    wave = 500 + 300 * np.sin(np.arange(120) / 19)
    rng = np.random.default_rng(8)
    data = [[k, np.round(wave + rng.integers(-4, 5, 120)).astype(int)] for k in range(200)]
    data[20][1][30] -= 250  # at the crest
    data[21][1][60] += 900  # out of range
    table = [(k, "a", [int(x) for x in v], "x") for k, v in data]
    signal, infos = spark.createDataFrame(table, SIGNAL), spark.createDataFrame([], INFO)
    assert rows(spikes.odd_chunks(signal, infos)) == [(20, 1), (21, 1)]
    (axes,) = spikes.signal_axes(signal.selectExpr("row_no", "lower(acquisition_id) AS acquisition_id", "signal")).collect()
    v = np.array(data[20][1])
    assert np.abs(v - axes.level).max() < axes.a  # the value's axis alone doesn't
    assert (data[21][1].max() - axes.level) > axes.a


def test_axes_are_those_of_the_points_inside(spark):
    """Against a plain iteration over all points of a source."""
    rng = np.random.default_rng(9)
    chunks = [rng.integers(-200, 201, 80) for _ in range(150)]
    for k in range(0, 150, 6):
        chunks[k][rng.integers(3, 77)] += 3000 if k % 4 else 700
    signal = spark.createDataFrame([(k, "a", [int(x) for x in v], "x") for k, v in enumerate(chunks)], SIGNAL)
    (got,) = spikes.signal_axes(signal.select("row_no", "acquisition_id", "signal")).collect()
    v, d1, d2, inner, twice = ([] for _ in range(5))
    for c in chunks:
        v.append(c)
        d1.append(np.r_[0, np.diff(c)])
        d2.append(np.r_[0, 0, np.diff(c, 2)])
        inner.append(np.arange(80) > 0)
        twice.append(np.arange(80) > 1)
    v, d1, d2, inner, twice = (np.concatenate(x) for x in (v, d1, d2, inner, twice))
    low = lambda x, q: np.sort(x)[np.searchsorted(np.arange(1, len(x) + 1), q * len(x))]
    axes = (low(v, 0.5), spikes.FIRST_ROUND * low(np.abs(v - low(v, 0.5)), 0.5), spikes.CLEAR[1] * low(np.abs(d1[inner]), 0.99), spikes.CLEAR[2] * low(np.abs(d2[twice]), 0.99))
    for _ in range(spikes.ROUNDS):
        level, a, b, c = axes
        keep = ~spikes.outside((v - level) / a, d1 / b, d2 / c)
        level = low(v[keep], 0.5)
        newer = (level, spikes.CLEAR[0] * low(np.abs(v[keep] - level), 0.99), spikes.CLEAR[1] * low(np.abs(d1[keep & inner]), 0.99), spikes.CLEAR[2] * low(np.abs(d2[keep & twice]), 0.99))
        if newer == axes:
            break
        axes = newer
    assert np.allclose((got.level, got.a, got.b, got.c), axes) and got.a < 400


def test_readings(spark):
    rng = np.random.default_rng(6)
    data = [[k, "a" if k % 3 else "{A}", 1, 1, 10 * k, bytes([k // 256, k % 256]) * 8, float(np.float32(200 + rng.normal(0, 3)))] for k in range(600)]
    data[50][6] = 2000.0
    data[51][6] = -1.0
    for k in range(300, 306):  # over partitions, with a read of no reading in between
        data[k][6] = 201.5
    data[303][6] = float("nan")
    data.append([700, "a", None, 1, None, data[301][5], 201.5])  # a copy without a place
    data.append([701, "a", 1, 1, 10 * 50, data[50][5], 2000.0])  # a repeated delivery of the spike
    data.append([702, "a", 1, 1, 10 * 20, data[20][5], data[20][6]])  # two rows of one read are no series
    data += [[710 + k, "one", 5, 1, k, bytes([k]) * 16, 100.0 + k] for k in range(3)]
    data.append([720, None, None, None, None, None, None])
    df = spark.createDataFrame(data, READS)
    assert rows(spikes.odd_readings(df)) == sorted([(50,), (51,), (701,), *[(k,) for k in range(300, 306) if k != 303], (700,)], key=repr)


def test_a_stuck_series_over_all_partitions(spark):
    data = [[k, "a", 1, 1, k, k.to_bytes(16, "big"), 7.0 if k >= 100 else float(k)] for k in range(1000)]
    got = {r[0] for r in rows(spikes.odd_readings(spark.createDataFrame(data, READS)))}
    assert got >= set(range(100, 1000))


def test_empty(spark):
    signal, info, reads = spark.createDataFrame([], SIGNAL), spark.createDataFrame([], INFO), spark.createDataFrame([], READS)
    assert rows(spikes.implausible(signal, reads, info)) == []


def test_a_reading_is_judged_alike_in_sources_of_any_size(spark):
    k = 0
    data = []
    for source, n in (("small", 100), ("large", 20_000)):
        step = [200 + 4.0 * ((i * 7919) % 1001 - 500) / 500 for i in range(n)]  # spread evenly: the median deviation is 2
        for i, value in enumerate([*step, 200 + 8.2 * 1.4826 * 2, 200 + 6.6 * 1.4826 * 2]):
            data.append((k, source, None, None, i, k.to_bytes(16, "big"), value))
            k += 1
    assert rows(spikes.odd_readings(spark.createDataFrame(data, READS))) == [(100,), (20_102,)]
