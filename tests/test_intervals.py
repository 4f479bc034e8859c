import random

from conftest import rows
from strandlake.operators import intervals

READS = "run_info string, channel int, well smallint, start bigint, num_samples bigint"


def brute(data):
    covered = {}
    for acq, ch, well, start, n in data:
        if None in (acq, ch, well, start, n) or n <= 0:
            continue
        covered.setdefault((acq.strip(" {}\t").lower(), ch, well), []).append((start, start + n))
    gaps, periods = [], []
    for key, spans in covered.items():
        spans.sort()
        begin, end, n = spans[0][0], spans[0][1], 0
        for a, b in spans:
            if a > end:
                gaps.append((*key, end, a))
                periods.append((*key, begin, end, n))
                begin, n = a, 0
            end, n = max(end, b), n + 1
        periods.append((*key, begin, end, n))
    return sorted(gaps, key=repr), sorted(periods, key=repr)


def test_random_with_a_hot_channel(spark):
    rng = random.Random(1)
    data = []
    for _ in range(1500):
        hot = rng.random() < 0.5
        acq = "aa" if hot else rng.choice(["aa", " AA", "{bb}", "cc", None])
        data.append((acq, 1 if hot else rng.choice([1, 2, None]), rng.choice([1, None]) if not hot else 1, rng.choice([None, rng.randrange(9000)]) if not hot else rng.randrange(20000), rng.choice([0, None, 1, 3, 5, 12, 400]) if rng.random() < 0.1 else rng.randrange(1, 9)))
    data += data[:50]
    df = spark.createDataFrame(data, READS)
    gaps, periods = brute(data)
    assert rows(intervals.gaps(df)) == gaps
    assert rows(intervals.periods(df)) == periods
    assert len(gaps) > 100


def test_one_long_range_over_all_partitions(spark):
    data = [("a", 1, 1, 0, 100_000)] + [("a", 1, 1, 10 * k, 5) for k in range(900)] + [("a", 1, 1, 100_001, 1)]
    df = spark.createDataFrame(data, READS)
    assert rows(intervals.gaps(df)) == [("a", 1, 1, 100_000, 100_001)]
    assert rows(intervals.periods(df)) == [("a", 1, 1, 0, 100_000, 901), ("a", 1, 1, 100_001, 100_002, 1)]


def test_touching_ranges_empty_tables_extra_columns_and_overflow(spark):
    df = spark.createDataFrame([("a", 1, 1, 0, 5, "x"), ("a", 1, 1, 5, 5, "y"), ("a", 1, 1, 2**63 - 2, 9, "z")], READS + ", stop string")
    assert rows(intervals.gaps(df)) == [("a", 1, 1, 10, 2**63 - 2)]
    empty = spark.createDataFrame([], READS)
    assert rows(intervals.gaps(empty)) == [] and rows(intervals.periods(empty)) == []
    nulls = spark.createDataFrame([(None, None, None, None, None)], READS)
    assert rows(intervals.gaps(nulls)) == []
