import datetime as dt
import random

from conftest import rows
from pyspark.sql import functions as F
from strandlake.operators import orphans

T = dt.datetime(2025, 1, 30, tzinfo=dt.timezone.utc)
READS = "row_id bigint, run_info string, signal array<bigint>, received_at timestamp, key_id int, value int"
SIGNAL = "row_no bigint, received_at timestamp, deleted_at timestamp"
INFO = "acquisition_id string, received_at timestamp, deleted_at timestamp"


def at(rng):
    return rng.choice([None, *[T + dt.timedelta(hours=rng.randrange(100)) for _ in range(9)]])


def brute(reads, signal, info):
    far = dt.datetime(9999, 1, 1, tzinfo=dt.timezone.utc)

    def alive(targets, t):
        return any(a is not None and (t is None or a <= t) and (d is None or (t is not None and d > t)) for a, d in targets)

    by_row, by_acq = {}, {}
    for n, a, d in signal:
        by_row.setdefault(n, []).append((a, d))
    for k, a, d in info:
        if k is not None:
            by_acq.setdefault(k.strip(" {}").lower(), []).append((a, d))
    out = set()
    for row, run, refs, t, *_ in reads:
        if run is not None and not alive(by_acq.get(run.strip(" {}").lower(), []), t):
            out.add(("run_info", row, run.strip(" {}").lower()))
        for r in refs or ():
            if r is not None and not alive(by_row.get(r, []), t):
                out.add(("signal", row, str(r)))
    assert far
    return sorted(out, key=repr)


def test_random_with_hot_keys(spark):
    rng = random.Random(4)
    keys = [0, 1, 2, 32767, 32768, 70000, -5, 2**40]
    reads = [(k, rng.choice(["hot", "hot", "Hot ", "{x}", "y", "gone", None]), rng.choice([None, [], [rng.choice([*keys, None]) for _ in range(3)], [0]]), at(rng), 1, 2) for k in range(600)]
    signal = [(rng.choice(keys[:-2]), at(rng), rng.choice([None, at(rng)])) for _ in range(9)]
    info = [(rng.choice(["hot", "X", " y", None]), at(rng), rng.choice([None, at(rng)])) for _ in range(7)]
    got = orphans.orphan_references(spark.createDataFrame(reads, READS), spark.createDataFrame(signal, SIGNAL), spark.createDataFrame(info, INFO))
    want = brute(reads, signal, info)
    assert rows(got) == want and len(want) > 100
    months = rows(orphans.orphans_by_month(got, spark.createDataFrame(reads, READS)))
    assert sum(m[2] for m in months) == len(want)


def test_marks_only_doubtful_days(spark):
    reads = spark.createDataFrame([(1, "a", [7], T + dt.timedelta(days=3), 0, 0)], READS)
    signal = spark.createDataFrame([(7, T, None)], SIGNAL)
    refs = orphans.reference_events(reads.selectExpr("'signal' AS ref_field", "7L AS key_id", "row_id", "received_at"))
    targets = orphans.target_events(signal.selectExpr("'signal' AS ref_field", "row_no AS key_id", "received_at", "deleted_at"))
    assert rows(orphans.surviving_bits(refs, targets)) == []


def test_periods_of_a_day_clear_what_came_just_before(spark):
    columns = "ref_field string, key_id bigint, t bigint, kind int, row_id bigint, until bigint"
    day, ms, forever = orphans.DAY_US, orphans.PERIOD_US, orphans.FOREVER
    targets = spark.createDataFrame([("signal", k, day + 10 * ms, 1, None, forever if k != 3 else 2 * day) for k in range(1, 6)], columns)
    references = spark.createDataFrame([("signal", 1, day + 11 * ms, 2, 1, 0), ("signal", 2, day + 10 * ms + 5, 2, 2, 0), ("signal", 3, day + 11 * ms, 2, 3, 0), ("signal", 4, 2 * day, 2, 4, 0), ("signal", 5, forever, 2, 5, 0), ("signal", 9, day, 2, 6, 0)], columns)
    # 2 falls into the period of its target, 3 has a target that is deleted, 9 has none; repeated references change nothing
    assert rows(orphans.surviving_bits(references.union(references), targets)) == [("signal", 2, 1), ("signal", 3, 1), ("signal", 9, 1)]
    assert rows(orphans.dangling(references, targets)) == [("signal", 9, 6)]


def test_bitmaps_of_many_tasks_are_one(spark):
    columns = "ref_field string, key_id bigint, t bigint, arrived boolean"
    events = [("signal", (k * 37) % 20_000, (k % 3) * orphans.DAY_US + k, bool(k % 2)) for k in range(4000)]
    few, many = (spark.createDataFrame(events, columns).repartition(n) for n in (1, 13))
    assert orphans.bitmaps(few).count() < orphans.bitmaps(many).count() < 13 * orphans.bitmaps(few).count() + 1
    split = lambda df: (df.filter("NOT arrived").withColumn("until", F.lit(0)), df.filter("arrived").withColumn("until", F.lit(orphans.FOREVER)))
    assert rows(orphans.surviving_bits(*split(few))) == rows(orphans.surviving_bits(*split(many)))


def test_empty_tables(spark):
    reads, signal, info = (spark.createDataFrame([], s) for s in (READS, SIGNAL, INFO))
    assert rows(orphans.orphan_references(reads, signal, info)) == []
    one = spark.createDataFrame([(1, "a", [5], T, 0, 0)], READS)
    assert rows(orphans.orphan_references(one, signal, info)) == [("run_info", 1, "a"), ("signal", 1, "5")]


def test_only_surviving_keys_and_days_are_scanned(spark):
    day = orphans.DAY_US
    columns = "ref_field string, key_id bigint, t bigint, kind int, row_id bigint, until bigint"
    forever = orphans.FOREVER
    targets = spark.createDataFrame([("signal", 1, 0, 1, None, forever), ("signal", 2, 5 * day, 1, None, forever)], columns)
    references = spark.createDataFrame([("signal", 1, 3 * day, 2, 10, 0), ("signal", 2, 5 * day + 9, 2, 11, 0), ("signal", 2, 7 * day, 2, 12, 0), ("run_info", 1, day, 2, 13, 0)], columns)
    kept, lived = orphans.surviving(references, targets, orphans.surviving_bits(references, targets))
    assert rows(kept.select("row_id")) == [(11,), (13,)] and rows(lived.select("key_id")) == [(2,)]
    assert rows(orphans.dangling(references, targets)) == [("run_info", 1, 13)]
