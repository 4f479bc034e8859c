import datetime as dt
import random

import pyarrow as pa
from conftest import rows
from strandlake.operators import delivery

SCHEMA = "row_id bigint, received_at timestamp, read_id binary, run_info string, number string"
T = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)


def brute(data):
    best = {}
    for row, at, read, run, _ in data:
        key = (read, run.strip(" {}").lower() if run is not None else None)
        order = (at is None, at or T, row)
        best[key] = min(best.get(key, order), order)
    return sorted((r[0],) for r in data if (r[1] is None, r[1] or T, r[0]) != best[(r[2], r[3].strip(" {}").lower() if r[3] is not None else None)])


def test_random_with_a_hot_read(spark):
    rng = random.Random(2)
    data = []
    for k in range(1500):
        read = bytes(16) if rng.random() < 0.4 else rng.choice([None, b"short", rng.randrange(40).to_bytes(16, "big"), rng.randrange(2**128).to_bytes(16, "big")])
        data.append((k, rng.choice([None, T + dt.timedelta(seconds=rng.randrange(50))]), read, rng.choice(["a", " A ", "{b}", None]), "clash"))
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(delivery.repeated(df)) == sorted(brute(data), key=repr)


def test_seen_ranges_merge_across_partitions(spark):
    numbers = list(range(2**64 - 500, 2**64 + 500)) + [2**100, 2**100 + 1, 2**100 + 3]
    data = [(k, T, n.to_bytes(16, "big"), "a", None) for k, n in enumerate(numbers * 2)]
    random.Random(3).shuffle(data)
    df = spark.createDataFrame(data, SCHEMA)
    got = rows(delivery.seen_ranges(df).select("range_from", "range_to", "n_numbers"))
    assert got == sorted([(f"{2**64 - 500:032x}", f"{2**64 + 499:032x}", 1000), (f"{2**100:032x}", f"{2**100 + 1:032x}", 2), (f"{2**100 + 3:032x}", f"{2**100 + 3:032x}", 1)])
    assert delivery.repeated(df).count() == len(numbers)


def _batch(data, producer="a"):
    n = len(data)
    return pa.RecordBatch.from_pydict({"row_id": list(range(n)), "malformed": [len(x) != 16 for x in data], "producer": [producer] * n, "number": pa.array(data, pa.binary()), "arrived": pa.array([T] * n, pa.timestamp("us", "UTC"))})


def test_ranges_decide_what_is_accepted():
    rng = random.Random(5)
    numbers = [rng.choice([rng.randrange(60), 2**64 - 1 - rng.randrange(3), 2**64 + rng.randrange(3), 2**128 - 1, rng.randrange(2**128)]) for _ in range(4000)]
    ids = [n.to_bytes(16, "big") for n in numbers]

    def run(acceptance):
        batches = [_batch(ids[k : k + 97], "ab"[k % 2]) for k in range(0, len(ids), 97)]
        return [x for b in delivery.accepted_in(iter(batches), True, "rows", acceptance) for x in b.column("accepted").to_pylist()]

    seen, want = set(), []
    for k, n in enumerate(ids):
        key = "ab"[k // 97 * 97 % 2], n
        want.append(key not in seen)
        seen.add(key)
    acceptance = delivery.Acceptance()
    assert run(acceptance) == want
    # the ranges are disjoint, don't touch, and cover just the numbers seen
    found = acceptance.ranges().to_pydict()
    spans = sorted((p, int.from_bytes(a, "big"), int.from_bytes(b, "big")) for p, a, b in zip(found["producer"], found["range_from"], found["range_to"], strict=True))
    assert all(p != q or b + 1 < c for (p, _, b), (q, c, _) in zip(spans, spans[1:], strict=False))
    assert {(p, x.to_bytes(16, "big")) for p, a, b in spans for x in range(a, b + 1)} == seen

    class Forgetful(delivery.SeenRanges):
        def _add(self, start, end):
            pass

    # without the ranges, numbers seen in an earlier batch are taken again
    assert sum(run(delivery.Acceptance(Forgetful()))) > sum(want)


def test_numbers_in_sequence_become_one_range():
    acceptance = delivery.Acceptance()
    order = list(range(5000))
    random.Random(6).shuffle(order)
    list(delivery.accepted_in((_batch([n.to_bytes(16, "big") for n in order[k : k + 100]]) for k in range(0, 5000, 100)), True, "rows", acceptance))
    assert len(acceptance.seen.ranges()[0]) == 1 and not acceptance.exact
    list(delivery.accepted_in(iter([_batch([b"x", b"x"])]), True, "rows", acceptance))
    assert len(acceptance.exact) == 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(delivery.repeated(df)) == [] and rows(delivery.seen_ranges(df)) == []
