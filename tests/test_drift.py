import json

from conftest import rows
from pyspark.sql import functions as F
from strandlake.operators import drift

SCHEMA = "rec_id bigint, file_id bigint, producer string, file_seq int, payload string, kinds string"


def test_changes(spark):
    files = {
        1: ("p", 1, [{"num_samples": 5, "pore_type": "x"}, {"num_samples": None}]),
        2: ("p", 2, [{"sample_count": 5, "pore_type": "x", "open_pore_level": 1.5}]),
        3: ("p", 10, [{"sample_count": "5", "pore": {"pore_type": "x"}}]),
        4: ("p", 11, [{"sample_count": None, "pore": {"pore_type": "x"}}]),  # no type to tell
        5: ("q", 1, [{"numSamples": 1.0}]),
        6: ("q", 2, [{"num_samples": 1}]),
        7: (None, 1, [{"channel": 1}]),
        8: (None, 2, [{"channel": 1, "never_seen": 2}]),
        9: ("r", 1, [{"well": 2, "channel": 1}]),
        10: ("r", 2, [{"unheard_of": 2, "channel": 1}]),
    }
    data, rec = [], 0
    for file, (producer, seq, payloads) in files.items():
        for p in payloads:
            rec += 1
            data.append((rec, file, producer, seq, json.dumps(p), "k"))
    data += [(90, 1, "p", 1, '{"cut": ', "k"), (91, 1, "p", 1, None, "k"), (92, 1, "p", 1, "[1]", "k")]
    df = spark.createDataFrame(data, SCHEMA)
    assert rows(drift.found_changes(df)) == sorted([
        (2, "num_samples", "renamed"), (2, "open_pore_level", "added"), (3, "num_samples", "retyped"), (3, "open_pore_level", "removed"), (3, "pore_type", "renamed"),
        (6, "num_samples", "renamed"), (6, "num_samples", "retyped"), (8, "never_seen", "added"), (10, "well", "renamed"),
    ], key=repr)
    assert drift.schema_changes(df).filter("change_kind = 'first'").count() == 4
    table = {r.rec_id: r for r in drift.consistent_table(df).collect()}
    assert len(table) == len(data) and table[3].num_samples == 5 and table[4].num_samples == 5 and table[4].pore_type == "x"
    assert not table[90].readable and not table[91].readable and not table[92].readable


def test_cast_rules(spark):
    def cast(value, kind, field="start"):
        """The value of a field of this kind, and whether it could be cast."""
        df = spark.createDataFrame([(1, 1, "p", 1, json.dumps({"v": value}), "")], SCHEMA)
        text = drift.parsed(df).select(F.try_variant_get("v", F.lit("$.v"), "string").alias("t"))
        found = text.select(drift.cast_rule(F.col("t"), kind).alias("c"), F.col("t").isNull().alias("none")).first()
        return found.c, found.none or found.c is not None

    assert cast("12", "long") == (12, True) and cast(12.0, "int") == (12, True)
    assert cast(12.5, "int") == (None, False) and cast(70000, "short") == (None, False)
    assert cast("x", "float") == (None, False) and cast(None, "float") == (None, True)
    assert cast(True, "long") == (None, False) and cast([1], "float") == (None, False) and cast("True ", "boolean") == (True, True) and cast(1, "boolean") == (None, False)
    assert cast("9007199254740993", "long") == (9007199254740993, True) and cast(1e30, "long") == (None, False) and cast("1d", "float") == (None, False)


def test_shapes():
    shape = "OBJECT<`a b`: BIGINT, a: OBJECT<>, c: OBJECT<`x``:<>y`: VOID, d: OBJECT<e: DECIMAL(2,1)>>, f: ARRAY<OBJECT<`k>`: BIGINT, l: ARRAY<DOUBLE>>>, g: DECIMAL(20,0), h: BOOLEAN>"
    assert drift.leaves_of(shape) == [(("a b",), "whole"), (("c", "x`:<>y"), None), (("c", "d", "e"), "decimal"), (("f",), "other"), (("g",), "whole"), (("h",), "other")]
    assert drift.leaves_of("OBJECT<>") == []


def _exports(spark, files):
    data = [(100 * k + i, k, p, seq, json.dumps(x), "") for k, (p, seq, payloads) in files.items() for i, x in enumerate(payloads)]
    return spark.createDataFrame(data, SCHEMA)


def test_renames_that_no_list_knows_reach_the_table(spark):
    files = {
        1: ("p", 1, [{"num_samples": 5, "channel": 7, "pore_type": "a"}]),
        2: ("p", 2, [{"smp_ct": 6, "chn": 8, "pore_type": "b"}, {"smp_ct": None, "chn": 9, "pore_type": "b"}]),  # two at once
        3: ("p", 3, [{"SMPCNT_X": "7", "smp_ct": 6, "chn": 8, "pore_type": "b"}]),
        4: ("p", 4, [{"amount": 8, "channel": 8, "pore_type": "b"}]),  # on from an unknown one
        5: ("q", 1, [{"chn": "not theirs", "pore_type": "b"}]),  # another producer's key of that name
        6: ("r", 1, [{"smp_ct": 3}]),
        7: ("r", 2, [{"num_samples": 3}]),  # an unknown one becomes known
    }
    df = _exports(spark, files)
    table = {r.rec_id: r for r in drift.consistent_table(df).collect()}
    assert [(table[k].num_samples, table[k].channel) for k in (100, 200, 201, 300, 400, 500, 600, 700)] == [(5, 7), (6, 8), (None, 9), (6, 8), (8, 8), (None, None), (3, None), (3, None)]
    assert {k: r.extra for k, r in table.items() if r.extra} == {300: '{"SMPCNT_X":"7"}', 500: '{"chn":"not theirs"}'}
    assert rows(drift.found_changes(df)) == sorted([
        (2, "num_samples", "renamed"), (2, "channel", "renamed"), (3, "SMPCNT_X", "added"), (4, "SMPCNT_X", "removed"), (4, "num_samples", "renamed"), (4, "channel", "renamed"), (7, "num_samples", "renamed"),
    ], key=repr)
    steps = {(r.producer, r.since): {(x.field, x.action) for x in r.steps if x.action != "default"} for r in drift.registry(df).collect()}
    assert steps["p", 1] == {("num_samples", "keep"), ("channel", "keep"), ("pore_type", "keep")}
    assert steps["p", 2] == {("num_samples", "rename"), ("channel", "rename"), ("pore_type", "keep")}


def test_routing_follows_the_version_of_the_file(spark):
    files = {1: ("p", 1, [{"end_reason": 4, "calibration": {"offset": "2.5", "it's": 1}, "well": 70000}]), 2: ("p", 2, [{"end_reason": "4", "mux": None, "pore": {"well": 2}}]), 3: ("p", 3, [{"mux": 1, "pore": {"well": 2}}, {"mux": 1, "pore": {"well": None}}])}
    table = {r.rec_id: r for r in drift.consistent_table(_exports(spark, files)).collect()}
    assert (table[100].end_reason, table[100].calibration_offset, table[100].well, table[100].uncast, table[100].extra) == ("signal_positive", 2.5, None, ["well"], '{"calibration.it\'s":1}')
    assert (table[200].end_reason, table[200].well) == ("4", 2) and [table[k].well for k in (300, 301)] == [2, 1]


def test_one_producer_over_all_partitions(spark):
    data = [(k, k, "p", k, json.dumps({"channel": 1} | ({"well": 1} if k % 2 else {})), "") for k in range(400)]
    got = rows(drift.found_changes(spark.createDataFrame(data, SCHEMA)))
    assert got == sorted([(k, "well", "added" if k % 2 else "removed") for k in range(1, 400)], key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(drift.found_changes(df)) == [] and rows(drift.consistent_table(df)) == []
