"""Operators on reads: selection, views, routing, merging, migration."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from strandlake.operators import aggregate, merge, migrate, route, select, signal, view

A, B, C = (f"{k:08x}-0000-4000-8000-000000000000" for k in (10, 11, 12))


def reads(spark):
    data = [("f1", 0, 0, A, 1, "x"), ("f1", 0, 1, B, 2, "x"), ("f1", 1, 0, A, 3, "y"), ("f2", 0, 0, A, 4, "x"), ("f2", 0, 1, None, 5, None)]
    df = spark.createDataFrame(data, "_file string, _batch int, _row int, id string, read_number bigint, run_info string")
    from strandlake.functions.ids import uuid_bin

    return df.withColumn("read_id", uuid_bin("id"))


def ids_of(spark, *texts):
    return select.pack_ids(spark.createDataFrame([(t,) for t in texts], "t string"))


def test_selection_is_a_bag(spark):
    r = reads(spark)
    got = select.select_reads(r, ids_of(spark, A, A, B, "nonsense"), file=["_file"], order=["_batch", "_row"])
    assert sorted(x.read_number for x in got.collect()) == [1, 1, 2, 4, 4]
    assert sorted(x.read_number for x in select.select_reads(r, ids_of(spark, A)).collect()) == [1, 3, 4]
    assert rows(select.missing(r, ids_of(spark, A, C)).select(F.hex("read_id"))) == [(C.replace("-", "").upper(),)]
    with pytest.raises(select.MissingReads):
        select.select_reads(r, ids_of(spark, A, C), strict=True)
    with pytest.raises(select.MissingReads):
        select.pack_ids(spark.createDataFrame([("x",)], "t string"), invalid_ok=False)
    assert select.select_reads(r, ids_of(spark)).count() == 0 and select.select_reads(r.limit(0), ids_of(spark, A)).count() == 0
    assert select.point_lookup(r, B).count() == 1 and select.point_lookup(r, C).count() == 0 and select.point_lookup(r, "x").count() == 0
    assert select.has_duplicate(r) and not select.has_duplicate(r.filter("_batch = 0 AND _file = 'f1'"))


def test_buckets(spark):
    df = spark.range(1000).withColumn("id", F.pmod(F.col("id") * 7919, F.lit(1000)))
    got = select.bucketed(df, 30, ["id"])
    assert rows(got.filter("position <> id").select("id")) == [] and got.agg(F.max("bucket")).first()[0] == 33
    both = got.union(got)
    assert both.filter("position <> id").count() == 0 and both.count() == 2000
    assert select.bucketed(df.limit(0), 30, ["id"]).count() == 0


def test_fields():
    assert view.select_fields("read_number , read_id,", None) == ["read_id", "read_number"]
    assert view.select_fields(None, "filename") == [f for f in view.FIELDS if f != "filename"] and view.select_fields("", "", True) == ["read_id"]
    assert view.source_columns(["duration"]) == (["num_samples", "run_info"], ["acquisition_id", "sample_rate"]) and view.source_columns(["channel"])[1] == []
    with pytest.raises(KeyError):
        view.select_fields("nothing")
    with pytest.raises(RuntimeError):
        view.select_fields("channel", "channel")
    assert len(view.FIELDS) == 25


def test_view(spark, tmp_path):
    r = reads(spark).withColumns({"num_samples": F.lit(10), "start": F.lit(5)})
    info = spark.createDataFrame([("f1", "x", 0, ""), ("f1", "y", 4, None), ("f1", "y", 4, None), ("f2", "x", 2, "s")], "_file string, acquisition_id string, sample_rate int, sample_id string")
    got = view.view(r, info, include="read_number,duration,start_time,sample_id,filename")
    assert rows(got) == sorted([("f1", 1, None, None, "not_set"), ("f1", 2, None, None, "not_set"), ("f1", 3, 1.25, 2.5, None), ("f2", 4, 2.5, 5.0, "s")], key=repr)
    view.write_view(got, f"{tmp_path}/v", ",")
    text = "".join(p.read_text() for p in (tmp_path / "v").glob("*.csv"))
    assert "f1,3,1.25000000,2.50000000," in text and "f1,1,,," in text
    with pytest.raises(view.AmbiguousAcquisition):
        view.view(r, info.drop("_file"), include="sample_rate")
    with pytest.raises(ValueError):
        view.view(r, include="sample_rate")


def test_templates():
    assert route.template_keys("{a}_{b}.x", ["a", "b"]) == ["a", "b"] and route.template_keys("{}_{}", ["a", "b"]) == ["a", "b"] and route.template_keys("{1}-{0}", ["a", "b"]) == ["b", "a"]
    for template, unused_ok in (("{c}", True), ("{a}", False), ("{}{}{}", True)):
        with pytest.raises(KeyError):
            route.template_keys(template, ["a", "b"], unused_ok)
    assert route.template_keys("{a}", ["a", "b"], True) == ["a"] and route.default_template(["a", "b"]) == "a-{a}_b-{b}.container"


def test_subset_filter_and_merge(spark):
    r = reads(spark).filter("_file = 'f1' AND _batch = 0")
    mapping = spark.createDataFrame([(A, "one"), (A, "one"), (A, "two"), (B, "two"), (None, "one"), (A, None)], "read_id string, dest string")
    assert rows(route.subset(r, mapping).select("read_number", "dest")) == [(1, "one"), (1, "two"), (2, "two")]
    with pytest.raises(select.MissingReads):
        route.subset(r, mapping.union(spark.createDataFrame([(C, "x")])))
    with pytest.raises(merge.DuplicateReads):
        route.subset(reads(spark), mapping)
    table = spark.createDataFrame([(A, 1, "b"), (B, None, "c"), ("bad", 2, "d")], "read_id string, mux int, dest string")
    assert rows(route.mapping_of_table(table, ["mux"])) == [(A, "mux-1.container")]
    assert rows(route.filter_ids(r, spark.createDataFrame([(A,), (A,)], "i string")).select("read_number")) == [(1,)]
    with pytest.raises(select.MissingReads):
        route.filter_ids(r, spark.createDataFrame([(C,)], "i string"))
    assert merge.merge([r, r], check=False).count() == 4
    with pytest.raises(merge.DuplicateReads):
        merge.merge([r, r])
    info = spark.createDataFrame([("x", {"k": "v", "l": "w"}), ("x", {"l": "w", "k": "v"}), ("z", None)], "acquisition_id string, tags map<string,string>")
    assert merge.merge_dimension([info, info]).count() == 2
    merge.check_references(r, info)
    with pytest.raises(merge.BrokenReference):
        merge.check_references(reads(spark), info)


def test_signal_and_sums(spark):
    r = spark.createDataFrame([(1, [2, 0]), (2, []), (3, None), (4, [7])], "row_id int, signal array<bigint>")
    s = spark.createDataFrame([(0, [1, 2], 2, "a", 9), (2, [3], 1, "a", 9), (5, None, 4, "b", 9)], "row_no bigint, signal array<smallint>, samples bigint, read_id string, row_id int").drop("row_id")
    assert rows(signal.reassemble(r, s, ["row_id"])) == [(1, [3, 1, 2], True), (2, [], True), (3, [], True), (4, [], False)]
    assert rows(aggregate.per_read(s)) == [("a", 2, 3, 6, 1.0), ("b", 1, 4, None, None)]
    assert rows(aggregate.signal_sums(s)) == [("a", 6), ("b", 0)]
    summary = aggregate.debug_summary(spark.createDataFrame([], "run_info string, num_samples bigint, start bigint"), s.limit(0)).first()
    assert summary.n_reads == 0 and summary.percent_compressed is None
    assert aggregate.with_unit(1234567) == "1.2 M" and aggregate.throughput(10**6, 2) == (2.0, 1.0)


def test_migration(spark):
    old = spark.createDataFrame([(1, bytes(16), [0, 1], 1, 5, 1.0, {"offset": 1.0, "scale": 2.0}, {"channel": 3, "well": 1, "pore_type": "p"}, {"name": "unknown", "forced": False}, {"acquisition_id": "a", "sample_rate": 4000})],
        "row_id int, read_id binary, signal array<bigint>, read_number bigint, start bigint, median_before float, calibration struct<offset:float,scale:float>, pore struct<channel:int,well:int,pore_type:string>, end_reason struct<name:string,forced:boolean>, run_info struct<acquisition_id:string,sample_rate:int>")
    s = spark.createDataFrame([(0, 7), (1, 8)], "row_no bigint, samples bigint")
    now, info = migrate.migrate(old, 0, s, ["row_id"])
    row = now.first()
    assert row.num_samples == 15 and row.channel == 3 and row.run_info == "a" and row.end_reason == "unknown" and row.open_pore_level != row.open_pore_level
    assert rows(info) == [("a", 4000)]
    with pytest.raises(migrate.MissingChunk):
        migrate.v1_to_v2(old, s.filter("row_no = 0"), ["row_id"])
    assert [migrate.table_version(v) for v in ((0, 0, 23), (0, 0, 24), (0, 0, 32), (0, 0, 38), (0, 3, 30))] == [0, 1, 2, 3, 4]
