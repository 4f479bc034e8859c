import datetime as dt
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F
from strandlake import cli
from strandlake.functions.ids import uuid_str
from strandlake.operators import select
from strandlake.sources import format as form
from strandlake.sources import legacy, mapping, recovery
from strandlake.sources.container import ReadStore, write
from strandlake.sources.discovery import existing, listed

INFO = {"acquisition_id": "acq", "acquisition_start_time": dt.datetime(2019, 5, 13, 11, 11, 43, tzinfo=dt.timezone.utc), "adc_max": 4095, "adc_min": -4096, "context_tags": {"k": "v"}, "sample_rate": 4000, "sample_id": "S", "tracking_id": {"a": "b"}}


def read(k, **more):
    return {"read_id": k.to_bytes(16, "big"), "read_number": k, "start": 1000 * k, "channel": 1 + k % 5, "well": 1 + k % 2, "pore_type": f"p{k % 3}", "end_reason": "unknown", "end_reason_forced": False, "run_info": "acq", "calibration_offset": 2.0, "calibration_scale": 0.5} | more


def make(path, numbers, **how):
    rng = np.random.default_rng(1)
    how.setdefault("chunk", 100)
    file = form.ContainerFile(str(path), **how)
    signals = {}
    for k in numbers:
        signals[k] = rng.integers(-3000, 3000, int(rng.integers(0, 450))).astype(np.int16)
        file.add(read(k), INFO, signals[k])
    file.close()
    return signals


@pytest.mark.parametrize("packed", [True, False])
def test_round_trip(spark, tmp_path, packed):
    signals = make(tmp_path / "a.container", range(1100), packed=packed)
    store = ReadStore(spark, str(tmp_path))
    got = {int.from_bytes(r.read_id, "big"): r for r in store.complete(decode=True).collect()}
    assert len(got) == 1100 and all(got[k].signal == v.tolist() and got[k].num_samples == len(v) for k, v in signals.items())
    assert got[7].info.context_tags == {"k": "v"} and got[7].info.acquisition_start_time == dt.datetime(2019, 5, 13, 11, 11, 43) and np.isnan(got[7].median_before)
    (meta,) = store.files().collect()
    assert (meta.n_reads, meta.read_batches, meta.packed, meta.table_version, meta.n_run_infos) == (1100, 2, packed, 4, 1)
    assert store.num_reads() == 1100 and store.reads(batches=[1]).count() == 100 and store.reads().filter("_batch = 1").count() == 100
    assert store.signal(columns=["row_no"]).agg(F.count("row_no"), F.max("row_no")).first()[:] == (meta.n_signal_rows, meta.n_signal_rows - 1)
    cut = store.table("signal", ["row_no"], splitBytes="20000")
    assert rows(cut) == rows(store.signal(columns=["row_no"])) and cut.rdd.getNumPartitions() > 2
    with pytest.raises(ValueError):
        store.reads(batches=[0], selection=store.read_ids())


def test_subset_written_and_read_again(spark, tmp_path):
    signals = make(tmp_path / "a.container", range(40))
    rows_ = ReadStore(spark, f"{tmp_path}/a.container").complete().withColumn("dest", F.concat(F.lit("well-"), "well", F.lit(".container")))
    write(rows_, f"{tmp_path}/out")
    assert sorted(os.listdir(tmp_path / "out")) == ["well-1.container", "well-2.container"]
    again = {int.from_bytes(r.read_id, "big"): r.signal for r in ReadStore(spark, f"{tmp_path}/out").complete(decode=True).collect()}
    assert again == {k: v.tolist() for k, v in signals.items()}
    with pytest.raises(Exception, match="exist"):
        write(rows_, f"{tmp_path}/out")
    write(rows_, f"{tmp_path}/out", overwrite=True, encoding="plain")
    assert {r.packed for r in ReadStore(spark, f"{tmp_path}/out").files().collect()} == {False}
    broken = rows_.withColumn("run_info", F.lit("other"))
    with pytest.raises(Exception, match="isn't given"):
        write(broken, f"{tmp_path}/none")
    assert os.listdir(tmp_path / "none") == []


def test_selection_over_files(spark, tmp_path):
    make(tmp_path / "a.container", [1, 2, 3])
    make(tmp_path / "b.container", [3, 4])
    store = ReadStore(spark, [f"{tmp_path}/a.container", f"{tmp_path}/b.container"])
    chosen = spark.createDataFrame([(k.to_bytes(16, "big"),) for k in (3, 3, 4)], "i binary")
    assert sorted(int.from_bytes(r.read_id, "big") for r in store.reads(selection=chosen).collect()) == [3, 3, 3, 3, 4]
    with pytest.raises(select.MissingReads):
        store.reads(selection=spark.createDataFrame([(bytes(16),)], "i binary"))
    assert store.view(include="filename,duration,read_number").filter("filename = 'b.container'").count() == 2


def _older(path, version):
    """A container as an older writer left it: reads of table version 2 or 3."""
    scalar = lambda t: pa.struct(t)
    meta = {form.KEY_VERSION: version.encode(), form.KEY_SOFTWARE: b"old", form.KEY_IDENTIFIER: b"x"}
    signal = pa.table({"read_id": pa.array([bytes(16), bytes(16)], pa.binary(16)), "signal": pa.array([[1, 2], [3]], pa.large_list(pa.int16())), "samples": pa.array([2, 1], pa.uint32())})
    base = {"read_id": pa.array([bytes(16)], pa.binary(16)), "signal": pa.array([[0, 1]], pa.list_(pa.uint64())), "read_number": pa.array([5], pa.uint32()), "start": pa.array([9], pa.uint64()), "median_before": pa.array([1.5], pa.float32())}
    info = pa.array([{"acquisition_id": "acq", "sample_rate": 4000}], scalar([("acquisition_id", pa.string()), ("sample_rate", pa.uint16())]))
    one = lambda x: pa.DictionaryArray.from_arrays(pa.array([0], pa.int16()), x)
    base |= {"calibration": one(pa.array([{"offset": 2.0, "scale": 0.5}], scalar([("offset", pa.float32()), ("scale", pa.float32())]))), "pore": one(pa.array([{"channel": 3, "well": 2, "pore_type": "p"}], scalar([("channel", pa.uint16()), ("well", pa.uint8()), ("pore_type", pa.string())]))), "end_reason": one(pa.array([{"name": "unknown", "forced": False}], scalar([("name", pa.string()), ("forced", pa.bool_())]))), "run_info": one(info)}
    with open(path, "wb") as f:
        f.write(form.SIGNATURE + bytes(16))
        places = {}
        for kind, table in ((form.SIGNAL, signal), (form.READS, pa.table(base))):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, table.schema.with_metadata(meta)) as w:
                w.write_table(table.replace_schema_metadata(meta))
            data = sink.getvalue().to_pybytes()
            places[kind] = form.Place(f.tell(), len(data))
            f.write(data + bytes(-len(data) % 8) + bytes(16))
        footer = form.footer_bytes("x", places)
        f.write(form.FOOTER_MAGIC + footer + bytes(-len(footer) % 8) + len(footer).to_bytes(8, "little") + bytes(16) + form.SIGNATURE)


def test_older_tables_are_brought_up_to_date(spark, tmp_path):
    _older(tmp_path / "old.container", "0.0.20")
    store = ReadStore(spark, str(tmp_path))
    row = store.reads().first()
    assert (row.num_samples, row.channel, row.well, row.pore_type, row.end_reason, row.run_info, row.num_minknow_events) == (3, 3, 2, "p", "unknown", "acq", 0)
    assert np.isnan(row.open_pore_level) and np.isnan(row.tracked_scaling_scale) and row.calibration_scale == 0.5
    assert store.table("run_info", ["acquisition_id", "sample_rate"]).first()[:] == ("acq", 4000)
    assert store.files().first().table_version == 0


def test_damage(spark, tmp_path):
    make(tmp_path / "a.container", range(5))
    data = (tmp_path / "a.container").read_bytes()
    rng = random.Random(1)
    bad = {"empty": b"", "short": data[:100], "cut": data[:-1], "head": b"x" + data[1:], "footer": data[:-150] + bytes(100) + data[-50:], "sparse": bytes(1 << 16)}
    for name, content in bad.items():
        (tmp_path / f"{name}.bad").write_bytes(content)
        with pytest.raises((form.BadContainer, pa.ArrowException, OSError)):
            form.parse_footer(form.open_random(str(tmp_path / f"{name}.bad")))
    for _ in range(60):  # no other error than the two kinds, whatever is damaged
        where = rng.randrange(len(data) - 300, len(data))
        (tmp_path / "x").write_bytes(data[:where] + bytes([rng.randrange(256)]) + data[where + 1 :])
        try:
            form.parse_footer(form.open_random(str(tmp_path / "x")))
        except (form.BadContainer, pa.ArrowException, OSError):
            pass
    os.remove(tmp_path / "x")
    assert ReadStore(spark, str(tmp_path), bad_files="skip").reads().count() == 5
    with pytest.raises(Exception, match="signature"):
        ReadStore(spark, str(tmp_path), pattern="cut*").reads().count()


def test_recovery(spark, tmp_path):
    file = form.ContainerFile(str(tmp_path / "u.container"), chunk=50, reads_batch=1000, signal_batch=10)
    for k in range(1200):
        file.add(read(k), INFO, np.arange(k % 120))
    file.abandon()
    (tmp_path / "bad.container").write_bytes(b"nothing")
    got = {r.path: r for r in recovery.recover(spark, [f"{tmp_path}/u.container", f"{tmp_path}/bad.container"], cleanup=True).collect()}
    assert got[f"{tmp_path}/u.container"].n_reads == 1000 and got[f"{tmp_path}/bad.container"].errors
    assert not os.path.exists(tmp_path / "u.container")
    saved = ReadStore(spark, f"{tmp_path}/u_recovered.container").complete(decode=True).collect()
    assert len(saved) == 1000 and all(r.signal == list(range(r.read_number % 120)) for r in saved)
    cut = form.ContainerFile(str(tmp_path / "t.container"), chunk=50, reads_batch=10, signal_batch=10)
    for k in range(200):
        cut.add(read(k), INFO, np.arange(20))
    cut.abandon()
    data = (tmp_path / "t.container").read_bytes()
    (tmp_path / "t.container").write_bytes(data[: len(data) // 2])
    counts = recovery.recover_file(str(tmp_path / "t.container"), str(tmp_path / "t2.container"))
    assert 0 < counts["n_reads"] < 200 and counts["n_lost"] > 0
    os.remove(tmp_path / ".t.container.tmp-reads")
    with pytest.raises(form.BadContainer):
        recovery.recover_file(str(tmp_path / "t.container"), str(tmp_path / "t3.container"))


def test_discovery(tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.x", "a.x", ".hidden.x", "sub/c.x", "d.txt"):
        (tmp_path / name).write_bytes(b"1")
    names = lambda **how: [os.path.basename(p) for p, _ in listed([str(tmp_path), str(tmp_path / "a.x")], **how)]
    assert names(pattern="*.x") == ["a.x", "b.x"] and names(pattern="*.x", recursive=True) == ["a.x", "b.x", "c.x"]
    with pytest.raises(FileNotFoundError):
        listed([str(tmp_path / "none")])
    with pytest.raises(AssertionError):
        existing([str(tmp_path)], pattern="*.none")


def test_mappings(spark, tmp_path):
    ids = [f"{k:08x}-0000-4000-8000-000000000000" for k in range(3)]
    (tmp_path / "ids").write_text(f"read_id\n# comment\n\n{ids[0]}\n  {ids[1]}  \n{ids[0]}\nnot-a-uuid\n")
    assert rows(mapping.read_id_list(spark, f"{tmp_path}/ids")) == [(ids[0],), (ids[1],)]
    (tmp_path / "map").write_text(f"a,{ids[0]}\nb,{ids[0]}\n#x,{ids[1]}\nc,bad\n,{ids[2]}\n")
    assert rows(mapping.read_csv_mapping(spark, f"{tmp_path}/map")) == [("a", ids[0]), ("b", ids[0])]
    (tmp_path / "none").write_text("read_id\n")
    with pytest.raises(mapping.EmptyMapping):
        mapping.read_id_list(spark, f"{tmp_path}/none")
    (tmp_path / "table").write_text(f"read_id\tmux\tother\n{ids[0]}\t1\tx\n")
    assert rows(mapping.read_table(spark, f"{tmp_path}/table", ["mux"])) == [(ids[0], "1")]
    with pytest.raises(KeyError):
        mapping.read_table(spark, f"{tmp_path}/table", ["nothing"])


def test_command_line(spark, tmp_path, capsys):
    make(tmp_path / "a.container", range(10))
    make(tmp_path / "b.container", range(10, 14))
    a, b = f"{tmp_path}/a.container", f"{tmp_path}/b.container"
    run = lambda *argv: cli.main([str(x) for x in argv], spark)
    assert run("view", a, b, "-i", "read_number,duration") == 0
    assert len(capsys.readouterr().out.splitlines()) == 15
    assert run("view", a, "-i", "nothing") == 1 and run("view", "-L") == 0
    for what in ("summary", "reads", "debug"):
        assert run("inspect", what, a) == 0
    assert run("inspect", "read", a, "--read-id", spark.range(1).select(uuid_str(F.lit((3).to_bytes(16, "big")))).first()[0]) == 0
    assert "\t4\t" in capsys.readouterr().out
    assert run("merge", a, b, "-o", tmp_path / "m.container") == 0 and run("merge", a, b, "-o", tmp_path / "m.container") == 1
    assert run("merge", a, a, tmp_path / "m.container", "-o", tmp_path / "n.container") == 1
    assert ReadStore(spark, f"{tmp_path}/m.container").num_reads() == 14
    text = lambda k: str(__import__("uuid").UUID(int=k))
    (tmp_path / "ids").write_text("\n".join([text(1), text(12), text(99)]))
    assert run("filter", a, b, "-i", tmp_path / "ids", "-o", tmp_path / "f.container") == 1
    assert run("filter", a, b, "-i", tmp_path / "ids", "-o", tmp_path / "f.container", "-M") == 0
    assert ReadStore(spark, f"{tmp_path}/f.container").num_reads() == 2
    (tmp_path / "table").write_text("read_id,mux\n" + "\n".join(f"{text(k)},{k % 2}" for k in range(10)))
    assert run("subset", a, "-s", tmp_path / "table", "-c", "mux", "--template", "w{mux}.container", "-o", tmp_path / "subset") == 0
    assert sorted(os.listdir(tmp_path / "subset")) == ["w0.container", "w1.container"]
    assert run("repack", a, "-o", tmp_path / "re") == 0 and run("update", a, "-o", tmp_path) == 1
    assert ReadStore(spark, f"{tmp_path}/re").num_reads() == 10
    try:
        legacy.hdf5()
    except legacy.NoHdf5:
        assert run("convert", "fast5", a, "-o", tmp_path / "x") == 1


def test_incremental_appends(spark, tmp_path):
    from strandlake.streaming import incremental

    make(tmp_path / "a.container", range(20))
    complete = ReadStore(spark, f"{tmp_path}/a.container").complete().drop("_file", "_batch", "_row")
    complete.withColumn("received_at", F.timestamp_seconds(F.col("read_number") + 10**9)).write.parquet(f"{tmp_path}/arrivals")
    complete.limit(5).withColumn("received_at", F.timestamp_seconds(F.col("read_number") + 10**9)).write.mode("append").parquet(f"{tmp_path}/arrivals")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/arrivals").schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/arrivals")
    for _ in range(2):  # nothing new the second time
        query = incremental.append(incremental.deduplicated(stream, ["read_id"]), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        query.awaitTermination()
        assert query.exception() is None
    assert ReadStore(spark, f"{tmp_path}/out", recursive=True).num_reads() == 20
    query = incremental.rates(stream, "received_at", "5 seconds", "1 minute", ["run_info"]).writeStream.format("memory").outputMode("complete").queryName("rates").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("SELECT sum(n_reads) FROM rates").first()[0] == 25


def test_repacker_and_differences(spark, tmp_path):
    from strandlake.operators.merge import DuplicateReads
    from strandlake.sources.repack import Repacker, differences

    make(tmp_path / "a.container", range(20))
    make(tmp_path / "b.container", range(20, 25))
    a, b = ReadStore(spark, f"{tmp_path}/a.container"), ReadStore(spark, f"{tmp_path}/b.container")
    job = Repacker(spark)
    whole, part = job.add_output(f"{tmp_path}/whole.container"), job.add_output(f"{tmp_path}/part.container", encoding="plain")
    job.add_all(whole, a)
    job.add_all(whole, b)
    job.add_selected(part, a, spark.createDataFrame([(k.to_bytes(16, "big"),) for k in (3, 5)], "i binary"))
    assert job.finish() == {f"{tmp_path}/whole.container": 25, f"{tmp_path}/part.container": 2}
    both = ReadStore(spark, [f"{tmp_path}/a.container", f"{tmp_path}/b.container"])
    assert differences(both, ReadStore(spark, f"{tmp_path}/whole.container")).count() == 0
    assert rows(differences(a, ReadStore(spark, f"{tmp_path}/part.container")).select(F.col("fields")[0])) == [("read",)] * 18
    edited = a.complete(decode=True).withColumn("channel", F.when(F.col("read_number") == 4, 9).otherwise(F.col("channel"))).withColumn("signal", F.when(F.col("read_number") == 6, F.array(F.lit(1).cast("smallint"))).otherwise(F.col("signal")))
    write(edited, f"{tmp_path}/edited")
    found = dict(rows(differences(a, ReadStore(spark, f"{tmp_path}/edited")).select(F.hex("read_id"), "fields")))
    assert found == {f"{4:032X}": ["channel"], f"{6:032X}": ["num_samples", "signal"]}
    twice = Repacker(spark)
    out = twice.add_output(f"{tmp_path}/twice.container")
    twice.add_all(out, a)
    twice.add_all(out, a)
    with pytest.raises(DuplicateReads):
        twice.finish()
    assert not os.path.exists(tmp_path / "twice.container")
    with pytest.raises(FileExistsError):
        Repacker(spark).add_output(f"{tmp_path}/a.container")


def test_copies_keep_the_order_of_reads(spark, tmp_path):
    from strandlake.operators.route import routed_for_writing
    from strandlake.sources.repack import differences

    file = form.ContainerFile(f"{tmp_path}/a.container", reads_batch=40)
    for k in range(300):  # each id ten times
        file.add(read(k % 30, read_number=k), INFO, np.full(k % 7, k, np.int16))
    file.close()
    store, place = ReadStore(spark, f"{tmp_path}/a.container"), ["_file", "_batch", "_row"]
    write(store.complete().withColumn("dest", F.lit("a.container")), f"{tmp_path}/again")
    again = ReadStore(spark, f"{tmp_path}/again")
    assert [r.read_number for r in again.table("reads").orderBy(*place).collect()] == list(range(300))
    assert differences(store, again).count() == 0
    # outputs beyond what a container takes are cut in that order too, and no part holds more
    to = F.when(F.col("read_number") < 20, "few.container").when(F.col("read_number") % 2 == 0, "even.container").otherwise("odd.container")
    routed = routed_for_writing(store.table("reads", ["read_number", *place]).withColumn("dest", to), 70, place)
    assert set(routed.columns) == {"read_number", *place, "dest"}
    parts = {}
    for r in routed.collect():
        parts.setdefault(r.dest, []).append(r.read_number)
    even, odd = list(range(20, 300, 2)), list(range(21, 300, 2))
    assert parts == {"few.container": list(range(20)), "even-00000.container": even[:70], "even-00001.container": even[70:], "odd-00000.container": odd[:70], "odd-00001.container": odd[70:]}


def test_unknown_times_stay_null(spark, tmp_path):
    epoch = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    file = form.ContainerFile(f"{tmp_path}/a.container")
    for k, at in enumerate([None, epoch]):
        file.add(read(k, run_info=f"a{k}"), INFO | {"acquisition_id": f"a{k}", "protocol_start_time": at})
    file.close()
    store = ReadStore(spark, f"{tmp_path}/a.container")
    write(store.complete().withColumn("dest", F.lit("a.container")), f"{tmp_path}/again")
    for found in (store, ReadStore(spark, f"{tmp_path}/again")):
        times = found.run_info().select("acquisition_id", F.unix_millis("acquisition_start_time"), F.unix_millis("protocol_start_time"))
        assert rows(times) == [("a0", 1557745903000, None), ("a1", 1557745903000, 0)]
    # the place of a null holds 0, as readers that know of no nulls take it
    opened = pa.ipc.open_file(form.table_file(f := form.open_random(f"{tmp_path}/a.container"), form.parse_footer(f).tables[form.RUN_INFO]))
    assert np.frombuffer(opened.get_batch(0).column("protocol_start_time").buffers()[1], np.int64)[0] == 0
