import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F
from strandlake import session
from strandlake.operators import intervals
from strandlake.operators.ordered_scan import Scan, column, ordered_scan


def test_a_scan_within_a_union_carries_its_own_states(spark):
    data = [("a", 1, 1, k, 1) for k in range(0, 500, 2)]
    found = intervals.gaps(spark.createDataFrame(data, "run_info string, channel int, well smallint, start bigint, num_samples bigint"))
    assert len(rows(found)) == 249
    assert len(rows(found.union(found).union(found))) == 3 * 249


def test_states_are_carried_through_two_thousand_partitions(spark):
    class Count(Scan):
        schema = "value long, place long"

        def step(self, state, batch):
            before = state or 0
            place = pa.array(range(before, before + batch.num_rows), pa.int64())
            return before + batch.num_rows, pa.RecordBatch.from_arrays([column(batch, "value"), place], names=["value", "place"])

        def merge(self, carry, local):
            return carry + local

    rows_ = spark.range(6000).select((F.col("id") * 7919 % 6000).alias("value"))
    found = ordered_scan(rows_, ["value"], Count(), partitions=2000)
    assert found.agg(F.count(F.lit(1)), F.sum(F.expr("if(value = place, 0, 1)"))).first()[:] == (6000, 0)


def test_partitions_grow_with_the_bytes_read(spark, tmp_path, monkeypatch):
    spark.range(20_000).selectExpr("id", "uuid() AS a", "uuid() AS b").write.parquet(f"{tmp_path}/t")
    whole = spark.read.parquet(f"{tmp_path}/t")
    size = session.estimated_bytes(whole)
    assert size > 500_000 and session.estimated_bytes(whole.select("id")) < size / 3
    # joins aren't multiplied
    assert session.estimated_bytes(whole.join(whole.withColumnRenamed("id", "i"), F.col("id") == F.col("i"))) < 3 * size
    assert session.partitions_for(whole) is None
    monkeypatch.setattr(session, "PARTITION_BYTES", 10_000)
    assert session.partitions_for(whole) == size // 10_000
    monkeypatch.setattr(session, "MAX_PARTITIONS", 30)
    assert session.partitions_for(whole) == 30


def test_a_cluster_must_name_its_shared_folder(monkeypatch):
    class Context:
        master = "spark://somewhere"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            return type("None_", (), {"isDefined": staticmethod(lambda: False)})

    fake = type("Session", (), {"sparkContext": Context, "conf": {}})
    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        session.shared_dir(fake)
