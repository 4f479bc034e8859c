"""Session helpers: tables, the shared work folder, checkpoints and size-checked broadcasts."""

from __future__ import annotations

import atexit
import importlib.util
import marshal
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it is counted to have at most so many rows.
BROADCAST_ROWS = 200_000
#: Bytes aimed at in one partition of a sorted or hashed table, and the most partitions that are made.
PARTITION_BYTES, MAX_PARTITIONS = 64 << 20, 20_000


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors' Python workers, once a context, wherever the driver found it."""
    context = spark.sparkContext
    if getattr(context, "_strandlake", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="strandlake-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/strandlake.zip", "w") as out:
        for source in sorted(root.rglob("*.py")):
            name = source.relative_to(root.parent).as_posix()
            out.write(source, name)
            # compiled as well, marked as needing no check, so workers needn't compile
            code = marshal.dumps(compile(source.read_bytes(), name, "exec"))
            out.writestr(name + "c", importlib.util.MAGIC_NUMBER + (1).to_bytes(4, "little") + bytes(8) + code)
    context.addPyFile(f"{folder}/strandlake.zip")
    # checkpoints go away with the last plan that reads them
    context._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    context._strandlake = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def on_one_machine(spark: SparkSession) -> bool:
    """Executors are threads of the driver."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or where that is unset on one machine one of our own.

    Spark makes a folder of its own for the program in it, which is removed when the program ends."""
    context = spark.sparkContext._jsc.sc()
    at = context.getCheckpointDir()
    if at.isDefined():
        return at.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not on_one_machine(spark):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="strandlake-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        named = "file://" + named
    spark.sparkContext.setCheckpointDir(named)
    own = context.getCheckpointDir().get()
    atexit.register(remove, spark, own)
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the shared folder; partitions and the order within them stay as they are."""
    ship(df.sparkSession)
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the JVM may be gone at exit
        if path.startswith("file:"):
            shutil.rmtree(path[5:].replace("//", "/", 1), ignore_errors=True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(old).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(old), path(new))


def exists(spark: SparkSession, at: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for a broadcast if it is counted to have at most so many rows; beyond it the planner joins by shuffle
    and AQE splits skewed keys. df should be cheap to compute twice, as a checkpointed aggregate is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer's statistics say of df's size: of the files read, by the width of the columns kept. Joins count as both
    sides together; what is unknown counts as nothing."""

    def of(plan: Any) -> float:
        own = float(str(plan.stats().sizeInBytes()))
        children = [plan.children().apply(i) for i in range(plan.children().size())]
        if not children:
            return own if own < 1 << 60 else 0.0
        if len(children) > 1:
            return sum(map(of, children))
        below = float(str(children[0].stats().sizeInBytes()))
        return of(children[0]) * min(own / below, 4.0) if 0 < below < 1 << 60 else of(children[0])

    return int(of(df._jdf.queryExecution().optimizedPlan()))


def partitions_for(df: DataFrame) -> int | None:
    """The partitions that a table of df's size fills; None where spark.sql.shuffle.partitions are enough (AQE joins small ones)."""
    n = min(estimated_bytes(df) // PARTITION_BYTES, MAX_PARTITIONS)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")) else None


def repartitioned(df: DataFrame, *by: Any) -> DataFrame:
    """df hashed by keys into as many partitions as it fills."""
    n = partitions_for(df)
    return df.repartition(n, *by) if n else df.repartition(*by)


def default_parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A session for tests, the bench and the command line."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("strandlake")
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("STRANDLAKE_DRIVER_MEMORY", "8g"),
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN", "spark.driver.host": "127.0.0.1", "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
