"""Session helpers: where intermediate tables live and how they are cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()
MOST_BUCKETS = 96  # each task that writes a bucketed table makes so many files
FEW_ROWS = 200_000  # of a short list of keys, a few tens of bytes each


def ship(spark: SparkSession) -> None:
    """Give Python workers this package, once per application.

    The archive is made in the driver's own temporary folder; Spark copies it to every executor.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="sensorframe-ship-"), "sensorframe.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    spark.sparkContext.addPyFile(archive)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # a worker's memory then doesn't depend on how long the rows of a table are
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    shared_dir(spark)
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Where it is unset, a folder below the warehouse is used: the warehouse, too,
    has to be shared by all executors.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    sc.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    return f"{shared_dir(spark)}/sensorframe/{name}-{uuid.uuid4().hex}"


def task_count(spark: SparkSession) -> int:
    """How many tasks share work that Python does, however few bytes it has."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BUCKETS)


def few(df: DataFrame) -> DataFrame:
    """A stored list of keys, sent to every task where it is short, so that a join with it moves nothing else."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def materialize_buckets(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Write ``df`` once as a table bucketed by ``keys``, so that grouping by them needs no shuffle.

    The rows lie in Parquet, where equal columns cost next to nothing; a shuffle writes every row whole.
    The table is external, below the shared folder, and its name is never used again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"sensorframe_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").option("compression", "zstd").option("path", path)
    writer.bucketBy(task_count(spark), *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage durably: a lost executor re-reads files instead of
    re-running the operator, and later readers prune columns and partitions.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
