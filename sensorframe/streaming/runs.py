"""Start, finish and read back evidence streams (ST4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import scratch_path

# Sources count seconds from their start.  Event times are moved off the epoch,
# because a row at or before the initial watermark (0) would count as late.
EPOCH_S = 86_400

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_time(seconds: str = "timestamp_s") -> Column:
    return F.timestamp_seconds(F.col(seconds) + EPOCH_S)


def end_marks(spark: SparkSession, schema: T.StructType, timestamp_s: float, run_ids: list[str | None] = [None]) -> DataFrame:
    """Rows that say that nothing before ``timestamp_s`` will come: all null but the time and, if given, the run.

    A stream that sends one as its last row decides and emits all that waited
    for the watermark.  A mark with a run's id ends that run.
    """
    rows = [tuple({"run_id": run, "timestamp_s": float(timestamp_s)}.get(f.name) for f in schema) for run in run_ids]
    return spark.createDataFrame(rows, T.StructType([T.StructField(f.name, f.dataType) for f in schema]))


def use_rocksdb(spark: SparkSession) -> None:
    """Stateful processors keep their state in RocksDB, off the JVM heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def write_evidence_stream(stream: DataFrame, path: str, checkpoint: str, *, partition_by: str | None = None):
    """Append evidence rows as Parquet; exactly once through the file sink's log."""
    writer = stream.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    return writer.option("path", path)


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process everything available, then read the sink as a table."""
    spark = stream.sparkSession
    use_rocksdb(spark)
    path = scratch_path(spark, name)
    write_evidence_stream(stream, path, scratch_path(spark, f"{name}-checkpoint")).trigger(
        availableNow=True
    ).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
