"""All evidence tables of one stream, advancing together (ST4).

A micro-batch is stored once, the tables made from it are written each below its batch, the batch's counters are
taken from what was written, and then one small file, put in place by a rename, commits them all.  Readers take the
batches that have one.  A batch that Spark repeats after a crash is left alone if it was committed, else written again
from the start; so the tables and the counters (A1) hold every batch once or not at all.

Counters are additive: tracks are counted at their first hit and represented tracks at their first representation, so
a batch costs its own rows and no table is counted again.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..schemas import TABLES, conform

ADDED = (
    "frames_processed", "detections_emitted", "track_observations_emitted", "unique_tracks", "representations_emitted", "represented_tracks",
    "anomaly_observations_emitted", "anomalies_flagged", "events_emitted", "alerts_emitted",
)
COUNTERS = "run_id string, first struct<ordinal:bigint, number:bigint>, last struct<ordinal:bigint, number:bigint>, " + ", ".join(f"{c} bigint" for c in ADDED)


def _counted(name: str, df: DataFrame) -> dict:
    """Aggregates of one table's rows of a run."""
    rows = F.count("*")
    if name == "frames":
        place = F.struct(F.col("frame_ordinal").alias("ordinal"), F.col("frame_number").alias("number"))
        return {"frames_processed": rows, "first": F.min(place), "last": F.max(place)}
    return {
        "detections": {"detections_emitted": rows},
        "tracks": {"track_observations_emitted": rows, "unique_tracks": F.count_if(F.col("hits") == 1)},
        "representations": {"representations_emitted": rows, "represented_tracks": F.count_if(F.col("previous_cosine_similarity").isNull())},
        "anomalies": {"anomaly_observations_emitted": rows, "anomalies_flagged": F.count_if("is_anomaly")},
        "events": {"events_emitted": rows},
        "alerts": {"alerts_emitted": rows},
    }[name]


class EvidenceLedger:
    """Tables, counters and commits below one folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _commit_file(self, batch: str) -> str:
        return f"{self.root}/_commits/{batch}.json"

    def is_committed(self, batch: str) -> bool:
        fs, path = self._fs()
        return fs.exists(path(self._commit_file(batch)))

    def commits(self) -> DataFrame:
        """``batch, rows`` of the committed batches."""
        fs, path = self._fs()
        schema = "batch string, rows map<string, bigint>"
        if not fs.exists(path(f"{self.root}/_commits")):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("pathGlobFilter", "*.json").json(f"{self.root}/_commits")

    def _committed(self, folder: str, schema) -> DataFrame:
        fs, path = self._fs()
        if not fs.exists(path(f"{self.root}/{folder}")):
            return self.spark.createDataFrame([], schema)
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) if not isinstance(schema, str) else schema
        rows = self.spark.read.schema(f"{names}, batch string").option("basePath", f"{self.root}/{folder}").parquet(f"{self.root}/{folder}")
        return rows.join(self.commits().select("batch"), "batch", "left_semi").drop("batch")

    def table(self, name: str) -> DataFrame:
        """The committed rows of an evidence table."""
        return self._committed(name, TABLES[name])

    def counters(self) -> DataFrame:
        """What :func:`..operators.summaries.run_counters` gives for the committed tables."""
        held = self._committed("_counters", COUNTERS)
        sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ADDED]
        whole = held.groupBy("run_id").agg(F.min("first").alias("_first"), F.max("last").alias("_last"), *sums)
        return whole.select("run_id", "frames_processed", F.col("_first.number").alias("first_frame_number"), F.col("_last.number").alias("last_frame_number"), *ADDED[1:])

    def write(self, batch: str, tables: Mapping[str, DataFrame]) -> bool:
        """Write and commit a batch; False if that was done before."""
        if self.is_committed(batch):
            return False
        parts, rows = [], {}
        for name, df in tables.items():
            folder = f"{self.root}/{name}/batch={batch}"
            conform(df, TABLES[name]).write.mode("overwrite").parquet(folder)
            written = self.spark.read.schema(TABLES[name]).parquet(folder)
            parts.append(written.groupBy("run_id").agg(*[c.alias(n) for n, c in _counted(name, written).items()]))
        if parts:
            stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            have = set(stacked.columns)
            ends = [(F.min if c == "first" else F.max)(F.col(c) if c in have else F.lit(None).cast("struct<ordinal:bigint, number:bigint>")).alias(c) for c in ("first", "last")]
            sums = [(F.sum(c) if c in have else F.lit(None)).cast("bigint").alias(c) for c in ADDED]
            counters = f"{self.root}/_counters/batch={batch}"
            stacked.groupBy("run_id").agg(*ends, *sums).write.mode("overwrite").parquet(counters)
            total = self.spark.read.schema(COUNTERS).parquet(counters).agg(*[F.sum(c).alias(c) for c in ADDED]).first()
            rows = {k: int(v) for k, v in total.asDict().items() if v is not None}
        self._commit(batch, rows)
        return True

    def _commit(self, batch: str, rows: Mapping[str, int]) -> None:
        fs, path = self._fs()
        draft, final = path(f"{self.root}/_commits/.{batch}.draft"), path(self._commit_file(batch))
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"batch": batch, "rows": rows}).encode()))
        out.close()
        if not fs.rename(draft, final) and not fs.exists(final):
            raise OSError(f"batch {batch} could not be committed")


def evidence_sink(
    stream: DataFrame, derive: Callable[[DataFrame], Mapping[str, DataFrame]], ledger: EvidenceLedger, checkpoint: str, *, name: str = "stream"
) -> DataStreamWriter:
    """A writer that puts ``derive(batch)`` (evidence tables by name) into ``ledger``, each batch once.

    ``name`` tells streams with one ledger apart.  The batch is stored before tables are made from it, so a stateful
    stream runs once per batch however many tables there are.
    """

    def write(batch: DataFrame, number: int) -> None:
        key = f"{name}-{number:012d}"
        if ledger.is_committed(key):
            return
        folder = f"{ledger.root}/_batches/batch={key}"
        batch.write.mode("overwrite").parquet(folder)
        ledger.write(key, derive(batch.sparkSession.read.schema(batch.schema).parquet(folder)))

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)
