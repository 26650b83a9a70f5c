"""Readers and writers of evidence tables.

Parquet is the table format; CSV and JSON are read and written for exchange.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import empty_to_null, nan_to_null
from ..operators.anomaly import check_reference
from ..operators.contracts import EVENT_COLUMNS, ContractError, require_sensor_runs
from ..operators.fusion import SOURCE, Fusion, FusionConfig, attach_boxes, fusion_counters
from ..runtime import materialize
from ..schemas import EVIDENCE, FRAMES, REFERENCE, SEVERITIES, TABLES, conform

# Column order of the exchange tables (without the vector column).
EXCHANGE = {
    name: [c for c in schema.names if c not in ("embedding", "frame_ordinal", "detection_index", "detection_object_id")]
    for name, schema in TABLES.items()
}


# Fields of a manifest's metadata
METADATA = ["run_id", "ground_truth_scope"]
# The parts of a run, the layout of packed vectors and what a fusion takes for granted, as manifests name
# them (None: whether a spatial gate is set)
BACKENDS = ["detector_backend", "tracker_backend", "representation_analyzer", "anomaly_analyzer", "event_detector", "anomaly_event_detector", "alert_policy"]
VECTOR_LAYOUT = {"embedding_dtype": "float32", "byte_order": "little-endian", "storage_order": "row-major"}
ASSUMPTIONS = {
    "fusion_level": "semantic_event_late_fusion", "raw_pixels_fused": False, "feature_vectors_fused": False, "pixel_registration_required": None, "confidence_recalibrated": False,
}
# RFC 4180 quoting, for readers and writers
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


#: The most columns a CSV file may have.
WIDEST = 64
PART = re.compile(r"part-(\d+)\.csv$")


def _by_name(columns: Sequence[str] | None, required: Sequence[str]):
    """Cells under the names of their file's first row; with ``columns`` None, the names themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, names, row = None, {}, 0
        for batch in batches:
            files = batch.column("_file")
            changed = pc.not_equal(files.slice(1), files.slice(0, max(len(files) - 1, 0))).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(changed) + 1).tolist(), len(files)] if len(files) else [0]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if files[lo].as_py() != file:
                    file, part = files[lo].as_py(), PART.search(files[lo].as_py())
                    row = int(part.group(1)) << 40 if part else 0
                    head = [(batch.column(i)[lo].as_py() or "").lstrip("\ufeff") for i in range(WIDEST + 1)]
                    if head[WIDEST]:
                        raise ContractError(f"{file} has more than {WIDEST} columns")
                    names = {name: i for i, name in reversed(list(enumerate(head))) if name}
                    missing = sorted(set(required) - set(names))
                    if missing:
                        raise ContractError(f"{file} is missing required columns: {', '.join(missing)}")
                    if columns is None:
                        yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.string())], ["name"])
                    lo += 1
                if columns is not None and hi > lo:
                    cells = [batch.column(names[c]).slice(lo, hi - lo) if c in names else pa.nulls(hi - lo, pa.string()) for c in columns]
                    place = pa.array(np.arange(row, row + hi - lo))
                    yield pa.RecordBatch.from_arrays([*cells, files.slice(lo, hi - lo), place], [*columns, "_file", "_position"])
                row += hi - lo

    return run


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None, required: Sequence[str] = ()) -> DataFrame:
    """Text columns of CSV files by name, whatever their order in each file, with ``_file`` and ``_position`` (the row).

    One pass: a file is read by one task in its order, and its first row names the columns for the rows behind it, so
    there is neither a job per header nor a list of paths.  A column that a file lacks is null there, or an error if
    it is among ``required``.  Without ``columns`` the names are found by a pass of their own.
    """
    cells = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(WIDEST + 1)])
    raw = spark.read.options(**{**CSV, "header": False}).schema(cells).csv(path).withColumn("_file", F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B"))))
    if columns is None:
        columns = sorted(r.name for r in raw.mapInArrow(_by_name(None, required), "name string").distinct().collect())
    fields = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("_file", T.StringType()), T.StructField("_position", T.LongType())])
    return raw.mapInArrow(_by_name(list(columns), list(required)), fields)


def read_table(spark: SparkSession, name: str, path: str, *, fmt: str = "parquet") -> DataFrame:
    """One evidence table with its declared schema; extra columns are ignored."""
    schema = TABLES[name]
    if fmt == "parquet":
        return spark.read.schema(schema).parquet(path)
    return conform(read_csv(spark, path, schema.names), schema)


def read_frames(spark: SparkSession, path: str, *, fmt: str = "parquet") -> DataFrame:
    """Frame manifests."""
    if fmt == "parquet":
        return spark.read.schema(FRAMES).parquet(path)
    return conform(read_csv(spark, path, FRAMES.names), FRAMES)


def write_evidence(tables: Mapping[str, DataFrame], path: str, *, fmt: str = "parquet", mode: str = "errorifexists"):
    """Write evidence tables below ``path``, one folder per table, split by ``run_id`` (K1).

    Every table is written with its declared columns, also when it has no rows.
    """
    for name, df in tables.items():
        out = conform(df, TABLES[name])
        if fmt == "csv":
            flat = out.select("run_id", *[c for c in EXCHANGE[name] if c != "run_id"])
            flat.write.mode(mode).options(header=True, quote='"', escape='"').csv(f"{path}/{name}")
        else:
            out.write.mode(mode).partitionBy("run_id").parquet(f"{path}/{name}")


def write_tables(tables: Mapping[str, DataFrame], path: str, *, mode: str = "errorifexists") -> None:
    """Fusion and evaluation result tables (K2, K3)."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def write_document(row: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Manifest documents: one JSON line per row (K5)."""
    row.write.mode(mode).option("ignoreNullFields", "false").json(path)


def run_manifest(
    counters: DataFrame, runs: DataFrame, *, options: Mapping[str, str] | None = None, backends: Mapping[str, str] | None = None, render_fps: float | None = None
) -> DataFrame:
    """Counters joined with run metadata, the options and the parts that made the run (K5).

    ``backends`` names them by :data:`BACKENDS`; a part that isn't named is null, as one that wasn't used.
    """
    unknown = sorted(set(backends or {}) - set(BACKENDS))
    if unknown:
        raise ValueError(f"unknown parts of a run: {unknown}")
    fields = [F.lit(v) for kv in sorted((options or {}).items()) for v in kv]
    chosen = F.create_map(*fields) if fields else F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
    named = {} if backends is None else {b: F.lit(backends.get(b)).cast("string") for b in BACKENDS}
    if render_fps is not None:
        named["render_fps"] = F.lit(float(render_fps))
    return runs.join(counters, "run_id", "left").withColumns({"options": chosen, **named})


def representation_manifest(representations: DataFrame, runs: DataFrame, *, analyzer: str | None, configuration: Mapping[str, str] | None = None) -> DataFrame:
    """One document per run of ``runs`` on its representations (K5), also for runs without any."""
    tracks = representations.groupBy("run_id", "track_id").agg(F.count("*").alias("_n"), F.max("embedding_dim").alias("_dim"))
    counted = tracks.groupBy("run_id").agg(F.sum("_n").alias("observations"), F.count("track_id").alias("represented_tracks"), F.max("_dim").alias("embedding_dimension"))
    settings = [F.lit(v) for kv in sorted((configuration or {}).items()) for v in kv]
    none = F.lit(None).cast("map<string,string>")
    return runs.select("run_id").join(counted, "run_id", "left").select(
        "run_id", F.lit(1).alias("format_version"), F.lit(analyzer is not None).alias("enabled"), F.lit(analyzer).cast("string").alias("analyzer"),
        (F.create_map(*settings) if settings else none).alias("configuration"), F.coalesce("observations", F.lit(0)).cast("long").alias("observations"),
        F.coalesce("represented_tracks", F.lit(0)).cast("long").alias("represented_tracks"), "embedding_dimension", *[F.lit(v).alias(k) for k, v in VECTOR_LAYOUT.items()])


def fusion_manifest(evidence: DataFrame, manifests: DataFrame, fusion: Fusion, config: FusionConfig, *, fusion_id: str) -> DataFrame:
    """The document of one fusion as one row (K5): inputs with their digests, counts, options and assumptions.

    ``inputs`` has an entry per run, so the row grows with the number of runs, not of events.
    """
    events = evidence.groupBy("run_id").agg(F.count("*").alias("events"))
    given = [c for c in ("run_dir", "run_id", "sensor_id", "modality", "manifest_sha256") if c in manifests.columns]
    each = manifests.select(*given).join(events, "run_id", "left").select(*given, F.coalesce("events", F.lit(0)).alias("events"))
    inputs = each.agg(F.sort_array(F.collect_list(F.struct("run_id", *[c for c in given if c != "run_id"], "events"))).alias("inputs"))
    options = {k: "" if v is None else str(v) for k, v in sorted(asdict(config).items())}
    effective = F.create_map(*[F.lit(v) for kv in options.items() for v in kv])
    digest = hashlib.sha256(json.dumps(options, sort_keys=True).encode()).hexdigest()
    registered = config.spatial_iou_threshold is not None
    assumed = F.struct(*[F.lit(registered if v is None else v).alias(k) for k, v in ASSUMPTIONS.items()])
    return fusion_counters(evidence, fusion).crossJoin(inputs).select(
        F.lit(fusion_id).alias("fusion_id"), F.lit(SOURCE).alias("strategy"), "inputs", "distinct_sensors", "input_events", "fused_events", "fused_alerts", "contributors",
        effective.alias("effective_config"), F.lit(digest).alias("config_sha256"), assumed.alias("assumptions"))


def write_manifests(manifests: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """One JSON document per run in a folder of its own, as ``read_manifests`` expects it (K5).

    Columns named in ``METADATA`` go into the document's ``metadata``; all others stay at the top.
    """
    top = [c for c in manifests.columns if c not in METADATA]
    inner = F.struct(*[c for c in METADATA if c in manifests.columns])
    document = F.to_json(F.struct(*top, inner.alias("metadata")), {"ignoreNullFields": "false"})
    laid_out = manifests.select(document.alias("value"), F.col("run_id").alias("run")).repartition("run")
    laid_out.write.mode(mode).partitionBy("run").text(path)


def write_reference(reference: DataFrame, path: str, *, mode: str = "errorifexists") -> None:
    """Anomaly reference as a one-row table (K6)."""
    check_reference(reference)
    reference.write.mode(mode).parquet(path)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    reference = spark.read.schema(REFERENCE).parquet(path)
    check_reference(reference)
    return reference


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Run manifests (JSON documents) of many runs, with the digest of each file.

    Digests are taken per file on the executors.
    """
    schema = T.StructType(
        [
            T.StructField("sensor_id", T.StringType()),
            T.StructField("modality", T.StringType()),
            T.StructField("input_source", T.StringType()),
            T.StructField("status", T.StringType()),
            T.StructField("created_at", T.StringType()),
            T.StructField("frames_processed", T.LongType()),
            T.StructField(
                "metadata",
                T.StructType(
                    [T.StructField("run_id", T.StringType()), T.StructField("ground_truth_scope", T.StringType())]
                ),
            ),
        ]
    )
    files = spark.read.format("binaryFile").load(path)
    parsed = files.select(
        F.regexp_replace(F.col("path"), r"/[^/]+$", "").alias("run_dir"),
        F.sha2("content", 256).alias("manifest_sha256"),
        F.from_json(F.col("content").cast("string"), schema).alias("m"),
    )
    return parsed.select(
        F.coalesce(F.col("m.metadata.run_id"), F.element_at(F.split("run_dir", "/"), -1)).alias("run_id"),
        "run_dir",
        F.trim(F.coalesce(F.col("m.sensor_id"), F.lit(""))).alias("sensor_id"),
        F.col("m.modality").alias("modality"),
        F.col("m.input_source").alias("input_source"),
        F.col("m.status").alias("status"),
        F.col("m.created_at").alias("created_at"),
        F.col("m.metadata.ground_truth_scope").alias("ground_truth_scope"),
        "manifest_sha256",
    )


def evidence_from_runs(events: DataFrame, manifests: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """Events of completed runs with sensor identity and track boxes."""
    run = manifests.select(
        "run_id", "sensor_id", "modality",
        (F.col("run_dir") if "run_dir" in manifests.columns else F.lit(None).cast("string")).alias("run_dir"),
    )
    typed = events.withColumns(
        {
            "label": empty_to_null(F.col("label")),
            "confidence": nan_to_null(F.col("confidence")),
            "track_id": F.col("track_id").cast("long"),
        }
    )
    boxed = attach_boxes(typed, tracks) if tracks is not None else typed
    known = boxed.drop("sensor_id", "modality", "run_dir").join(run.withColumn("_known", F.lit(True)), "run_id", "left")
    return conform(known.filter(_usable()), EVIDENCE)


def _usable() -> Column:
    """True; raises for an event whose run has no manifest, or that breaks the sensor contract."""
    faults = [
        (F.col("_known").isNull(), F.format_string("no manifest for run %s", "run_id")),
        (F.coalesce("sensor_id", F.lit("")) == "", F.format_string("the manifest of run %s names no sensor", "run_id")),
        (~F.coalesce("severity", F.lit("")).isin(*SEVERITIES), F.format_string("event %s of run %s has severity %s", "event_id", "run_id", "severity")),
    ]
    fine = F.lit(True)
    for broken, message in reversed(faults):
        fine = F.when(broken, F.raise_error(message).cast("boolean")).otherwise(fine)
    return fine


def read_evidence(spark: SparkSession, root: str) -> DataFrame:
    """Evidence of every run below ``root/<run>/`` (events.csv, tracks.csv, run_manifest.json).

    A table may be a folder of ``part-*.csv`` files.  Manifests are checked at once (V2): a sensor, a known modality and
    an ``events.csv`` for each; so is a required column that a file of events lacks, as events are stored once.  A file of
    tracks without one, or an event of unknown severity, raises when the result is read.
    """
    manifests = read_manifests(spark, f"{root}/*/run_manifest.json")
    folder = F.regexp_extract("path", r"/([^/]+)/events\.csv(/[^/]+)?$", 1)
    listed = spark.read.format("binaryFile").load(f"{root}/*/events.csv").select(folder.alias("_dir")).distinct()
    ids = manifests.select("run_id", F.element_at(F.split("run_dir", "/"), -1).alias("_dir"))
    require_sensor_runs(manifests, ids.join(listed, "_dir", "left_anti"))

    def table(name: str, columns: Sequence[str], required: Sequence[str]) -> DataFrame:
        found = read_csv(spark, f"{root}/*/{name}.csv", [c for c in columns if c != "run_id"], required)
        return found.withColumn("_dir", F.regexp_extract("_file", rf"/([^/]+)/{name}\.csv(/[^/]+)?$", 1))

    found = table("events", TABLES["events"].names, EVENT_COLUMNS).join(ids, "_dir", "left").withColumn("run_id", F.coalesce("run_id", "_dir"))
    whole = {c: F.col(c).cast("double").cast("long") for c in ("frame_number", "track_id")}
    events = found.withColumns({"frame_number": F.col("frame_number").cast("long"), "track_id": whole["track_id"]})
    # used twice, for the keys of boxes and for the rows: stored, so that text is parsed once
    events = materialize(events.drop("_file", "_position", "_dir"), "evidence-events")
    boxes = ("frame_number", "track_id", "x1", "y1", "x2", "y2")
    return evidence_from_runs(events, manifests, table("tracks", boxes, boxes).join(ids, "_dir").withColumns(whole))
