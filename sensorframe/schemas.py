"""Table contracts.  Every relation is keyed by ``run_id``."""

from __future__ import annotations

from pyspark.sql import types as T

# Vocabularies and column names of the tables, which readers and writers share with other tools
MODALITIES = ("EO", "IR", "OTHER")
SEVERITIES = ("info", "warning", "critical")  # rank = position


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "array<float>": T.ArrayType(T.FloatType()),
    "array<double>": T.ArrayType(T.DoubleType()),
    "labels": T.MapType(T.StringType(), T.StringType()),
}


def _s(spec: str) -> T.StructType:
    """``"name type, name type"`` to a StructType, usable before a session exists."""
    pairs = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


FRAMES = _s(
    "run_id string, frame_id string, frame_number bigint, frame_ordinal bigint, timestamp_s double, "
    "image_path string, width int, height int, sensor_id string, modality string, source_path string"
)
DETECTIONS = _s(
    "run_id string, frame_ordinal bigint, frame_number bigint, timestamp_s double, detection_index bigint, "
    "label string, object_id bigint, scenario_role string, confidence double, detector string, "
    "sensor_id string, modality string, source_path string, x1 int, y1 int, x2 int, y2 int"
)
TRACKS = _s(
    "run_id string, frame_ordinal bigint, frame_number bigint, timestamp_s double, track_id bigint, "
    "label string, confidence double, hits bigint, duration_s double, first_frame_number bigint, "
    "first_timestamp_s double, scenario_role string, tracker string, sensor_id string, modality string, "
    "source_path string, x1 int, y1 int, x2 int, y2 int, detection_object_id bigint"
)
REPRESENTATIONS = _s(
    "run_id string, embedding_row bigint, frame_ordinal bigint, frame_number bigint, timestamp_s double, "
    "track_id bigint, label string, track_hits bigint, embedding_dim int, embedding_norm double, "
    "previous_cosine_similarity double, representation_change double, source string, sensor_id string, "
    "modality string, source_path string, x1 int, y1 int, x2 int, y2 int, embedding array<float>"
)
ANOMALIES = _s(
    "run_id string, frame_ordinal bigint, frame_number bigint, timestamp_s double, track_id bigint, "
    "label string, score double, threshold double, margin double, is_anomaly boolean, source string, "
    "sensor_id string, modality string, source_path string, metadata string"
)
EVENTS = _s(
    "run_id string, event_id string, frame_ordinal bigint, frame_number bigint, timestamp_s double, "
    "event_type string, severity string, track_id bigint, label string, confidence double, source string, "
    "message string, metadata string"
)
ALERTS = _s(
    "run_id string, alert_id string, event_id string, frame_ordinal bigint, frame_number bigint, "
    "timestamp_s double, alert_type string, severity string, track_id bigint, label string, "
    "confidence double, source string, message string, metadata string"
)
BBOX = _s("x1 double, y1 double, x2 double, y2 double")
EVIDENCE = _s(
    "run_id string, run_dir string, sensor_id string, modality string, event_id string, frame_number bigint, "
    "timestamp_s double, event_type string, severity string, source string, track_id bigint, label string, "
    "confidence double"
).add("bbox", BBOX)
FUSION_CONTRIBUTORS = (
    "fusion_event_id", "run_dir", "run_id", "sensor_id", "modality", "event_id", "frame_number",
    "timestamp_s", "event_type", "severity", "track_id", "label", "confidence", "x1", "y1", "x2", "y2",
    "time_delta_from_fused_s",
)
NATIVE_ANNOTATIONS = _s(
    "frame_index bigint, target_id bigint, bbox_left double, bbox_top double, bbox_width double, "
    "bbox_height double, score double, object_category int, truncation int, occlusion int"
)
GROUND_TRUTH = _s(
    "run_id string, frame_index bigint, target_id bigint, label string, object_category int, score double, "
    "truncation int, occlusion int, ignored boolean, x1 int, y1 int, x2 int, y2 int"
)
REFERENCE = _s(
    "format_version int, embedder_name string, centroid array<double>, embedding_dim int, threshold double, "
    "sample_count bigint, quantile double, metadata labels"
)
MATCH_COLUMNS = (
    "run_id", "frame_number", "shared_class", "status", "prediction_index", "prediction_label",
    "prediction_confidence", "pred_x1", "pred_y1", "pred_x2", "pred_y2", "ground_truth_index",
    "ground_truth_label", "ground_truth_target_id", "gt_x1", "gt_y1", "gt_x2", "gt_y2", "iou",
)

TABLES = {
    "frames": FRAMES,
    "detections": DETECTIONS,
    "tracks": TRACKS,
    "representations": REPRESENTATIONS,
    "anomalies": ANOMALIES,
    "events": EVENTS,
    "alerts": ALERTS,
}


def conform(df, schema: T.StructType):
    """Project ``df`` on ``schema``: fixed order, casts, absent columns as null."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )
