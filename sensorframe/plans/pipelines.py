"""End-to-end jobs: one run pipeline, fusion of runs, evaluation, reference fitting."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.anomaly import fit_reference, score_anomalies
from ..operators.contracts import (
    ContractError,
    evaluation_scope_violations,
    known_severities,
    require_fusion_inputs,
    require_sensor_runs,
)
from ..operators.evaluation import Evaluation, evaluate, restrict_to_frames
from ..operators.events import (
    alerts_from_events,
    dwell_events,
    persistent_anomaly_events,
    role_events,
    union_events,
)
from ..operators.fusion import Fusion, FusionConfig, fuse_events
from ..operators.representations import representation_changes, sample_tracks
from ..operators.summaries import run_counters
from ..operators.tracking import track_detections
from ..runtime import materialize


@dataclass(frozen=True)
class RunOptions:
    """Defaults of one sensor run."""

    iou_threshold: float = 0.30
    max_missed_updates: int = 2
    representation: dict = field(default_factory=dict)
    anomaly: dict = field(default_factory=dict)
    min_consecutive: int = 3
    anomaly_severity: str = "warning"
    roles: bool = True
    dwell: dict | None = None
    minimum_severity: str = "warning"


def run_pipeline(
    frames: DataFrame,
    detections: DataFrame,
    options: RunOptions | None = None,
    *,
    embed=None,
    embedder_name: str = "embedder",
    reference: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All evidence tables of the runs in ``frames`` / ``detections``.

    ``embed`` adds an ``embedding`` column to track observations (see
    ``hooks.encode_with``).  Tracks feed up to five consumers and are stored once.
    """
    o = options or RunOptions()
    tracks = materialize(
        track_detections(detections, iou_threshold=o.iou_threshold, max_missed_updates=o.max_missed_updates),
        "run-tracks",
    )
    tables = {"frames": frames, "detections": detections, "tracks": tracks}
    sized = tracks.join(frames.select("run_id", "frame_ordinal", "width", "height"), ["run_id", "frame_ordinal"])
    producers = []
    if embed is not None:
        sampled = embed(sample_tracks(sized, **o.representation))
        tables["representations"] = representation_changes(sampled, source=embedder_name)
    if o.roles:
        producers.append(role_events(tracks))
    if o.dwell is not None:
        producers.append(dwell_events(tracks, **o.dwell))
    if embed is not None and reference is not None:
        tables["anomalies"] = materialize(
            score_anomalies(embed(sized), reference, embedder_name=embedder_name, **o.anomaly), "run-anomalies"
        )
        producers.append(
            persistent_anomaly_events(
                tables["anomalies"], min_consecutive=o.min_consecutive, severity=o.anomaly_severity
            )
        )
    if producers:
        tables["events"] = union_events(*producers)
        tables["alerts"] = alerts_from_events(tables["events"], minimum_severity=o.minimum_severity)
    return tables


def run_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Counters of :func:`run_pipeline` output."""
    return run_counters(**tables)


def fuse_runs(evidence: DataFrame, manifests: DataFrame, config: FusionConfig | None = None) -> Fusion:
    """Check the sensor contract of the runs, then fuse their events."""
    config = config or FusionConfig()
    require_sensor_runs(manifests)
    require_fusion_inputs(manifests, min_sensors=config.min_sensors)
    return fuse_events(known_severities(evidence), config)


def evaluate_runs(
    predictions: DataFrame, ground_truth: DataFrame, manifests: DataFrame, frames: DataFrame | None = None,
    *, iou_threshold: float = 0.50,
) -> Evaluation:
    """Evaluate runs whose ground truth is declared to cover processed frames only."""
    broken = evaluation_scope_violations(manifests).filter("violations > 0").limit(3).collect()
    if broken:
        raise ContractError(f"ground truth scope is not processed_frames for runs {[b.run_id for b in broken]}")
    truth = ground_truth if frames is None else restrict_to_frames(ground_truth, frames)
    return evaluate(predictions, truth, iou_threshold=iou_threshold)


def build_reference(crops: DataFrame, embed, *, embedder_name: str, quantile: float = 0.95) -> DataFrame:
    """Embed curated normal crops and fit the reference."""
    vectors = materialize(embed(crops).select("embedding"), "reference-vectors")
    return fit_reference(vectors, embedder_name=embedder_name, quantile=quantile,
                         metadata={"source_image_count": str(vectors.count())})
