"""Data contracts as violation counts; each table is aggregated once."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_finite_vector
from ..schemas import FRAMES, MODALITIES, SEVERITIES
from .sequence import BUCKET, previous

FRAME_COLUMNS = tuple(n for n in FRAMES.names if n not in ("run_id", "frame_ordinal"))
EVENT_COLUMNS = (
    "event_id", "frame_number", "timestamp_s", "event_type", "severity", "source", "track_id", "label", "confidence",
)


class ContractError(ValueError):
    """A table does not satisfy its contract."""


def require_columns(df: DataFrame, required: Iterable[str], name: str) -> None:
    """Schema-only check (V7); no job runs."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ContractError(f"{name} is missing required columns: {', '.join(missing)}")


def _violations(df: DataFrame, keys: list[str], checks: dict[str, Column]) -> DataFrame:
    """(keys, check, violations) from one pass; a null condition counts as a violation."""
    counted = df.groupBy(*keys).agg(
        *[F.sum(F.coalesce(c, F.lit(True)).cast("long")).alias(name) for name, c in checks.items()]
    )
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])
    )
    return counted.select(*keys, pairs.alias("_v")).select(*keys, "_v.*")


def frame_manifest_violations(frames: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """Value, uniqueness and time-order violations of frame manifests, per run."""
    require_columns(frames, FRAME_COLUMNS, "frame manifest")
    values = _violations(
        frames,
        ["run_id"],
        {
            "negative_frame_number": F.col("frame_number") < 0,
            "non_positive_size": (F.col("width") <= 0) | (F.col("height") <= 0),
        },
    )
    ids = frames.groupBy("run_id", "frame_id").agg(F.count("*").alias("n"))
    duplicate = ids.groupBy("run_id").agg(F.sum((F.col("n") > 1).cast("long")).alias("violations")).select(
        "run_id", F.lit("duplicate_frame_id").alias("check"), "violations"
    )
    back = F.col("timestamp_s") < F.col("_before.timestamp_s")
    linked = previous(frames, ["run_id"], "frame_ordinal", ["timestamp_s"], "_before", bucket)
    order = linked.groupBy("run_id").agg(
        F.sum(F.coalesce(back, F.lit(False)).cast("long")).alias("violations")
    ).select("run_id", F.lit("timestamp_goes_back").alias("check"), "violations")
    return reduce(DataFrame.unionByName, [values, duplicate, order])


def missing_files(frames: DataFrame, listing: DataFrame, path: str = "image_path") -> DataFrame:
    """Frames whose image is absent from a file listing (``path`` column)."""
    present = listing.select(F.col("path").alias(path))
    return frames.join(present, path, "left_anti")


def validate_frame_manifest(frames: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Raise :class:`ContractError` on the first broken rule, else return ``frames``."""
    require_columns(frames, FRAME_COLUMNS, "frame manifest")
    if frames.isEmpty():
        raise ContractError("frame manifest contains no frames")
    broken = frame_manifest_violations(frames).filter("violations > 0").orderBy("run_id", "check").limit(3).collect()
    if broken:
        raise ContractError("; ".join(f"run {b.run_id}: {b.check} x{b.violations}" for b in broken))
    if listing is not None:
        lost = [r[0] for r in missing_files(frames, listing).select("image_path").limit(3).collect()]
        if lost:
            raise ContractError(f"frame manifest references missing files: {lost}")
    return frames


def sensor_manifest_violations(manifests: DataFrame) -> DataFrame:
    """Per run: sensor id present, modality known (V2)."""
    return _violations(
        manifests,
        ["run_id"],
        {
            "missing_sensor_id": F.trim(F.coalesce(F.col("sensor_id"), F.lit(""))) == "",
            "unsupported_modality": ~F.col("modality").isin(*MODALITIES),
        },
    )


def sensor_run_violations(events: DataFrame, manifests: DataFrame) -> DataFrame:
    """Per run: sensor id present, modality known, event severities known (V2)."""
    require_columns(events, EVENT_COLUMNS, "events")
    severities = _violations(events, ["run_id"], {"unsupported_severity": ~F.col("severity").isin(*SEVERITIES)})
    return sensor_manifest_violations(manifests).unionByName(severities)


def require_sensor_runs(manifests: DataFrame, without_events: DataFrame | None = None) -> None:
    """Raise where a run breaks V2, or is among ``without_events`` (``run_id``)."""
    broken = sensor_manifest_violations(manifests).filter("violations > 0").select("run_id", "check")
    if without_events is not None:
        broken = broken.unionByName(without_events.select("run_id", F.lit("no_events_file").alias("check")))
    found = broken.limit(4).collect()
    if found:
        raise ContractError("; ".join(f"run {b.run_id}: {b.check}" for b in found))


def known_severities(events: DataFrame) -> DataFrame:
    """``events``; a severity outside the vocabulary raises when it is read (V2)."""
    require_columns(events, EVENT_COLUMNS, "events")
    wrong = F.raise_error(F.format_string("event %s of run %s has severity %s", "event_id", "run_id", "severity")).cast("boolean")
    return events.filter(F.when(F.coalesce("severity", F.lit("")).isin(*SEVERITIES), True).otherwise(wrong))


def fusion_input_violations(manifests: DataFrame, *, min_sensors: int = 2, scope: Iterable[str] = ()) -> DataFrame:
    """Per fusion: enough runs, distinct sensors, all completed (V3)."""
    scope = list(scope)
    per_sensor = manifests.groupBy(*scope, "sensor_id").agg(
        F.count("*").alias("n"),
        F.sum((F.coalesce(F.col("status"), F.lit("")) != "completed").cast("long")).alias("unfinished"),
    )
    total = per_sensor.groupBy(*scope).agg(
        F.sum("n").alias("runs"), F.count("*").alias("sensors"),
        F.sum((F.col("n") > 1).cast("long")).alias("repeated"), F.sum("unfinished").alias("unfinished"),
    )
    checks = {
        "fewer_than_two_runs": (F.col("runs") < 2).cast("long"),
        "duplicate_sensor": F.col("repeated"),
        "too_few_sensors": (F.col("sensors") < min_sensors).cast("long"),
        "unfinished_run": F.col("unfinished"),
    }
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), c.alias("violations")) for n, c in checks.items()])
    return total.select(*scope, F.explode(pairs).alias("_v")).select(*scope, "_v.*")


def require_fusion_inputs(manifests: DataFrame, *, min_sensors: int = 2) -> None:
    broken = fusion_input_violations(manifests, min_sensors=min_sensors).filter("violations > 0").limit(4).collect()
    if broken:
        raise ContractError("; ".join(f"{b.check} x{b.violations}" for b in broken))


def evaluation_scope_violations(manifests: DataFrame) -> DataFrame:
    """Runs whose manifest does not limit ground truth to processed frames (V4)."""
    ok = F.coalesce(F.col("ground_truth_scope") == "processed_frames", F.lit(False))
    return _violations(manifests, ["run_id"], {"ground_truth_scope": ~ok})


def embedding_violations(representations: DataFrame, *, embedder_name: str | None = None) -> DataFrame:
    """Per run: number of extra dimensions, and rows of another embedder (V5)."""
    identity = F.lit(False) if embedder_name is None else F.col("source") != embedder_name
    per_dim = representations.groupBy("run_id", F.size("embedding").alias("dim")).agg(
        F.sum(F.coalesce(identity, F.lit(True)).cast("long")).alias("foreign")
    )
    total = per_dim.groupBy("run_id").agg(
        (F.count("*") - 1).alias("extra_dimensions"), F.sum("foreign").alias("foreign_embedder")
    )
    names = ("extra_dimensions", "foreign_embedder")
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in names])
    return total.select("run_id", F.explode(pairs).alias("_v")).select("run_id", "_v.*")


def record_problems(df: DataFrame) -> Column:
    """Array of the rules a record breaks (V6), from the columns it has."""
    have = set(df.columns)
    rules = {
        "negative_frame_number": ("frame_number", lambda c: c < 0),
        "negative_timestamp": ("timestamp_s", lambda c: c < 0),
        "bad_embedding": ("embedding", lambda c: ~is_finite_vector(c)),
    }
    marks = [
        F.when(F.coalesce(rule(F.col(column)), F.lit(True)), F.lit(name))
        for name, (column, rule) in rules.items()
        if column in have
    ]
    return F.array_compact(F.array(*marks))


def quarantine(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with ``problems``)."""
    marked = df.withColumn("problems", record_problems(df))
    return marked.filter(F.size("problems") == 0).drop("problems"), marked.filter(F.size("problems") > 0)


def ground_truth_out_of_range(ground_truth: DataFrame, frames: DataFrame) -> DataFrame:
    """Annotations beyond the last frame of their run."""
    last = frames.groupBy("run_id").agg(F.max("frame_number").alias("_last"))
    return ground_truth.join(last, "run_id", "left").filter(
        F.col("frame_index") > F.coalesce(F.col("_last"), F.lit(-1))
    ).drop("_last")
