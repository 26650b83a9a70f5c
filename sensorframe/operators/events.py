"""Track history to events, events to alerts.

Each rule fires at most once per key, so each is an aggregate (``min_by``) with
map-side combine instead of a window over whole tracks.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, centroid, displacement
from ..functions.text import label_in, severity_rank, sorted_json
from ..schemas import ALERTS, EVENTS, SEVERITIES, conform
from .sequence import BUCKET, with_halo

# Source names and the default set of uneventful roles.
ROLE_SOURCE = "scenario_role"
DWELL_SOURCE = "dwell"
PERSISTENCE_SOURCE = "consecutive_anomaly"
POLICY_SOURCE = "severity"
NORMAL_ROLES = ("normal_maintenance",)


# The message texts and id formats of events below are row values that other tools read


def check_severity(name: str) -> None:
    if name not in SEVERITIES:
        raise ValueError(f"severity must be one of {SEVERITIES}")


def _earliest(df: DataFrame, keys: list[str], columns: list[str], when: Column | None = None) -> DataFrame:
    row = F.struct(*columns)
    if when is not None:
        row = F.when(when, row)
    order = F.col("frame_ordinal") if when is None else F.when(when, F.col("frame_ordinal"))
    return df.groupBy(*keys).agg(F.min_by(row, order).alias("_row"))


def role_events(tracks: DataFrame, *, normal_roles: Iterable[str] = NORMAL_ROLES) -> DataFrame:
    """First observation of every (track, scenario role)."""
    role = F.col("scenario_role")
    columns = ["frame_ordinal", "frame_number", "timestamp_s", "label", "confidence", "hits"]
    first = _earliest(
        tracks.filter(role.isNotNull() & (role != "")), ["run_id", "track_id", "scenario_role"], columns
    ).select("run_id", "track_id", "scenario_role", "_row.*")
    normal = sorted(set(normal_roles))
    info = role.isin(*normal) if normal else F.lit(False)
    return conform(
        first.select(
            "*",
            F.concat_ws(":", F.lit("scenario"), F.col("track_id").cast("string"), role).alias("event_id"),
            role.alias("event_type"),
            F.when(info, F.lit("info")).otherwise(F.lit("warning")).alias("severity"),
            F.lit(ROLE_SOURCE).alias("source"),
            F.format_string("Track %d classified as scenario role '%s'.", F.col("track_id"), role).alias("message"),
            sorted_json(hits=F.col("hits")).alias("metadata"),
        ),
        EVENTS,
    )


def dwell_events(
    tracks: DataFrame,
    *,
    min_hits: int = 30,
    max_displacement_px: float = 40.0,
    labels: Iterable[str] | None = None,
) -> DataFrame:
    """Tracks that reached ``min_hits`` without leaving the neighbourhood of their origin.

    The running maximum displacement never falls, so the only row that can fire
    is the first one with enough hits; it fires if no row up to it strayed.
    Origin and candidate row come from one aggregate per track.  Every row
    before the candidate has fewer than ``min_hits`` hits, so that filter
    reaches the scan and a long track sends no more than its first rows to the
    join.
    """
    if min_hits < 2:
        raise ValueError(f"min_hits {min_hits}: a dwell needs two sightings or more")
    if max_displacement_px < 0:
        raise ValueError(f"max_displacement_px {max_displacement_px}: want 0 or more")
    limit = float(max_displacement_px)
    key = ["run_id", "track_id"]
    seen = tracks.filter(label_in(labels))
    cx, cy = centroid(box())
    columns = ["frame_ordinal", "frame_number", "timestamp_s", "label", "confidence", "hits", "duration_s"]
    ripe = F.col("hits") >= min_hits
    candidate = (
        seen.groupBy(*key)
        .agg(
            F.min_by(F.struct(cx.alias("ox"), cy.alias("oy")), "frame_ordinal").alias("_origin"),
            F.min_by(
                F.when(ripe, F.struct(*columns, cx.alias("cx"), cy.alias("cy"))), F.when(ripe, F.col("frame_ordinal"))
            ).alias("_fire"),
        )
        .filter(F.col("_fire").isNotNull())
    )
    path = seen.filter(F.col("hits") < min_hits).select(
        *key, F.col("frame_ordinal").alias("_at"), cx.alias("_cx"), cy.alias("_cy")
    )
    earlier = F.col("_at") < F.col("_fire.frame_ordinal")

    def away(x: Column, y: Column) -> Column:
        return displacement(x, y, F.col("_origin.ox"), F.col("_origin.oy"))

    strayed = (
        candidate.join(path, key, "left")
        .groupBy(*key)
        .agg(
            F.max(F.when(earlier, away(F.col("_cx"), F.col("_cy")))).alias("_before"),
            F.any_value(away(F.col("_fire.cx"), F.col("_fire.cy"))).alias("_now"),
            F.any_value("_fire").alias("_fire"),
        )
        .withColumn("_max", F.greatest("_before", "_now"))
        .filter(F.col("_max") <= limit)
        .select(*key, "_max", "_fire.*")
    )
    return conform(
        strayed.select(
            "*",
            F.format_string("dwell:%d", F.col("track_id")).alias("event_id"),
            F.lit("dwell").alias("event_type"),
            F.lit("warning").alias("severity"),
            F.lit(DWELL_SOURCE).alias("source"),
            F.format_string(
                f"Track %d persisted for %d observations within {limit:.1f}px of its origin.",
                F.col("track_id"), F.col("hits"),
            ).alias("message"),
            sorted_json(
                hits=F.col("hits"),
                duration_s=F.col("duration_s"),
                max_displacement_px=F.col("_max"),
                configured_max_displacement_px=F.lit(limit),
            ).alias("metadata"),
        ),
        EVENTS,
    )


def anomaly_streaks(anomalies: DataFrame, *, need: int, span: int = BUCKET) -> DataFrame:
    """Anomalous rows with the length of their streak, exact up to ``need``.

    A streak breaks on a normal score and on any processed frame without a
    score for the track, so it is a run of adjacent ``frame_ordinal`` values.
    Deciding "at least ``need``" looks back ``need - 1`` frames only; tracks are
    cut into frame ranges that copy that many rows from the range before.
    """
    span = max(span, need)
    hot = with_halo(
        anomalies.filter("is_anomaly"),
        F.floor(F.col("frame_ordinal") / span),
        F.col("frame_ordinal") % span > span - need,
    )
    inside = Window.partitionBy("run_id", "track_id", "_chunk").orderBy("frame_ordinal")
    island = hot.withColumn("_island", F.col("frame_ordinal") - F.row_number().over(inside))
    streak = Window.partitionBy("run_id", "track_id", "_chunk", "_island").orderBy("frame_ordinal")
    return island.withColumn("streak", F.row_number().over(streak)).filter("_own").drop("_own", "_island", "_chunk")


def persistent_anomaly_events(
    anomalies: DataFrame, *, min_consecutive: int = 3, severity: str = "warning", span: int = BUCKET
) -> DataFrame:
    """One event per track when it is anomalous on ``min_consecutive`` processed frames in a row."""
    if min_consecutive < 1:
        raise ValueError(f"min_consecutive {min_consecutive}: want 1 or more")
    check_severity(severity)
    reached = anomaly_streaks(anomalies, need=min_consecutive, span=span).filter(
        F.col("streak") >= min_consecutive
    )
    columns = ["frame_ordinal", "frame_number", "timestamp_s", "label", "score", "threshold", "margin", "source"]
    first = _earliest(reached, ["run_id", "track_id"], columns).select("run_id", "track_id", "_row.*")
    count = F.lit(min_consecutive).cast("long")
    return conform(
        first.select(
            *[c for c in first.columns if c != "source"],
            F.format_string("visual_anomaly:%d", F.col("track_id")).alias("event_id"),
            F.lit("visual_anomaly").alias("event_type"),
            F.lit(severity).alias("severity"),
            F.lit(PERSISTENCE_SOURCE).alias("source"),
            F.format_string(
                "Track %d exceeded the normal-activity anomaly threshold for %d consecutive scored observations.",
                F.col("track_id"), count,
            ).alias("message"),
            sorted_json(
                score=F.col("score"),
                threshold=F.col("threshold"),
                margin=F.col("margin"),
                consecutive_observations=count,
                anomaly_source=F.col("source"),
            ).alias("metadata"),
        ),
        EVENTS,
    )


def union_events(*producers: DataFrame) -> DataFrame:
    """All events with ``producer_order`` keeping the per-frame order of the producers."""
    tagged = [p.withColumn("producer_order", F.lit(i)) for i, p in enumerate(producers)]
    return reduce(DataFrame.unionByName, tagged)


def promoted(minimum_severity: str = "warning", column: str = "severity") -> Column:
    """Boolean policy: severity at or above the minimum."""
    check_severity(minimum_severity)
    return severity_rank(F.col(column)) >= SEVERITIES.index(minimum_severity)


def alerts_from_events(
    events: DataFrame, *, minimum_severity: str = "warning", policy: Column | None = None
) -> DataFrame:
    """Promote events to alerts; stateless, so it also runs on streams."""
    keep = promoted(minimum_severity) if policy is None else policy
    kept = events.filter(keep)
    return conform(
        kept.select(
            *[c for c in kept.columns if c not in ("source", "metadata")],
            F.concat(F.lit("alert:"), F.col("event_id")).alias("alert_id"),
            F.col("event_type").alias("alert_type"),
            F.lit(POLICY_SOURCE).alias("source"),
            sorted_json(event_source=F.col("source")).alias("metadata"),
        ),
        ALERTS,
    )


def annotation_overlay(tracks: DataFrame, alerts: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Per track observation: alert/anomaly flags, caption, colour slot and line thickness."""
    from ..functions.text import caption, class_color_index

    at = ["run_id", "frame_ordinal", "track_id"]
    alerted = alerts.filter(F.col("track_id").isNotNull()).select(*at).distinct().withColumn("_alert", F.lit(True))
    odd = anomalies.filter("is_anomaly").select(*at).distinct().withColumn("_odd", F.lit(True))
    joined = tracks.join(alerted, at, "left").join(odd, at, "left")
    is_alert = F.coalesce(F.col("_alert"), F.lit(False))
    is_anomaly = F.coalesce(F.col("_odd"), F.lit(False))
    return joined.select(
        *at, "label", "confidence", "x1", "y1", "x2", "y2",
        is_alert.alias("is_alert"),
        is_anomaly.alias("is_anomaly"),
        caption(F.col("track_id"), F.col("label"), F.col("confidence"), is_alert, is_anomaly).alias("caption"),
        F.when(is_alert | is_anomaly, F.lit(3)).otherwise(F.lit(2)).alias("thickness"),
        class_color_index(F.col("label")).alias("color_index"),
    )
