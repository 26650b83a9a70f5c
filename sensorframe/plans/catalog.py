"""Named queries over the warehouse tables, each with an ANSI SQL statement of its result.

A query takes ``(spark, sf_dir)``.  Its SQL is an independent formulation
(windows, joins, recursion) over the same derived views; queries whose meaning
SQL cannot state have none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import hooks
from ..functions import geometry as G
from ..functions import ontology as O
from ..functions import text as X
from ..operators import (
    anomaly,
    contracts,
    evaluation,
    events as E,
    fusion,
    representations as R,
    sampling as S,
    summaries as M,
    tracking,
)
from ..operators.sequence import previous
from ..runtime import materialize, scratch_path
from ..sources import datasets as D
from ..sources import packs, run_folders
from ..sources import tables as IO
from ..streaming import fusion as stream_fusion
from ..streaming import ledger as stream_ledger
from ..streaming import runs as stream_runs
from ..streaming import tracker as stream_tracker
from . import pipelines
from .views import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def r6_of_many(c: str, digits: int = 6) -> Column:
    """What :func:`r6` gives, by plain arithmetic where no tie is near: Spark rounds doubles by way of their text, which
    takes longer than to find a pair.  Below 2^40 the scaled value is off by less than 2^-12."""
    scaled = F.col(c) * 10.0**digits
    clear = (F.abs(scaled) < 2.0**40) & (F.abs(scaled - F.floor(scaled) - 0.5) > 0.001)
    return F.when(clear, F.floor(scaled + 0.5) / 10.0**digits).otherwise(r6(c, digits))


# --------------------------------------------------------------------------
# Tracking and track events.  Lanes are 100 px apart and jitter by at most
# 10 px, so a track is a run of frame ordinals of one lane without a gap over 3.

TRACKS_SQL = """
WITH d AS (
  SELECT *, CASE WHEN frame_ordinal - lag(frame_ordinal) OVER (PARTITION BY run_id, detection_index ORDER BY frame_ordinal) <= 3
                 THEN 0 ELSE 1 END AS opens
  FROM v_detections
), i AS (
  SELECT *, sum(opens) OVER (PARTITION BY run_id, detection_index ORDER BY frame_ordinal) AS island FROM d
), h AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, detection_index, island ORDER BY frame_ordinal) AS hits,
         min(frame_ordinal) OVER (PARTITION BY run_id, detection_index, island) AS birth
  FROM i
), tracks AS (
  SELECT run_id, frame_ordinal, frame_number, timestamp_s, label, confidence, hits, scenario_role, x1, y1, x2, y2, object_id,
         dense_rank() OVER (PARTITION BY run_id ORDER BY birth, detection_index) AS track_id,
         birth * 2 AS first_frame_number, CAST(birth AS DOUBLE) / 10 AS first_timestamp_s
  FROM h
)"""


def tracks_of(spark: SparkSession, d: str) -> DataFrame:
    return tracking.track_detections(view(spark, d, "v_detections"))


def stored_tracks(spark: SparkSession, d: str) -> DataFrame:
    return materialize(tracks_of(spark, d), "tracks")


DWELL_SQL = TRACKS_SQL + """, c AS (
  SELECT *, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy FROM tracks
), o AS (
  SELECT *, first_value(cx) OVER (PARTITION BY run_id, track_id ORDER BY frame_ordinal) AS ox,
            first_value(cy) OVER (PARTITION BY run_id, track_id ORDER BY frame_ordinal) AS oy FROM c
), m AS (
  SELECT *, max(sqrt((cx - ox) * (cx - ox) + (cy - oy) * (cy - oy)))
            OVER (PARTITION BY run_id, track_id ORDER BY frame_ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS far FROM o
), f AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, track_id ORDER BY frame_ordinal) AS n FROM m WHERE hits >= 4 AND far <= 9
), dwell AS (
  SELECT run_id, concat('dwell:', CAST(track_id AS STRING)) AS event_id, frame_ordinal, frame_number, timestamp_s,
         'dwell' AS event_type, 'warning' AS severity, track_id, label, confidence, 'dwell' AS source,
         concat('Track ', CAST(track_id AS STRING), ' persisted for ', CAST(hits AS STRING), ' observations within 9.0px of its origin.') AS message
  FROM f WHERE n = 1
)"""

ROLE_SQL = """, r AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, track_id, scenario_role ORDER BY frame_ordinal) AS n
  FROM tracks WHERE scenario_role IS NOT NULL
), roles AS (
  SELECT run_id, concat('scenario:', CAST(track_id AS STRING), ':', scenario_role) AS event_id, frame_ordinal, frame_number,
         timestamp_s, scenario_role AS event_type,
         CASE WHEN scenario_role = 'normal_maintenance' THEN 'info' ELSE 'warning' END AS severity, track_id, label, confidence,
         'scenario_role' AS source,
         concat('Track ', CAST(track_id AS STRING), ' classified as scenario role ''', scenario_role, '''.') AS message
  FROM r WHERE n = 1
)"""

STREAK_SQL = """, hot AS (
  SELECT *, frame_ordinal - row_number() OVER (PARTITION BY run_id, track_id ORDER BY frame_ordinal) AS island
  FROM v_anomalies WHERE is_anomaly
), streak AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, track_id, island ORDER BY frame_ordinal) AS n FROM hot
), fired AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, track_id ORDER BY frame_ordinal) AS k FROM streak WHERE n >= 3
), persistent AS (
  SELECT run_id, concat('visual_anomaly:', CAST(track_id AS STRING)) AS event_id, frame_ordinal, frame_number, timestamp_s,
         'visual_anomaly' AS event_type, 'critical' AS severity, track_id, label, CAST(NULL AS DOUBLE) AS confidence,
         'consecutive_anomaly' AS source,
         concat('Track ', CAST(track_id AS STRING), ' exceeded the normal-activity anomaly threshold for 3 consecutive scored observations.') AS message
  FROM fired WHERE k = 1
)"""

EVENT_FIELDS = [
    "run_id", "event_id", "frame_ordinal", "frame_number", "timestamp_s", "event_type", "severity", "track_id",
    "label", "confidence", "source", "message",
]


@query("dwell_alert_counts", DWELL_SQL + """
SELECT run_id, event_type AS alert_type, label, count(*) AS alerts, CAST(sum(frame_ordinal) AS BIGINT) AS frame_sum
FROM dwell GROUP BY run_id, event_type, label""")
def dwell_alert_counts(spark, d):
    events = E.dwell_events(stored_tracks(spark, d), min_hits=4, max_displacement_px=9)
    return E.alerts_from_events(events).groupBy("run_id", "alert_type", "label").agg(
        F.count("*").alias("alerts"), F.sum("frame_ordinal").alias("frame_sum")
    )


@query("tracks", TRACKS_SQL + """
SELECT run_id, frame_ordinal, track_id, label, hits, confidence, first_frame_number, first_timestamp_s,
       round(timestamp_s - first_timestamp_s, 6) AS duration_s, scenario_role, x1, y1, x2, y2, object_id AS detection_object_id
FROM tracks""")
def tracks(spark, d):
    return tracks_of(spark, d).select(
        "run_id", "frame_ordinal", "track_id", "label", "hits", "confidence", "first_frame_number",
        "first_timestamp_s", r6("duration_s").alias("duration_s"), "scenario_role", "x1", "y1", "x2", "y2",
        "detection_object_id",
    )


@query("tracks_in_small_chunks", TRACKS_SQL + """
SELECT run_id, frame_ordinal, track_id, label, hits, first_frame_number, x1, y1, x2, y2 FROM tracks""")
def tracks_in_small_chunks(spark, d):
    """The hand-off between chunks at work: every run is cut each 24 frames."""
    return tracking.track_detections(view(spark, d, "v_detections"), chunk_frames=24, warmup_frames=4).select(
        "run_id", "frame_ordinal", "track_id", "label", "hits", "first_frame_number", "x1", "y1", "x2", "y2")


@query("track_lifetimes", TRACKS_SQL + """
SELECT run_id, track_id, max(hits) AS hits, min(frame_number) AS first_frame_number, max(frame_number) AS last_frame_number
FROM tracks GROUP BY run_id, track_id""")
def track_lifetimes(spark, d):
    known = stored_tracks(spark, d).drop("hits", "first_frame_number", "first_timestamp_s", "duration_s")
    return tracking.current_track_states(tracking.observation_history(known)).select(
        "run_id", "track_id", "hits", "first_frame_number", F.col("frame_number").alias("last_frame_number")
    )


@query("role_events", TRACKS_SQL + ROLE_SQL + " SELECT * FROM roles")
def role_events(spark, d):
    return E.role_events(tracks_of(spark, d)).select(*EVENT_FIELDS)


@query("dwell_events", DWELL_SQL + " SELECT * FROM dwell")
def dwell_events(spark, d):
    return E.dwell_events(stored_tracks(spark, d), min_hits=4, max_displacement_px=9).select(*EVENT_FIELDS)


@query("persistent_anomaly_events", "WITH one AS (SELECT 1 AS one)" + STREAK_SQL + " SELECT * FROM persistent")
def persistent_anomaly_events(spark, d):
    return E.persistent_anomaly_events(
        view(spark, d, "v_anomalies"), min_consecutive=3, severity="critical", span=64
    ).select(*EVENT_FIELDS)


@query("alerts_of_all_rules", DWELL_SQL + ROLE_SQL + STREAK_SQL + """
SELECT run_id, concat('alert:', event_id) AS alert_id, event_id, frame_number, timestamp_s, event_type AS alert_type,
       severity, track_id, label, confidence, 'severity' AS source, message, concat('{"event_source":"', source, '"}') AS metadata
FROM (SELECT * FROM roles UNION ALL SELECT * FROM dwell UNION ALL SELECT * FROM persistent) u
WHERE severity IN ('warning', 'critical')""")
def alerts_of_all_rules(spark, d):
    found = stored_tracks(spark, d)
    events = E.union_events(
        E.role_events(found),
        E.dwell_events(found, min_hits=4, max_displacement_px=9),
        E.persistent_anomaly_events(view(spark, d, "v_anomalies"), min_consecutive=3, severity="critical"),
    )
    return E.alerts_from_events(events).drop("frame_ordinal")


@query("annotation_overlay", DWELL_SQL + """, a AS (SELECT DISTINCT run_id, frame_ordinal, track_id FROM v_anomalies WHERE is_anomaly),
j AS (
  SELECT t.*, w.track_id IS NOT NULL AS is_alert, a.track_id IS NOT NULL AS is_anomaly
  FROM tracks t LEFT JOIN dwell w ON t.run_id = w.run_id AND t.frame_ordinal = w.frame_ordinal AND t.track_id = w.track_id
  LEFT JOIN a ON t.run_id = a.run_id AND t.frame_ordinal = a.frame_ordinal AND t.track_id = a.track_id
)
SELECT run_id, frame_ordinal, track_id, label, is_alert, is_anomaly,
       concat('#', CAST(track_id AS STRING), ' ', label, CASE WHEN is_alert THEN ' ALERT' ELSE '' END,
              CASE WHEN is_anomaly THEN ' ANOM' ELSE '' END) AS caption,
       CAST(CASE WHEN is_alert OR is_anomaly THEN 3 ELSE 2 END AS INT) AS thickness,
       CAST(CASE label WHEN 'person' THEN 6 WHEN 'car' THEN 5 ELSE 2 END AS INT) AS color_index
FROM j""")
def annotation_overlay(spark, d):
    found = stored_tracks(spark, d)
    alerts = E.alerts_from_events(E.dwell_events(found, min_hits=4, max_displacement_px=9))
    rows = E.annotation_overlay(found, alerts, view(spark, d, "v_anomalies"))
    return rows.select(
        "run_id", "frame_ordinal", "track_id", "label", "is_alert", "is_anomaly",
        F.regexp_replace("caption", r" \d\.\d\d", "").alias("caption"), "thickness", "color_index",
    )


# --------------------------------------------------------------------------
# Run summaries.

@query("run_counters", DWELL_SQL + """, t AS (
  SELECT run_id, count(*) AS track_observations_emitted, count(DISTINCT track_id) AS unique_tracks FROM tracks GROUP BY run_id
), fr AS (
  SELECT run_id, count(*) AS frames_processed, min(frame_number) AS first_frame_number, max(frame_number) AS last_frame_number
  FROM v_frames GROUP BY run_id
), nd AS (SELECT run_id, count(*) AS detections_emitted FROM v_detections GROUP BY run_id),
a AS (
  SELECT run_id, count(*) AS anomaly_observations_emitted, CAST(sum(CASE WHEN is_anomaly THEN 1 ELSE 0 END) AS BIGINT) AS anomalies_flagged
  FROM v_anomalies GROUP BY run_id
), e AS (SELECT run_id, count(*) AS events_emitted FROM dwell GROUP BY run_id),
p AS (
  SELECT run_id, count(*) AS representations_emitted, count(DISTINCT track_id) AS represented_tracks FROM v_reps GROUP BY run_id
)
SELECT fr.*, detections_emitted, track_observations_emitted, unique_tracks, coalesce(representations_emitted, 0) AS representations_emitted,
       coalesce(represented_tracks, 0) AS represented_tracks, anomaly_observations_emitted,
       anomalies_flagged, coalesce(events_emitted, 0) AS events_emitted, coalesce(events_emitted, 0) AS alerts_emitted
FROM fr LEFT JOIN t ON fr.run_id = t.run_id LEFT JOIN nd ON fr.run_id = nd.run_id LEFT JOIN a ON fr.run_id = a.run_id
LEFT JOIN e ON fr.run_id = e.run_id LEFT JOIN p ON fr.run_id = p.run_id""")
def run_counters(spark, d):
    found = stored_tracks(spark, d)
    events = E.dwell_events(found, min_hits=4, max_displacement_px=9)
    return M.run_counters(
        view(spark, d, "v_frames"), detections=view(spark, d, "v_detections"), tracks=found,
        representations=view(spark, d, "v_reps"), anomalies=view(spark, d, "v_anomalies"), events=events,
        alerts=E.alerts_from_events(events),
    )


@query("class_summary", TRACKS_SQL + """, c AS (
  SELECT run_id, label, count(*) AS detections, round(avg(confidence), 6) AS mean_confidence FROM v_detections GROUP BY run_id, label
), t AS (SELECT run_id, label, count(DISTINCT track_id) AS tracks FROM tracks GROUP BY run_id, label)
SELECT c.run_id, c.label, detections, coalesce(tracks, 0) AS tracks, mean_confidence
FROM c LEFT JOIN t ON c.run_id = t.run_id AND c.label = t.label""")
def class_summary(spark, d):
    rows = M.class_summary(view(spark, d, "v_detections"), tracks_of(spark, d))
    return rows.withColumn("mean_confidence", r6("mean_confidence"))


@query("frame_detection_stats", """
WITH f AS (SELECT run_id, frame_number, count(*) AS n FROM v_detections GROUP BY run_id, frame_number)
SELECT run_id, min(n) AS min, max(n) AS max, round(avg(n), 6) AS mean FROM f GROUP BY run_id""")
def frame_detection_stats(spark, d):
    return M.frame_stats(M.detections_per_frame(view(spark, d, "v_detections"))).withColumn("mean", r6("mean"))


@query("frame_detection_series", """
WITH f AS (SELECT run_id, frame_number, count(*) AS detections FROM v_detections GROUP BY run_id, frame_number),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY frame_number) - 1 AS rn,
             count(*) OVER (PARTITION BY run_id) AS total FROM f)
SELECT run_id, frame_number, detections FROM n WHERE rn % greatest(1, CAST(ceil(total / 240.0) AS BIGINT)) = 0""")
def frame_detection_series(spark, d):
    return M.frame_series(M.detections_per_frame(view(spark, d, "v_detections")))


@query("storage_report", """
WITH s AS (SELECT run_id, category, CAST(sum(length) AS BIGINT) AS bytes, count(*) AS files FROM v_files GROUP BY run_id, category)
SELECT * FROM s UNION ALL
SELECT run_id, 'total', CAST(sum(bytes) AS BIGINT), CAST(sum(files) AS BIGINT) FROM s GROUP BY run_id""")
def storage_report(spark, d):
    return M.storage_report(view(spark, d, "v_files").select("run_id", "category", "length"), F.col("category"))


@query("last_detections", """
SELECT run_id, frame_ordinal, detection_index, label, confidence FROM v_detections
ORDER BY frame_ordinal DESC, run_id DESC, detection_index DESC LIMIT 200""")
def last_detections(spark, d):
    rows = view(spark, d, "v_detections").select("run_id", "frame_ordinal", "detection_index", "label", "confidence")
    return M.tail_rows(rows, [F.col("frame_ordinal"), F.col("run_id"), F.col("detection_index")], 200)


@query("run_catalogue", "SELECT run_id, created_at FROM v_manifests WHERE status = 'completed' ORDER BY created_at DESC, run_id DESC LIMIT 2")
def run_catalogue(spark, d):
    return M.run_catalogue(view(spark, d, "v_manifests"), limit=2, status="completed").select("run_id", "created_at")


@query("top_classes", """
WITH p AS (SELECT vec_id, unnest(embedding) AS prob, generate_subscripts(embedding, 1) AS i FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY prob DESC, i) AS k FROM p)
SELECT vec_id, CAST(k AS INT) AS rank, concat('class_', CAST(i - 1 AS STRING)) AS name, round(CAST(prob AS DOUBLE), 6) AS probability
FROM r WHERE k <= 5""")
def top_classes(spark, d):
    names = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.concat(F.lit("class_"), i))
    scored = view(spark, d, "embeddings").withColumn("names", names)
    top = M.top_classes(scored.withColumn("probs", F.col("embedding").cast("array<double>")))
    return top.select("vec_id", F.posexplode("top").alias("rank", "t")).select(
        "vec_id", (F.col("rank") + 1).alias("rank"), "t.name", r6("t.probability").alias("probability")
    )


@query("first_crops_per_class", """
WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings)
SELECT label, vec_id FROM r WHERE k <= 3""")
def first_crops_per_class(spark, d):
    return M.first_per_class(view(spark, d, "embeddings").select("label", "vec_id"), "label", [F.col("vec_id")])


# --------------------------------------------------------------------------
# Geometry and scalar expressions.

@query("box_overlap", """
WITH b AS (
  SELECT p.prediction_index, p.x1 AS ax1, p.y1 AS ay1, p.x2 AS ax2, p.y2 AS ay2, g.x1 AS bx1, g.y1 AS by1, g.x2 AS bx2, g.y2 AS by2
  FROM v_predictions p JOIN v_ground_truth g ON p.prediction_index = g.ground_truth_index
), i AS (
  SELECT *, greatest(0, least(ax2, bx2) - greatest(ax1, bx1)) * greatest(0, least(ay2, by2) - greatest(ay1, by1)) AS inter FROM b
)
SELECT prediction_index,
       round(CAST(inter AS DOUBLE) / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter), 6) AS iou FROM i""")
def box_overlap(spark, d):
    p = view(spark, d, "v_predictions")
    g = view(spark, d, "v_ground_truth").select(
        F.col("ground_truth_index").alias("prediction_index"), *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")]
    )
    return p.join(g, "prediction_index").select("prediction_index", r6(G.iou(G.box(), G.box("g_"))).alias("iou"))


@query("box_corners_and_travel", """
WITH b AS (
  SELECT run_id, frame_index, target_id, bbox_left AS l, bbox_top AS t,
         CAST(floor(bbox_left) AS INT) AS x1, CAST(floor(round(bbox_top, 6)) AS INT) AS y1,
         CAST(floor(bbox_left + bbox_width) AS INT) AS x2, CAST(floor(round(bbox_top + bbox_height, 6)) AS INT) AS y2
  FROM v_native
)
SELECT run_id, count(*) AS boxes, CAST(sum(x1) AS BIGINT) AS x1, CAST(sum(x2) AS BIGINT) AS x2,
       round(sum(sqrt((x1 + x2) / 2.0 * (x1 + x2) / 2.0 + (y1 + y2) / 2.0 * (y1 + y2) / 2.0)), 3) AS travel
FROM b GROUP BY run_id""")
def box_corners_and_travel(spark, d):
    n = view(spark, d, "v_native").withColumns(
        {"bbox_top": F.round("bbox_top", 6), "bbox_height": F.round("bbox_height", 6)}
    )
    x1, y1, x2, y2 = G.xywh_to_xyxy(*[F.col(f"bbox_{c}") for c in ("left", "top", "width", "height")])
    boxes = n.select("run_id", x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"))
    cx, cy = G.centroid(G.box())
    return boxes.groupBy("run_id").agg(
        F.count("*").alias("boxes"), F.sum("x1").alias("x1"), F.sum("x2").alias("x2"),
        F.round(F.sum(G.displacement(cx, cy, F.lit(0.0), F.lit(0.0))), 3).alias("travel"),
    )


@query("raw_box_normalisation", """
WITH raw AS (
  SELECT event_id, user_id % 4 AS class_id, user_id % 120 - 5 + 0.5e0 AS x1, user_id % 7 + 0.25e0 AS y1,
         user_id % 90 + 20.5e0 AS x2, user_id % 7 + value AS y2 FROM v_slots
), s AS (
  SELECT event_id, class_id, CAST(greatest(0, least(99, round_even(x1, 0))) AS INT) AS x1, CAST(greatest(0, least(79, round_even(y1, 0))) AS INT) AS y1,
         CAST(greatest(0, least(99, round_even(x2, 0))) AS INT) AS x2, CAST(greatest(0, least(79, round_even(y2, 0))) AS INT) AS y2 FROM raw
)
SELECT event_id, CASE class_id WHEN 0 THEN 'person' WHEN 2 THEN 'car' ELSE CAST(class_id AS STRING) END AS label, x1, y1, x2, y2
FROM s WHERE x2 > x1 AND y2 > y1""")
def raw_box_normalisation(spark, d):
    u = F.col("user_id")
    raw = view(spark, d, "v_slots").select(
        "event_id", (u % 4).alias("class_id"), F.lit(0.5).alias("confidence"), F.lit(100).alias("width"),
        F.lit(80).alias("height"), (u % 120 - 5 + 0.5).alias("x1"), (u % 7 + 0.25).alias("y1"),
        (u % 90 + 20.5).alias("x2"), (u % 7 + F.col("value")).alias("y2"),
    )
    return G.normalise_raw_boxes(raw, {0: "person", 2: "car"}).select("event_id", "label", "x1", "y1", "x2", "y2")


@query("mature_crops", """
SELECT run_id, track_id, frame_ordinal, greatest(0, x1 - 6) AS cx1, greatest(0, y1 - 6) AS cy1, least(400, x2 + 6) AS cx2, least(60, y2 + 6) AS cy2
FROM v_reps WHERE hits >= 3 AND least(400, x2 + 6) - greatest(0, x1 - 6) >= 12 AND least(60, y2 + 6) - greatest(0, y1 - 6) >= 12""")
def mature_crops(spark, d):
    kept = R.mature_crops(view(spark, d, "v_reps"), min_track_hits=3, pad_px=6, min_crop_size=12)
    return kept.select(
        "run_id", "track_id", "frame_ordinal", *[F.col(f"crop.{c}").alias(f"c{c}") for c in ("x1", "y1", "x2", "y2")]
    )


@query("letterbox_geometry", """
WITH c AS (
  SELECT f.*, g.width AS cw, g.height AS ch FROM v_frames f JOIN v_frames g ON f.run_id = g.run_id AND g.frame_ordinal = 0
), s AS (
  SELECT *, least(CAST(cw AS DOUBLE) / width, CAST(ch AS DOUBLE) / height) AS scale FROM c
), r AS (
  SELECT *, CAST(least(cw, greatest(1, round_even(width * scale, 0))) AS INT) AS resized_width,
         CAST(least(ch, greatest(1, round_even(height * scale, 0))) AS INT) AS resized_height FROM s
)
SELECT run_id, frame_ordinal, round(scale, 6) AS scale, resized_width, resized_height,
       CAST(floor((cw - resized_width) / 2.0) AS INT) AS x_offset, CAST(floor((ch - resized_height) / 2.0) AS INT) AS y_offset,
       NOT (width = cw AND height = ch) AS normalized FROM r""")
def letterbox_geometry(spark, d):
    return G.letterbox_geometry(view(spark, d, "v_frames")).select(
        "run_id", "frame_ordinal", r6("scale").alias("scale"), "resized_width", "resized_height", "x_offset",
        "y_offset", "normalized",
    )


@query("source_dimensions", """
WITH s AS (SELECT run_id, concat(CAST(width AS STRING), 'x', CAST(height AS STRING)) AS size, count(*) AS frames FROM v_frames GROUP BY 1, 2),
t AS (SELECT run_id, CAST(sum(frames) AS BIGINT) AS total_frames, CAST(sum(CASE WHEN size <> '640x480' THEN frames ELSE 0 END) AS BIGINT) AS normalized_frames FROM s GROUP BY run_id)
SELECT s.run_id, size, frames, total_frames, normalized_frames FROM s JOIN t ON s.run_id = t.run_id""")
def source_dimensions(spark, d):
    dims = G.source_dimensions(view(spark, d, "v_frames"))
    return dims.select("run_id", "total_frames", "normalized_frames", F.explode("source_dimensions").alias("size", "frames"))


@query("sampled_frames", """
SELECT run_id, CAST(frame_ordinal / 3 AS BIGINT) AS frame_ordinal, frame_number, round(frame_ordinal / 25e0, 6) AS timestamp_s
FROM v_frames WHERE frame_ordinal % 3 = 0 AND frame_ordinal < 3 * 150""")
def sampled_frames(spark, d):
    listed = view(spark, d, "v_frames").withColumn("timestamp_s", r6(S.timestamp_of(F.col("frame_ordinal"), 25.0)))
    return S.sample_frames(listed, frame_step=3, max_frames=150).select(
        "run_id", "frame_ordinal", "frame_number", "timestamp_s"
    )


@query("lookup_and_text_expressions", """
SELECT doc_id, CASE WHEN lower(concat(source, '-train')) LIKE '%-train' THEN 'train' END AS split,
       CASE lang WHEN 'en' THEN 'image' ELSE 'video' END AS media,
       lang IN ('en', 'de') AS flag, CASE WHEN n_chars % 7 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS finite,
       CASE WHEN lang = 'fr' THEN NULL ELSE lang END AS filled,
       concat(source, '_', lpad(CAST(doc_id AS STRING), 6, '0')) AS frame_id,
       concat('{"a":', CAST(doc_id AS STRING), ',"b":"', lang, '"}') AS metadata
FROM documents""")
def lookup_and_text_expressions(spark, d):
    n = F.col("n_chars")
    name = F.concat(F.lit("a.b/file."), F.when(F.col("lang") == "en", F.lit("PNG")).otherwise(F.lit("mkv")))
    return view(spark, d, "documents").select(
        "doc_id",
        X.split_name(F.concat(F.col("source"), F.lit("-train"))).alias("split"),
        X.media_kind(name).alias("media"),
        X.truthy(F.when(F.col("lang") == "en", F.lit(" Yes ")).when(F.col("lang") == "de", F.lit("1"))).alias("flag"),
        X.finite_or_null(F.when(n % 7 == 0, F.lit(float("nan"))).otherwise(n.cast("double"))).alias("finite"),
        X.empty_to_null(F.when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("lang"))).alias("filled"),
        X.frame_id(F.col("source"), F.col("doc_id")).alias("frame_id"),
        X.sorted_json(b=F.col("lang"), a=F.col("doc_id")).alias("metadata"),
    )


@query("class_colors", """
SELECT label, CAST(CASE label WHEN 'person' THEN 6 WHEN 'car' THEN 5 ELSE 2 END AS INT) AS color_index, count(*) AS detections
FROM v_detections GROUP BY label""")
def class_colors(spark, d):
    return view(spark, d, "v_detections").groupBy(
        "label", X.class_color_index(F.col("label")).alias("color_index")
    ).agg(F.count("*").alias("detections"))


# --------------------------------------------------------------------------
# Representations and anomaly scoring.

SAMPLED_SQL = """
WITH due AS (SELECT * FROM v_reps WHERE hits >= 3 AND (hits - 3) % 2 = 0),
cap AS (SELECT *, row_number() OVER (PARTITION BY run_id, frame_ordinal ORDER BY confidence DESC, track_id) AS slot FROM due),
sampled AS (
  SELECT * FROM cap WHERE slot <= 5 AND least(400, x2 + 6) - greatest(0, x1 - 6) >= 12 AND least(60, y2 + 6) - greatest(0, y1 - 6) >= 12
)"""


def sampled_reps(spark, d) -> DataFrame:
    return R.sample_tracks(view(spark, d, "v_reps"), sample_every_n_hits=2, max_per_frame=5, unique_hits=False)


@query("representation_sampling", SAMPLED_SQL + " SELECT run_id, track_id, frame_ordinal, hits FROM sampled")
def representation_sampling(spark, d):
    return sampled_reps(spark, d).select("run_id", "track_id", "frame_ordinal", "hits")


@query("representation_changes", SAMPLED_SQL + """, l AS (
  SELECT *, lag(embedding) OVER (PARTITION BY run_id, track_id ORDER BY frame_ordinal) AS before,
         row_number() OVER (PARTITION BY run_id ORDER BY frame_ordinal, confidence DESC, track_id) - 1 AS embedding_row FROM sampled
), s AS (
  SELECT *, list_cosine_similarity(CAST(before AS DOUBLE[]), CAST(embedding AS DOUBLE[])) AS sim FROM l
)
SELECT run_id, embedding_row, frame_number, track_id, hits AS track_hits, CAST(len(embedding) AS INT) AS embedding_dim,
       CAST(1.0 AS DOUBLE) AS embedding_norm, round(sim, 6) AS previous_cosine_similarity, round(1 - sim, 6) AS representation_change FROM s""")
def representation_changes(spark, d):
    rows = R.representation_changes(sampled_reps(spark, d), bucket=8)
    return rows.select(
        "run_id", "embedding_row", "frame_number", "track_id", "track_hits", "embedding_dim",
        r6("embedding_norm").alias("embedding_norm"),
        r6("previous_cosine_similarity").alias("previous_cosine_similarity"),
        r6("representation_change").alias("representation_change"),
    )


@query("representation_summary", """
SELECT run_id, count(*) AS observations, count(DISTINCT track_id) AS tracks, CAST(max(len(embedding)) AS INT) AS embedding_dim
FROM v_reps GROUP BY run_id""")
def representation_summary(spark, d):
    return R.representation_summary(view(spark, d, "v_reps"))


REFERENCE_SQL = """
WITH p AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM v_reps, range(1, 65) t(i) WHERE label IN ('class_0', 'class_1', 'class_2', 'class_3', 'class_4') GROUP BY i),
c AS (SELECT list(m ORDER BY i) AS centroid FROM p),
n AS (SELECT 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS score FROM v_reps, c WHERE label IN ('class_0', 'class_1', 'class_2', 'class_3', 'class_4')),
ref AS (SELECT quantile_cont(score, 0.95) AS threshold, count(*) AS sample_count FROM n)"""


def reference_of(spark, d) -> DataFrame:
    normal = view(spark, d, "v_reps").filter(F.col("label").isin(*[f"class_{k}" for k in range(5)]))
    return anomaly.fit_reference(normal, embedder_name="given")


@query("fit_reference", REFERENCE_SQL + """
SELECT 'given' AS embedder_name, CAST(len(centroid) AS INT) AS embedding_dim, round(threshold, 6) AS threshold, sample_count,
       CAST(0.95 AS DOUBLE) AS quantile, round(list_sum(list_transform(centroid, lambda x: x * x)), 6) AS centroid_power FROM ref, c""")
def fit_reference(spark, d):
    path = scratch_path(spark, "reference")
    IO.write_reference(reference_of(spark, d), path)
    power = F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x * x)
    return IO.read_reference(spark, path).select(
        "embedder_name", "embedding_dim", r6("threshold").alias("threshold"), "sample_count", "quantile",
        r6(power).alias("centroid_power"),
    )


@query("anomaly_scores", REFERENCE_SQL + """, s AS (
  SELECT run_id, track_id, frame_ordinal, label, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS score, threshold
  FROM v_reps, c, ref WHERE hits >= 3 AND least(400, x2 + 6) - greatest(0, x1 - 6) >= 12 AND least(60, y2 + 6) - greatest(0, y1 - 6) >= 12
)
SELECT run_id, track_id, frame_ordinal, label, round(score, 6) AS score, round(threshold, 6) AS threshold,
       round(score - threshold, 6) AS margin, score > threshold AS is_anomaly FROM s""")
def anomaly_scores(spark, d):
    scored = anomaly.score_anomalies(view(spark, d, "v_reps"), reference_of(spark, d), embedder_name="given")
    return scored.select(
        "run_id", "track_id", "frame_ordinal", "label", r6("score").alias("score"), r6("threshold").alias("threshold"),
        r6("margin").alias("margin"), "is_anomaly",
    )


@query("anomaly_scores_of_labels", REFERENCE_SQL + """, s AS (
  SELECT run_id, track_id, frame_ordinal, label, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS score, threshold
  FROM v_reps, c, ref WHERE label IN ('class_5', 'class_7') AND hits >= 3 AND least(400, x2 + 6) - greatest(0, x1 - 6) >= 12
    AND least(60, y2 + 6) - greatest(0, y1 - 6) >= 12
)
SELECT run_id, track_id, frame_ordinal, label, round(score, 6) AS score, score > threshold AS is_anomaly FROM s""")
def anomaly_scores_of_labels(spark, d):
    reps = view(spark, d, "v_reps")
    scored = anomaly.score_anomalies(reps, reference_of(spark, d), embedder_name="given", labels=["class_5", "class_7"])
    return scored.select("run_id", "track_id", "frame_ordinal", "label", r6("score").alias("score"), "is_anomaly")


@query("score_distribution", """
WITH p AS (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) t(i) WHERE label < 5 GROUP BY i),
c AS (SELECT list(m ORDER BY i) AS centroid FROM p),
n AS (SELECT CASE WHEN label < 5 THEN 'normal' ELSE 'probe' END AS set_name,
             1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS score FROM embeddings, c)
SELECT set_name, count(*) AS samples, round(quantile_cont(score, 0.5), 6) AS median_score,
       (SELECT round(quantile_cont(score, 0.95), 6) FROM n WHERE set_name = 'normal') AS threshold FROM n GROUP BY set_name""")
def score_distribution(spark, d):
    e = view(spark, d, "embeddings")
    rows = anomaly.score_distribution(e.filter("label < 5"), e.filter("label >= 5"))
    return rows.withColumns({"median_score": r6("median_score"), "threshold": r6("threshold")})


# --------------------------------------------------------------------------
# Evaluation.

EVAL_SQL = """WITH RECURSIVE pp AS (
  SELECT *, CASE label WHEN 'person' THEN 'person' WHEN 'motorcycle' THEN 'motor' WHEN 'car' THEN 'car' END AS shared_class FROM v_predictions
), gg AS (
  SELECT *, CASE WHEN label IN ('pedestrian', 'people') THEN 'person' WHEN label = 'motor' THEN 'motor' END AS shared_class FROM v_ground_truth
), p AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, frame_number, shared_class ORDER BY confidence DESC, prediction_index) AS rn
  FROM pp WHERE shared_class IS NOT NULL
), g AS (SELECT * FROM gg WHERE shared_class IS NOT NULL AND NOT ignored),
pairs AS (
  SELECT p.run_id, p.frame_number, p.shared_class, p.rn, p.prediction_index, g.ground_truth_index AS gi,
         CAST(least(p.x2, g.x2) - greatest(p.x1, g.x1) AS DOUBLE) / (40 - (least(p.x2, g.x2) - greatest(p.x1, g.x1))) AS iou
  FROM p JOIN g ON p.run_id = g.run_id AND p.frame_number = g.frame_index AND p.shared_class = g.shared_class
  WHERE least(p.x2, g.x2) > greatest(p.x1, g.x1)
), cand AS (
  SELECT p.run_id, p.frame_number, p.shared_class, p.rn, p.prediction_index,
         list({'iou': pairs.iou, 'gi': pairs.gi} ORDER BY pairs.iou DESC, pairs.gi) FILTER (WHERE pairs.gi IS NOT NULL) AS c
  FROM p LEFT JOIN pairs ON p.prediction_index = pairs.prediction_index
  GROUP BY p.run_id, p.frame_number, p.shared_class, p.rn, p.prediction_index
), step AS (
  SELECT run_id, frame_number, shared_class, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS prediction_index,
         CAST(NULL AS BIGINT) AS gi, CAST(NULL AS DOUBLE) AS iou, CAST([] AS BIGINT[]) AS used
  FROM (SELECT DISTINCT run_id, frame_number, shared_class FROM p) groups
  UNION ALL
  SELECT run_id, frame_number, shared_class, rn, prediction_index, best.gi, coalesce(best.iou, 0),
         CASE WHEN best.iou >= 0.5 THEN list_append(used, best.gi) ELSE used END
  FROM (
    SELECT cand.*, step.used, list_filter(cand.c, lambda x: NOT list_contains(step.used, x.gi))[1] AS best
    FROM step JOIN cand ON cand.run_id = step.run_id AND cand.frame_number = step.frame_number
     AND cand.shared_class = step.shared_class AND cand.rn = step.rn + 1
  ) s
), matches AS (
  SELECT run_id, frame_number, shared_class, CASE WHEN iou >= 0.5 THEN 'TP' ELSE 'FP' END AS status, prediction_index, gi AS ground_truth_index, iou
  FROM step WHERE rn > 0
  UNION ALL
  SELECT run_id, frame_index, shared_class, 'FN', NULL, ground_truth_index, NULL
  FROM g WHERE ground_truth_index NOT IN (SELECT gi FROM step WHERE iou >= 0.5)
), classes AS (SELECT unnest(['person', 'bicycle', 'motor', 'car', 'truck', 'bus']) AS shared_class),
counts AS (
  SELECT r.run_id, c.shared_class, count(CASE WHEN status = 'TP' THEN 1 END) AS true_positive,
         count(CASE WHEN status = 'FP' THEN 1 END) AS false_positive, count(CASE WHEN status = 'FN' THEN 1 END) AS false_negative,
         sum(CASE WHEN status = 'TP' THEN iou END) AS iou_sum
  FROM (SELECT DISTINCT run_id FROM v_frames) r CROSS JOIN classes c
  LEFT JOIN matches m ON m.run_id = r.run_id AND m.shared_class = c.shared_class GROUP BY r.run_id, c.shared_class
)"""
RATIO_SQL = """
  CASE WHEN true_positive + false_positive > 0 THEN round(true_positive / (true_positive + false_positive), 6) END AS precision,
  CASE WHEN true_positive + false_negative > 0 THEN round(true_positive / (true_positive + false_negative), 6) END AS recall,
  CASE WHEN true_positive + false_positive = 0 OR true_positive + false_negative = 0 THEN NULL
       ELSE round(2 * true_positive / (2 * true_positive + false_positive + false_negative), 6) END AS f1,
  CASE WHEN true_positive > 0 THEN round(iou_sum / true_positive, 6) END AS mean_matched_iou"""


def evaluated(spark, d) -> evaluation.Evaluation:
    return evaluation.evaluate(view(spark, d, "v_predictions"), view(spark, d, "v_ground_truth"))


def prepared(spark, d) -> tuple[DataFrame, DataFrame]:
    return (
        evaluation.prepare_predictions(view(spark, d, "v_predictions")),
        evaluation.prepare_ground_truth(view(spark, d, "v_ground_truth")),
    )


@query("evaluation_matches", EVAL_SQL + """
SELECT run_id, frame_number, shared_class, status, prediction_index, ground_truth_index, round(iou, 6) AS iou FROM matches""")
def evaluation_matches(spark, d):
    return evaluated(spark, d).matches.select(
        "run_id", "frame_number", "shared_class", "status", "prediction_index", "ground_truth_index", r6("iou").alias("iou")
    )


@query("evaluation_matches_of_crowds", EVAL_SQL + """
SELECT run_id, frame_number, shared_class, status, prediction_index, ground_truth_index, round(iou, 6) AS iou FROM matches""")
def evaluation_matches_of_crowds(spark, d):
    """The way of pictures that are too crowded for one task, taken by every picture with more than two boxes."""
    p, g = prepared(spark, d)
    inside = F.col("shared_class").isNotNull()
    found = evaluation.match_predictions(p.filter(inside), g.filter(inside & ~F.col("ignored_flag")), crowd=2)
    return found.select("run_id", "frame_number", "shared_class", "status", "prediction_index", "ground_truth_index", r6("iou").alias("iou"))


@query("class_metrics", EVAL_SQL + f"""
SELECT run_id, shared_class, true_positive + false_positive AS predictions, true_positive + false_negative AS ground_truth,
       true_positive, false_positive, false_negative, {RATIO_SQL} FROM counts""")
def class_metrics(spark, d):
    ratios = {c: r6(c) for c in ("precision", "recall", "f1", "mean_matched_iou")}
    return evaluated(spark, d).class_metrics.drop("matched_iou_sum").withColumns(ratios)


@query("overall_metrics", EVAL_SQL + f""", total AS (
  SELECT run_id, CAST(sum(true_positive) AS BIGINT) AS true_positive, CAST(sum(false_positive) AS BIGINT) AS false_positive,
         CAST(sum(false_negative) AS BIGINT) AS false_negative, sum(iou_sum) AS iou_sum FROM counts GROUP BY run_id
)
SELECT run_id, true_positive, false_positive, false_negative, {RATIO_SQL} FROM total""")
def overall_metrics(spark, d):
    ratios = {c: r6(c) for c in ("precision", "recall", "f1", "mean_matched_iou")}
    return evaluated(spark, d).overall.withColumns(ratios)


@query("evaluation_population", """
WITH p AS (
  SELECT run_id, count(*) AS predictions_total, CAST(sum(CASE WHEN label <> 'sports ball' THEN 1 ELSE 0 END) AS BIGINT) AS predictions_evaluated
  FROM v_predictions GROUP BY run_id
), g AS (
  SELECT run_id, count(*) AS ground_truth_total, CAST(sum(CASE WHEN ignored THEN 1 ELSE 0 END) AS BIGINT) AS ground_truth_ignored,
         CAST(sum(CASE WHEN NOT ignored AND label <> 'van' THEN 1 ELSE 0 END) AS BIGINT) AS ground_truth_evaluated,
         CAST(sum(CASE WHEN NOT ignored AND label = 'van' THEN 1 ELSE 0 END) AS BIGINT) AS ground_truth_out_of_ontology
  FROM v_ground_truth GROUP BY run_id
), f AS (
  SELECT run_id, frame_number FROM v_predictions WHERE label <> 'sports ball' UNION
  SELECT run_id, frame_index FROM v_ground_truth WHERE NOT ignored AND label <> 'van'
), r AS (SELECT run_id, count(*) AS evaluable_frames, min(frame_number) AS first_evaluable_frame, max(frame_number) AS last_evaluable_frame FROM f GROUP BY run_id)
SELECT p.*, predictions_total - predictions_evaluated AS predictions_out_of_ontology, ground_truth_total, ground_truth_ignored,
       ground_truth_evaluated, ground_truth_out_of_ontology, evaluable_frames, first_evaluable_frame, last_evaluable_frame
FROM p JOIN g ON p.run_id = g.run_id JOIN r ON p.run_id = r.run_id""")
def evaluation_population(spark, d):
    return evaluation.population_counts(*prepared(spark, d))


@query("excluded_labels", """
SELECT run_id, 'excluded_prediction' AS kind, label, count(*) AS rows FROM v_predictions WHERE label = 'sports ball' GROUP BY run_id, label
UNION ALL SELECT run_id, 'ignored_ground_truth', label, count(*) FROM v_ground_truth WHERE ignored GROUP BY run_id, label
UNION ALL SELECT run_id, 'excluded_ground_truth', label, count(*) FROM v_ground_truth WHERE NOT ignored AND label = 'van' GROUP BY run_id, label""")
def excluded_labels(spark, d):
    return evaluation.excluded_label_counts(*prepared(spark, d))


@query("ground_truth_of_processed_frames", """
SELECT run_id, count(*) AS rows FROM v_ground_truth WHERE frame_index % 6 = 0 AND frame_index < 3 * 150 * 2 GROUP BY run_id""")
def ground_truth_of_processed_frames(spark, d):
    frames = S.sample_frames(view(spark, d, "v_frames"), frame_step=3, max_frames=150)
    kept = evaluation.restrict_to_frames(view(spark, d, "v_ground_truth"), frames)
    return kept.groupBy("run_id").agg(F.count("*").alias("rows"))


@query("ontology_mapping", """
SELECT label, CASE label WHEN 'person' THEN 'person' WHEN 'motorcycle' THEN 'motor' WHEN 'car' THEN 'car' END AS shared_class,
       count(*) AS rows FROM v_predictions GROUP BY label""")
def ontology_mapping(spark, d):
    rows = view(spark, d, "v_predictions").groupBy("label").agg(F.count("*").alias("rows"))
    return rows.select("label", O.shared_class_of_prediction(F.col("label")).alias("shared_class"), "rows")


@query("invalid_boxes", """
SELECT count(*) AS invalid FROM v_native WHERE floor(bbox_left + bbox_width) <= floor(bbox_left) OR floor(bbox_top + bbox_height - 1) <= floor(bbox_top)""")
def invalid_boxes(spark, d):
    """Boxes without width or height, once a pixel is taken off the height."""
    n = view(spark, d, "v_native")
    corners = G.xywh_to_xyxy(F.col("bbox_left"), F.col("bbox_top"), F.col("bbox_width"), F.col("bbox_height") - 1)
    boxes = n.select(*[c.alias(name) for c, name in zip(corners, ("x1", "y1", "x2", "y2"))])
    return boxes.agg(F.count_if(G.invalid_box(G.box())).alias("invalid"))


# --------------------------------------------------------------------------
# Fusion.

CONFIG = fusion.FusionConfig(max_time_delta_s=1800.0)

FUSE_SQL = """WITH RECURSIVE gap AS (
  SELECT *, coalesce(label, '-') AS lab,
         CASE WHEN timestamp_s - lag(timestamp_s) OVER (PARTITION BY event_type, coalesce(label, '-') ORDER BY timestamp_s, sensor_id, event_id) <= 1800
              THEN 0 ELSE 1 END AS cut FROM v_evidence
), ses AS (
  SELECT *, sum(cut) OVER (PARTITION BY event_type, lab ORDER BY timestamp_s, sensor_id, event_id) AS session FROM gap
), ev AS (
  SELECT *, row_number() OVER (ORDER BY timestamp_s, sensor_id, event_id) AS pos,
         row_number() OVER (PARTITION BY event_type, lab, session ORDER BY timestamp_s, sensor_id, event_id) AS rn
  FROM ses
), pairs AS (
  SELECT a.pos, c.sensor_id, c.pos AS cpos, abs(a.timestamp_s - c.timestamp_s) AS gap
  FROM ev a JOIN ev c ON a.event_type = c.event_type AND a.lab = c.lab AND a.session = c.session AND a.sensor_id <> c.sensor_id
   AND abs(a.timestamp_s - c.timestamp_s) <= 1800
), cand AS (
  SELECT e.event_type, e.lab, e.session, e.rn, e.pos,
         list({'sensor': p.sensor_id, 'pos': p.cpos} ORDER BY p.gap, p.cpos) FILTER (WHERE p.cpos IS NOT NULL) AS c
  FROM ev e LEFT JOIN pairs p ON e.pos = p.pos GROUP BY e.event_type, e.lab, e.session, e.rn, e.pos
), step AS (
  SELECT event_type, lab, session, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS used, CAST([] AS BIGINT[]) AS members
  FROM (SELECT DISTINCT event_type, lab, session FROM ev) groups
  UNION ALL
  SELECT event_type, lab, session, rn, CASE WHEN len(members) > 1 THEN list_concat(used, members) ELSE used END, members
  FROM (
    SELECT q.event_type, q.lab, q.session, q.rn, q.used,
           CASE WHEN list_contains(q.used, q.pos) OR q.free IS NULL OR len(q.free) = 0 THEN CAST([] AS BIGINT[])
                WHEN list_filter(q.free, lambda x: x.sensor <> q.free[1].sensor)[1] IS NULL THEN [q.pos, q.free[1].pos]
                ELSE [q.pos, q.free[1].pos, list_filter(q.free, lambda x: x.sensor <> q.free[1].sensor)[1].pos] END AS members
    FROM (
      SELECT cand.*, step.used, list_filter(cand.c, lambda x: NOT list_contains(step.used, x.pos)) AS free
      FROM step JOIN cand ON cand.event_type = step.event_type AND cand.lab = step.lab AND cand.session = step.session AND cand.rn = step.rn + 1
    ) q
  ) s
), grp AS (
  SELECT members, members[1] AS anchor, row_number() OVER (ORDER BY members[1]) AS n FROM step WHERE len(members) > 1
), mem AS (
  SELECT anchor, n, unnest(members) AS pos, generate_subscripts(members, 1) - 1 AS member_order FROM grp
), full_rows AS (
  SELECT mem.anchor, mem.n, mem.member_order, ev.* FROM mem JOIN ev ON mem.pos = ev.pos
), fused AS (
  SELECT n, printf('fusion:%06d:%s', n, max(event_type)) AS event_id, max(CASE WHEN member_order = 0 THEN frame_number END) AS frame_number,
         sum(timestamp_s) / count(*) AS t, max(event_type) AS event_type,
         CASE max(CASE severity WHEN 'critical' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'critical' WHEN 1 THEN 'warning' ELSE 'info' END AS severity,
         max(label) AS label, count(*) AS support_count, max(timestamp_s) - min(timestamp_s) AS span,
         string_agg(sensor_id, ',' ORDER BY member_order) AS sensor_ids, string_agg(event_id, ',' ORDER BY member_order) AS contributor_event_ids
  FROM full_rows GROUP BY n
)"""


def fused_result(spark, d) -> fusion.Fusion:
    return fusion.fuse_events(view(spark, d, "v_evidence"), CONFIG)


@query("fused_events", FUSE_SQL + """
SELECT event_id, frame_number, round(t, 2) AS timestamp_s, event_type, severity, label, support_count, round(span, 2) AS time_span_s,
       sensor_ids, contributor_event_ids FROM fused""")
def fused_events(spark, d):
    return fused_result(spark, d).events.select(
        "event_id", "frame_number", r6("timestamp_s", 2).alias("timestamp_s"), "event_type", "severity", "label",
        "support_count", r6("time_span_s", 2).alias("time_span_s"), F.array_join("sensor_ids", ",").alias("sensor_ids"),
        F.array_join("contributor_event_ids", ",").alias("contributor_event_ids"),
    )


@query("fused_in_small_chunks", FUSE_SQL + """
SELECT event_id, round(t, 2) AS timestamp_s, event_type, label, support_count, sensor_ids, contributor_event_ids FROM fused""")
def fused_in_small_chunks(spark, d):
    """The hand-off between chunks at work: groups are cut every twelve times the reach."""
    events = fusion.fuse_events(view(spark, d, "v_evidence"), CONFIG, width_s=12 * CONFIG.max_time_delta_s).events
    return events.select(
        "event_id", r6("timestamp_s", 2).alias("timestamp_s"), "event_type", "label", "support_count",
        F.array_join("sensor_ids", ",").alias("sensor_ids"), F.array_join("contributor_event_ids", ",").alias("contributor_event_ids"))


@query("fusion_contributors", FUSE_SQL + """
SELECT fused.event_id AS fusion_event_id, run_id, sensor_id, modality, r.event_id, r.frame_number, r.severity, r.label,
       round(r.timestamp_s - fused.t, 2) AS time_delta_from_fused_s FROM full_rows r JOIN fused ON r.n = fused.n""")
def fusion_contributors(spark, d):
    return fused_result(spark, d).contributors.select(
        "fusion_event_id", "run_id", "sensor_id", "modality", "event_id", "frame_number", "severity", "label",
        r6("time_delta_from_fused_s", 2).alias("time_delta_from_fused_s"),
    )


@query("fusion_alerts", FUSE_SQL + """
SELECT concat('alert:', event_id) AS alert_id, event_id, event_type AS alert_type, severity FROM fused WHERE severity <> 'info'""")
def fusion_alerts(spark, d):
    return fused_result(spark, d).alerts.select("alert_id", "event_id", "alert_type", "severity")


@query("fusion_summary", FUSE_SQL + " SELECT event_type AS label, count(*) AS events FROM fused GROUP BY event_type")
def fusion_summary(spark, d):
    return fusion.fusion_summary(fused_result(spark, d).events)


@query("fusion_counters", FUSE_SQL + """
SELECT (SELECT count(*) FROM ev) AS input_events, (SELECT count(DISTINCT sensor_id) FROM ev) AS distinct_sensors,
       (SELECT count(*) FROM fused) AS fused_events, (SELECT count(*) FROM fused WHERE severity <> 'info') AS fused_alerts,
       (SELECT count(*) FROM full_rows) AS contributors""")
def fusion_counters(spark, d):
    evidence = view(spark, d, "v_evidence")
    return fusion.fusion_counters(evidence, fusion.fuse_events(evidence, CONFIG))


@query("consensus_support", """
SELECT a.event_id, count(c.event_id) AS compatible_events FROM v_evidence a LEFT JOIN v_evidence c
  ON a.event_type = c.event_type AND a.label IS NOT DISTINCT FROM c.label AND a.sensor_id <> c.sensor_id
 AND abs(a.timestamp_s - c.timestamp_s) <= 1800 GROUP BY a.event_id""")
def consensus_support(spark, d):
    return fusion.consensus_support(view(spark, d, "v_evidence"), CONFIG).select("event_id", "compatible_events")


#: A box of each event, made from its columns: events of one time and place overlap in part.
EVENT_BOX = "struct(CAST(frame_number % 50 AS DOUBLE) AS x1, 0.0D AS y1, CAST(frame_number % 50 + 30 AS DOUBLE) AS x2, 20.0D AS y2)"


@query("consensus_support_of_boxes", """
WITH e AS (SELECT *, CAST(frame_number % 50 AS DOUBLE) AS x FROM v_evidence)
SELECT a.event_id, count(c.event_id) AS compatible_events FROM e a LEFT JOIN e c
  ON a.event_type = c.event_type AND a.label IS NOT DISTINCT FROM c.label AND a.sensor_id <> c.sensor_id
 AND abs(a.timestamp_s - c.timestamp_s) <= 1800 AND greatest(0, 30 - abs(a.x - c.x)) * 20 / (1200 - greatest(0, 30 - abs(a.x - c.x)) * 20) >= 0.3
GROUP BY a.event_id""")
def consensus_support_of_boxes(spark, d):
    evidence = view(spark, d, "v_evidence").withColumn("bbox", F.expr(EVENT_BOX))
    gated = replace(CONFIG, spatial_iou_threshold=0.3)
    return fusion.consensus_support(evidence, gated).select("event_id", "compatible_events")


PAIRS_SQL = """
WITH e AS (SELECT *, CAST(frame_number % 50 AS DOUBLE) AS x FROM v_evidence), p AS (
SELECT a.event_id AS a_event_id, b.event_id AS b_event_id, a.sensor_id AS a_sensor_id, b.sensor_id AS b_sensor_id, round(abs(a.timestamp_s - b.timestamp_s), 3) AS time_gap_s,
       round(greatest(0, 30 - abs(a.x - b.x)) * 20 / (1200 - greatest(0, 30 - abs(a.x - b.x)) * 20), 6) AS iou
FROM e a JOIN e b ON a.event_type = b.event_type AND a.label IS NOT DISTINCT FROM b.label AND a.sensor_id <> b.sensor_id AND abs(a.timestamp_s - b.timestamp_s) <= 1800
 AND (a.timestamp_s < b.timestamp_s OR (a.timestamp_s = b.timestamp_s AND a.sensor_id < b.sensor_id))) SELECT * FROM p"""


def paired(spark: SparkSession, d: str, **options) -> DataFrame:
    evidence = view(spark, d, "v_evidence").withColumn("bbox", F.expr(EVENT_BOX))
    pairs = fusion.compatible_pairs(evidence, replace(CONFIG, **options), cell_rows=3)
    return pairs.select("a_event_id", "b_event_id", "a_sensor_id", "b_sensor_id", r6_of_many("time_gap_s", 3).alias("time_gap_s"), r6_of_many("iou").alias("iou"))


@query("compatible_pairs", PAIRS_SQL)
def compatible_pairs(spark, d):
    """Every cell with more than three events is hot here, so the dealt way is the one that is checked."""
    return paired(spark, d)


@query("compatible_pairs_of_boxes", PAIRS_SQL + " WHERE iou >= 0.3")
def compatible_pairs_of_boxes(spark, d):
    return paired(spark, d, spatial_iou_threshold=0.3)


@query("evidence_of_runs", TRACKS_SQL + """
SELECT r.run_id, concat('CAM_', r.run_id) AS sensor_id, r.event_id, r.frame_number, r.track_id, t.x1 AS bx1, t.x2 AS bx2
FROM (SELECT run_id, frame_number, track_id, concat('role', CAST(track_id AS STRING), '_', CAST(frame_number AS STRING)) AS event_id
      FROM tracks WHERE scenario_role IS NOT NULL) r
JOIN tracks t ON t.run_id = r.run_id AND t.frame_number = r.frame_number AND t.track_id = r.track_id""")
def evidence_of_runs(spark, d):
    found = stored_tracks(spark, d)
    events = found.filter("scenario_role IS NOT NULL").select(
        "run_id", "frame_number", "timestamp_s", "track_id", "label", "confidence",
        F.concat(F.lit("role"), F.col("track_id"), F.lit("_"), F.col("frame_number")).alias("event_id"),
        F.col("scenario_role").alias("event_type"), F.lit("info").alias("severity"), F.lit("test").alias("source"),
    )
    runs = view(spark, d, "v_frames").select("run_id", "sensor_id", "modality").distinct()
    evidence = IO.evidence_from_runs(events, runs, found)
    return evidence.select(
        "run_id", "sensor_id", "event_id", "frame_number", "track_id",
        F.col("bbox.x1").cast("int").alias("bx1"), F.col("bbox.x2").cast("int").alias("bx2"),
    )


# --------------------------------------------------------------------------
# Sources.

@query("frames_of_folder", """
SELECT event_type AS run_id, path AS image_path, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) - 1 AS frame_ordinal,
       round((row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) - 1) / 30e0, 6) AS timestamp_s
FROM (SELECT *, concat('/data/', event_type, '/', CASE WHEN value > 50 THEN 'Img' ELSE 'img' END, CAST(user_id AS STRING), '_', CAST(event_id AS STRING), '.jpg') AS path FROM events) e""")
def frames_of_folder(spark, d):
    return D.frames_of_folder(view(spark, d, "v_paths")).select(
        "run_id", "image_path", "frame_ordinal", r6("timestamp_s").alias("timestamp_s")
    )


@query("frames_of_visdrone", """
SELECT concat('uav', CAST(user_id % 9 AS STRING)) AS run_id, event_id AS frame_number, concat('VISDRONE:uav', CAST(user_id % 9 AS STRING)) AS sensor_id,
       row_number() OVER (PARTITION BY user_id % 9 ORDER BY event_id) - 1 AS frame_ordinal FROM events""")
def frames_of_visdrone(spark, d):
    path = F.format_string("/d/sequences/uav%d/%07d.jpg", F.col("user_id") % 9, F.col("event_id"))
    return D.frames_of_visdrone(view(spark, d, "events").select(path.alias("path"))).select(
        "run_id", "frame_number", "sensor_id", "frame_ordinal"
    )


@query("frames_of_uavdt", """
SELECT concat('M', CAST(user_id % 9 AS STRING)) AS run_id, event_id AS frame_number,
       row_number() OVER (PARTITION BY user_id % 9 ORDER BY event_id) - 1 AS frame_ordinal FROM events""")
def frames_of_uavdt(spark, d):
    path = F.format_string("/d/UAV-benchmark-M/M%d/img%06d.jpg", F.col("user_id") % 9, F.col("event_id"))
    return D.frames_of_uavdt(view(spark, d, "events").select(path.alias("path"))).select(
        "run_id", "frame_number", "frame_ordinal"
    )


@query("source_summary", """
SELECT count(DISTINCT user_id) AS sequence_count, count(*) AS frame_count, count(DISTINCT user_id) > 5 AS sequence_list_truncated,
       'seq0,seq1,seq2,seq3,seq4' AS first_sequences FROM events""")
def source_summary(spark, d):
    runs = view(spark, d, "events").select(F.concat(F.lit("seq"), F.col("user_id")).alias("run_id"))
    return D.summarise_sources(runs, sequence_limit=5).withColumn("first_sequences", F.array_join("first_sequences", ","))


NATIVE_LABEL_SQL = """CASE object_category WHEN 0 THEN 'ignored_region' WHEN 1 THEN 'pedestrian' WHEN 2 THEN 'people' WHEN 3 THEN 'bicycle'
  WHEN 4 THEN 'car' WHEN 5 THEN 'van' WHEN 6 THEN 'truck' WHEN 7 THEN 'tricycle' WHEN 8 THEN 'awning_tricycle' WHEN 9 THEN 'bus'
  WHEN 10 THEN 'motor' WHEN 11 THEN 'others' ELSE 'unknown' END"""


@query("native_annotations", f"""
SELECT run_id, {NATIVE_LABEL_SQL} AS label, object_category = 0 OR score <= 0 AS ignored, count(*) AS rows,
       CAST(sum(CAST(floor(bbox_left) AS BIGINT)) AS BIGINT) AS x1_sum, CAST(sum(CAST(floor(bbox_left + bbox_width) AS BIGINT)) AS BIGINT) AS x2_sum
FROM v_native GROUP BY 1, 2, 3""")
def native_annotations(spark, d):
    path = scratch_path(spark, "annotations")
    native = view(spark, d, "v_native")
    columns = [c for c in native.columns if c != "run_id"]
    native.write.partitionBy("run_id").csv(path)
    raw = spark.read.schema(D.NATIVE_ANNOTATIONS).option("mode", "FAILFAST").csv(f"{path}/run_id=*/*.csv")
    raw = raw.select(*columns, F.regexp_extract(F.col("_metadata.file_path"), r"run_id=([^/]+)/", 1).alias("run_id"))
    return D.annotations_from_native(raw).groupBy("run_id", "label", "ignored").agg(
        F.count("*").alias("rows"), F.sum("x1").alias("x1_sum"), F.sum("x2").alias("x2_sum")
    )


@query("annotations_as_detections", """
SELECT run_id, frame_index AS frame_number, target_id AS object_id, label, CAST(1.0 AS DOUBLE) AS confidence, 'ground_truth' AS detector,
       row_number() OVER (PARTITION BY run_id, frame_index ORDER BY target_id) - 1 AS detection_index
FROM v_ground_truth WHERE NOT ignored""")
def annotations_as_detections(spark, d):
    return D.annotations_as_detections(view(spark, d, "v_ground_truth")).select(
        "run_id", "frame_number", "object_id", "label", "confidence", "detector", "detection_index"
    )


@query("coco_documents", """
SELECT (SELECT count(*) FROM v_images) AS images, (SELECT count(*) FROM v_annotations WHERE image_id IN (SELECT id FROM v_images)) AS annotations,
       (SELECT CAST(sum(id) AS BIGINT) FROM v_images) AS id_sum""")
def coco_documents(spark, d):
    """Documents of at most 1000 images each, written as JSON lines and read back."""
    shard = F.floor(F.col("image_id") / 1000)
    images = view(spark, d, "v_images")
    annotations = view(spark, d, "v_annotations").withColumn("bbox", F.array().cast("array<double>"))
    by_image = annotations.join(images.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    packed = images.groupBy(F.floor(F.col("id") / 1000).alias("shard")).agg(F.collect_list(F.struct("id", "file_name", "width", "height")).alias("images"))
    notes = by_image.groupBy(shard.alias("shard")).agg(F.collect_list(F.struct("id", "image_id", "category_id", "bbox")).alias("annotations"))
    categories = F.array(F.struct(F.lit(1).alias("id"), F.lit("person").alias("name")))
    doc = packed.join(notes, "shard", "left").select(
        "images", F.coalesce("annotations", F.array()).alias("annotations"), categories.alias("categories")
    )
    path = scratch_path(spark, "coco")
    IO.write_document(doc, path)
    i, a, _ = D.read_coco(spark, path, multi_line=False)
    return i.agg(F.count("*").alias("images"), F.sum("id").alias("id_sum")).crossJoin(
        a.agg(F.count("*").alias("annotations"))
    ).select("images", "annotations", "id_sum")


@query("file_inventory", "SELECT path, length, sha256(text) AS sha256 FROM (SELECT replace(path, concat('.', category), '.png') AS path, length, text FROM v_files) f")
def file_inventory(spark, d):
    files = view(spark, d, "v_files").select(
        F.regexp_replace("path", r"\.[a-z]+$", ".png").alias("path"), "length", F.col("text").cast("binary").alias("content")
    )
    return D.inventory_of(files)


@query("inventory_digest", """
WITH m AS (SELECT sha256(concat(sha256(path), sha256(text))) AS mark FROM v_files),
s AS (SELECT count(*) AS files, """ + ", ".join(f"sum(CAST(concat('0x', substr(mark, {8 * k + 1}, 8)) AS BIGINT)) AS s{k}" for k in range(8)) + """ FROM m)
SELECT files, sha256(concat_ws(',', files, s0, s1, s2, s3, s4, s5, s6, s7)) AS digest FROM s""")
def inventory_digest(spark, d):
    return D.inventory_digest(view(spark, d, "v_files").select("path", F.sha2("text", 256).alias("sha256")))


@query("vector_pack_round_trip", """
SELECT vec_id, row_number() OVER (ORDER BY frame_ordinal, confidence DESC, track_id) - 1 AS embedding_row, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
       round(CAST(embedding[64] AS DOUBLE), 6) AS last_value FROM v_reps WHERE run_id = 'run_0'""")
def vector_pack_round_trip(spark, d):
    """A pack of several files, read in ranges of a few rows, meets its index again by row."""
    rows = materialize(R.number_embeddings(view(spark, d, "v_reps").filter("run_id = 'run_0'")), "pack-index")
    path = scratch_path(spark, "pack")
    packs.write_vectors(rows, path, 64, rows_per_file=100)
    back = D.join_vectors(rows.select("vec_id", "embedding_row"), packs.read_vectors(spark, path, 64, range_bytes=4 * 64 * 30))
    ends = {"first_value": F.get("embedding", F.lit(0)), "last_value": F.get("embedding", F.lit(63))}
    return back.select("vec_id", "embedding_row", *[r6(c.cast("double")).alias(n) for n, c in ends.items()])


@query("vectors_of_representations", "SELECT vec_id, run_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first_value FROM v_reps")
def vectors_of_representations(spark, d):
    rows = view(spark, d, "v_reps")
    vectors = view(spark, d, "embeddings").select("vec_id", "embedding")
    return D.join_vectors(rows.select("vec_id", "run_id"), vectors, ["vec_id"]).select(
        "vec_id", "run_id", r6(F.col("embedding")[0].cast("double")).alias("first_value")
    )


# --------------------------------------------------------------------------
# Subsets, splits and the probe.

@query("coco_eligible_images", """
SELECT count(*) AS images FROM v_images WHERE id IN (SELECT image_id FROM v_annotations WHERE category_id IN (1, 2))""")
def coco_eligible_images(spark, d):
    ids = S.category_ids(view(spark, d, "v_categories"), ["person", "car"])
    return S.eligible_images(view(spark, d, "v_images"), view(spark, d, "v_annotations"), ids).agg(
        F.count("*").alias("images")
    )


@query("coco_subset", """
WITH pick AS (
  SELECT id FROM v_images WHERE id IN (SELECT image_id FROM v_annotations WHERE category_id IN (1, 2))
  ORDER BY md5(concat('7:', CAST(id AS STRING))), id LIMIT 500
)
SELECT count(*) AS selected_annotations, (SELECT count(*) FROM pick) AS selected_images, CAST(sum(a.image_id) AS BIGINT) AS image_id_sum
FROM v_annotations a WHERE a.category_id IN (1, 2) AND a.image_id IN (SELECT id FROM pick)""")
def coco_subset(spark, d):
    subset = S.coco_subset(
        view(spark, d, "v_images"), view(spark, d, "v_annotations"), view(spark, d, "v_categories"),
        names=["person", "car"], max_images=500, seed=7,
    )
    return subset.counts().crossJoin(subset.annotations.agg(F.sum("image_id").alias("image_id_sum")))


@query("stratified_split", """
WITH r AS (
  SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', CAST(vec_id AS STRING))), vec_id) AS k,
         count(*) OVER (PARTITION BY label) AS n FROM embeddings
)
SELECT vec_id, label, k <= greatest(1, round_even(n * 0.3e0, 0)) AS is_test FROM r""")
def stratified_split(spark, d):
    return S.stratified_split(view(spark, d, "embeddings").select("vec_id", "label"), "label", ["vec_id"])


@query("systematic_sample", """
WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings)
SELECT label, vec_id FROM r WHERE k % 5 = 0""")
def systematic_sample(spark, d):
    return S.every_kth(view(spark, d, "embeddings").select("label", "vec_id"), ["label"], "vec_id", 5)


@query("linear_probe_accuracy")
def linear_probe_accuracy(spark, d):
    split = materialize(S.stratified_split(view(spark, d, "embeddings"), "label", ["vec_id"]), "split")
    model = S.linear_probe(split.filter("NOT is_test"))
    guessed = S.probe_predictions(model, split.filter("is_test"))
    return evaluation.accuracy(guessed.withColumn("truth", F.col("label").cast("string")), "truth", "predicted")


@query("linear_probe_predictions", """
WITH r AS (
  SELECT label, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', CAST(vec_id AS STRING))), vec_id) AS k,
         count(*) OVER (PARTITION BY label) AS n FROM embeddings
)
SELECT label, count(*) AS rows, count(CASE WHEN k <= greatest(1, round_even(n * 0.3e0, 0)) THEN 1 END) AS test_rows,
       count(CASE WHEN k <= greatest(1, round_even(n * 0.3e0, 0)) THEN 1 END) AS valid_predictions FROM r GROUP BY label""")
def linear_probe_predictions(spark, d):
    """Counts of the probe by label; a valid prediction is one of the labels trained on."""
    split = materialize(S.stratified_split(view(spark, d, "embeddings"), "label", ["vec_id"]), "split")
    model = S.linear_probe(split.filter("NOT is_test"))
    guessed = S.probe_predictions(model, split.filter("is_test"))
    valid = F.col("predicted").isin(*model.stages[0].labels)
    tested = guessed.groupBy("label").agg(F.count("*").alias("test_rows"), F.count(F.when(valid, 1)).alias("valid_predictions"))
    return split.groupBy("label").agg(F.count("*").alias("rows")).join(tested, "label")


GUESS_SQL = "SELECT CASE WHEN l_returnflag = 'A' THEN 'x' ELSE l_linestatus END AS truth, CASE WHEN l_quantity > 25 THEN 'x' ELSE l_linestatus END AS predicted FROM lineitem"


def guesses(spark, d) -> DataFrame:
    return view(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "A", F.lit("x")).otherwise(F.col("l_linestatus")).alias("truth"),
        F.when(F.col("l_quantity") > 25, F.lit("x")).otherwise(F.col("l_linestatus")).alias("predicted"),
    )


@query("classification_report", f"""
WITH g AS ({GUESS_SQL}), l AS (SELECT DISTINCT truth AS label FROM g UNION SELECT predicted FROM g),
c AS (
  SELECT label, count(CASE WHEN truth = label THEN 1 END) AS support, count(CASE WHEN predicted = label THEN 1 END) AS guessed,
         count(CASE WHEN truth = label AND predicted = label THEN 1 END) AS tp FROM l CROSS JOIN g GROUP BY label
)
SELECT label, round(tp / guessed, 6) AS precision, round(tp / support, 6) AS recall, round(2 * tp / (guessed + support), 6) AS f1, support FROM c""")
def classification_report(spark, d):
    report = evaluation.classification_report(guesses(spark, d), "truth", "predicted")
    return report.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("confusion_matrix", f"""
WITH g AS ({GUESS_SQL})
SELECT truth AS label, count(CASE WHEN predicted = 'F' THEN 1 END) AS "F", count(CASE WHEN predicted = 'O' THEN 1 END) AS "O",
       count(CASE WHEN predicted = 'x' THEN 1 END) AS x FROM g GROUP BY truth""")
def confusion_matrix(spark, d):
    return evaluation.confusion_matrix(guesses(spark, d), "truth", "predicted", ["F", "O", "x"])


@query("classification_accuracy", f"""
WITH g AS ({GUESS_SQL}) SELECT count(*) AS rows, round(avg(CASE WHEN truth = predicted THEN 1e0 ELSE 0e0 END), 6) AS accuracy FROM g""")
def classification_accuracy(spark, d):
    return evaluation.accuracy(guesses(spark, d), "truth", "predicted").withColumn("accuracy", r6("accuracy"))


# --------------------------------------------------------------------------
# Contracts.

@query("frame_manifest_violations", """
WITH f AS (
  SELECT concat('m', CAST(user_id % 4 AS STRING)) AS run_id, event_id AS o, concat('f', CAST(floor(event_id / 3) AS STRING)) AS frame_id,
         event_id - 5 AS frame_number, user_id % 5 AS width, floor(value) AS timestamp_s FROM events
), l AS (SELECT *, lag(timestamp_s) OVER (PARTITION BY run_id ORDER BY o) AS before FROM f),
d AS (SELECT run_id, frame_id, count(*) AS n FROM f GROUP BY run_id, frame_id)
SELECT run_id, 'negative_frame_number' AS "check", CAST(sum(CASE WHEN frame_number < 0 THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM f GROUP BY run_id
UNION ALL SELECT run_id, 'non_positive_size', CAST(sum(CASE WHEN width <= 0 THEN 1 ELSE 0 END) AS BIGINT) FROM f GROUP BY run_id
UNION ALL SELECT run_id, 'duplicate_frame_id', CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) FROM d GROUP BY run_id
UNION ALL SELECT run_id, 'timestamp_goes_back', CAST(sum(CASE WHEN timestamp_s < before THEN 1 ELSE 0 END) AS BIGINT) FROM l GROUP BY run_id""")
def frame_manifest_violations(spark, d):
    e = F.col("event_id")
    frames = view(spark, d, "events").select(
        F.concat(F.lit("m"), F.col("user_id") % 4).alias("run_id"), e.alias("frame_ordinal"),
        F.concat(F.lit("f"), F.floor(e / 3)).alias("frame_id"), (e - 5).alias("frame_number"),
        (F.col("user_id") % 5).alias("width"), F.lit(10).alias("height"), F.floor("value").cast("double").alias("timestamp_s"),
        F.lit("").alias("image_path"), F.lit("s").alias("sensor_id"), F.lit("EO").alias("modality"), F.lit("").alias("source_path"),
    )
    return contracts.frame_manifest_violations(frames, bucket=64)


@query("missing_frame_files", """
SELECT run_id, count(*) AS missing FROM v_frames WHERE frame_ordinal % 2 = 1 GROUP BY run_id""")
def missing_frame_files(spark, d):
    frames = view(spark, d, "v_frames")
    listing = frames.filter("frame_ordinal % 2 = 0").select(F.col("image_path").alias("path"))
    return contracts.missing_files(frames, listing).groupBy("run_id").agg(F.count("*").alias("missing"))


@query("sensor_run_violations", """
SELECT run_id, 'missing_sensor_id' AS "check", CAST(0 AS BIGINT) AS violations FROM v_manifests
UNION ALL SELECT run_id, 'unsupported_modality', CAST(CASE WHEN modality = 'OTHER' THEN 1 ELSE 0 END AS BIGINT) FROM v_manifests
UNION ALL SELECT run_id, 'unsupported_severity', CAST(sum(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS BIGINT) FROM v_sensor_events GROUP BY run_id""")
def sensor_run_violations(spark, d):
    manifests = view(spark, d, "v_manifests").withColumn(
        "modality", F.when(F.col("modality") == "OTHER", F.lit("RADAR")).otherwise(F.col("modality"))
    )
    events = view(spark, d, "v_sensor_events").withColumn(
        "severity", F.when(F.col("severity") == "critical", F.lit("fatal")).otherwise(F.col("severity"))
    )
    return contracts.sensor_run_violations(events, manifests)


@query("fusion_input_violations", """
SELECT 'fewer_than_two_runs' AS "check", CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'duplicate_sensor', CAST(0 AS BIGINT)
UNION ALL SELECT 'too_few_sensors', CASE WHEN count(DISTINCT sensor_id) < 4 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END FROM v_manifests
UNION ALL SELECT 'unfinished_run', count(*) FROM v_manifests WHERE modality = 'IR'""")
def fusion_input_violations(spark, d):
    runs = view(spark, d, "v_manifests").withColumn(
        "status", F.when(F.col("modality") == "IR", F.lit("running")).otherwise(F.col("status"))
    )
    return contracts.fusion_input_violations(runs, min_sensors=4)


@query("evaluation_scope_violations", """
SELECT run_id, 'ground_truth_scope' AS "check", CAST(CASE WHEN modality = 'IR' THEN 1 ELSE 0 END AS BIGINT) AS violations FROM v_manifests""")
def evaluation_scope_violations(spark, d):
    runs = view(spark, d, "v_manifests").withColumn(
        "ground_truth_scope", F.when(F.col("modality") != "IR", F.col("ground_truth_scope"))
    )
    return contracts.evaluation_scope_violations(runs)


@query("embedding_violations", """
SELECT run_id, 'extra_dimensions' AS "check", CAST(1 AS BIGINT) AS violations FROM v_reps GROUP BY run_id
UNION ALL SELECT run_id, 'foreign_embedder', CAST(sum(CASE WHEN track_id = 3 THEN 1 ELSE 0 END) AS BIGINT) FROM v_reps GROUP BY run_id""")
def embedding_violations(spark, d):
    rows = view(spark, d, "v_reps").select(
        "run_id", F.when(F.col("track_id") == 3, F.lit("other")).otherwise(F.lit("given")).alias("source"),
        F.when(F.col("track_id") == 2, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("embedding"),
    )
    return contracts.embedding_violations(rows, embedder_name="given")


@query("record_quarantine", """
SELECT event_id, CASE WHEN event_id < 7 THEN 'negative_frame_number' ELSE '' END AS frame_problem,
       CASE WHEN value < 1 THEN 'negative_timestamp' ELSE '' END AS time_problem FROM events WHERE event_id < 7 OR value < 1""")
def record_quarantine(spark, d):
    rows = view(spark, d, "events").select(
        "event_id", (F.col("event_id") - 7).alias("frame_number"), (F.col("value") - 1).alias("timestamp_s")
    )
    _, bad = contracts.quarantine(rows)
    has = lambda name: F.when(F.array_contains("problems", name), F.lit(name)).otherwise(F.lit(""))
    return bad.select(
        "event_id", has("negative_frame_number").alias("frame_problem"), has("negative_timestamp").alias("time_problem")
    )


@query("ground_truth_out_of_range", """
SELECT g.run_id, count(*) AS rows FROM v_ground_truth g
JOIN (SELECT run_id, max(frame_number) AS m FROM v_frames WHERE frame_ordinal * 4 < (SELECT max(frame_ordinal) FROM v_frames) GROUP BY run_id) f
  ON g.run_id = f.run_id WHERE g.frame_index > f.m GROUP BY g.run_id""")
def ground_truth_out_of_range(spark, d):
    frames = view(spark, d, "v_frames")
    last = frames.agg(F.max("frame_ordinal")).first()[0]  # recordings that broke off after a quarter
    frames = frames.filter(F.col("frame_ordinal") * 4 < last)
    beyond = contracts.ground_truth_out_of_range(view(spark, d, "v_ground_truth"), frames)
    return beyond.groupBy("run_id").agg(F.count("*").alias("rows"))


@query("timestamp_order", """
WITH l AS (SELECT user_id, event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
SELECT user_id, event_id, round(before, 6) AS before FROM l""")
def timestamp_order(spark, d):
    linked = previous(view(spark, d, "events"), ["user_id"], "event_id", ["value"], "b", 256)
    return linked.select("user_id", "event_id", r6("b.value").alias("before"))


# --------------------------------------------------------------------------
# Sinks.

@query("evidence_round_trip", """
SELECT run_id, count(*) AS detections, round(sum(confidence), 6) AS confidence, CAST(sum(x1) AS BIGINT) AS x1 FROM v_detections GROUP BY run_id""")
def evidence_round_trip(spark, d):
    path = scratch_path(spark, "evidence")
    detections = view(spark, d, "v_detections")
    IO.write_evidence({"detections": detections, "frames": view(spark, d, "v_frames")}, path)
    return IO.read_table(spark, "detections", f"{path}/detections").groupBy("run_id").agg(
        F.count("*").alias("detections"), r6(F.sum("confidence")).alias("confidence"), F.sum("x1").alias("x1")
    )


@query("exchange_round_trip", """
SELECT run_id, count(*) AS frames, CAST(sum(width) AS BIGINT) AS width, round(max(timestamp_s), 6) AS last_s FROM v_frames GROUP BY run_id""")
def exchange_round_trip(spark, d):
    path = scratch_path(spark, "exchange")
    IO.write_evidence({"frames": view(spark, d, "v_frames")}, path, fmt="csv")
    return IO.read_frames(spark, f"{path}/frames", fmt="csv").groupBy("run_id").agg(
        F.count("*").alias("frames"), F.sum("width").alias("width"), r6(F.max("timestamp_s")).alias("last_s")
    )


@query("result_tables_round_trip", EVAL_SQL + """
SELECT run_id, CAST(sum(true_positive) AS BIGINT) AS true_positive, CAST(sum(false_positive) AS BIGINT) AS false_positive,
       CAST(sum(false_negative) AS BIGINT) AS false_negative,
       (SELECT count(*) FROM v_predictions p WHERE p.run_id = counts.run_id AND p.label = 'sports ball') AS excluded
FROM counts GROUP BY run_id""")
def result_tables_round_trip(spark, d):
    path = scratch_path(spark, "results")
    result = evaluated(spark, d)
    IO.write_tables(
        {"class_metrics": result.class_metrics, "excluded_predictions": result.excluded_predictions}, path
    )
    excluded = spark.read.parquet(f"{path}/excluded_predictions").groupBy("run_id").agg(F.count("*").alias("excluded"))
    sums = [F.sum(c).alias(c) for c in ("true_positive", "false_positive", "false_negative")]
    return spark.read.parquet(f"{path}/class_metrics").groupBy("run_id").agg(*sums).join(excluded, "run_id")


@query("run_manifest_documents", """
SELECT f.run_id, count(*) AS frames_processed, max(frame_number) AS last_frame_number, max(sensor_id) AS sensor_id, '2' AS max_missed FROM v_frames f GROUP BY f.run_id""")
def run_manifest_documents(spark, d):
    frames = view(spark, d, "v_frames")
    runs = frames.groupBy("run_id").agg(F.max("sensor_id").alias("sensor_id"))
    document = IO.run_manifest(M.run_counters(frames), runs, options={"max_missed_updates": "2"})
    path = scratch_path(spark, "manifest")
    IO.write_document(document, path)
    back = spark.read.schema(document.schema).json(path)
    return back.select(
        "run_id", "frames_processed", "last_frame_number", "sensor_id", F.col("options")["max_missed_updates"].alias("max_missed")
    )


@query("run_manifest_of_parts", """
SELECT run_id, count(*) AS frames_processed, max(sensor_id) AS sensor_id, 'iou' AS tracker_backend, CAST(NULL AS VARCHAR) AS alert_policy, 12.5 AS render_fps FROM v_frames GROUP BY run_id""")
def run_manifest_of_parts(spark, d):
    frames = view(spark, d, "v_frames")
    runs = frames.groupBy("run_id").agg(F.max("sensor_id").alias("sensor_id"))
    document = IO.run_manifest(M.run_counters(frames), runs, backends={"tracker_backend": "iou", "detector_backend": "given"}, render_fps=12.5)
    return document.select("run_id", "frames_processed", "sensor_id", "tracker_backend", "alert_policy", "render_fps")


@query("representation_manifest", """
SELECT run_id, true AS enabled, count(*) AS observations, count(DISTINCT track_id) AS represented_tracks, 64 AS embedding_dimension, 'float32' AS embedding_dtype FROM v_reps GROUP BY run_id
UNION ALL SELECT 'idle', true, 0, 0, NULL, 'float32'""")
def representation_manifest(spark, d):
    reps = view(spark, d, "v_reps").withColumn("embedding_dim", F.size("embedding"))
    runs = reps.select("run_id").distinct().union(spark.sql("SELECT 'idle'"))
    document = IO.representation_manifest(reps, runs, analyzer="given", configuration={"min_hits": "3"})
    return document.select("run_id", "enabled", "observations", "represented_tracks", "embedding_dimension", "embedding_dtype")


@query("fusion_manifest", FUSE_SQL + """
SELECT e.run_id, max(e.sensor_id) AS sensor_id, count(*) AS events, 'temporal_consensus' AS strategy, (SELECT count(*) FROM ev) AS input_events, (SELECT count(DISTINCT sensor_id) FROM ev) AS distinct_sensors,
       (SELECT count(*) FROM fused) AS fused_events, (SELECT count(*) FROM full_rows) AS contributors, '1800.0' AS max_time_delta_s, false AS pixels FROM v_evidence e GROUP BY e.run_id""")
def fusion_manifest(spark, d):
    evidence = view(spark, d, "v_evidence")
    document = IO.fusion_manifest(evidence, view(spark, d, "v_manifests"), fusion.fuse_events(evidence, CONFIG), CONFIG, fusion_id="f1")
    path = scratch_path(spark, "fusion-manifest")
    IO.write_document(document, path)
    back = spark.read.schema(document.schema).json(path)
    return back.select("strategy", "input_events", "distinct_sensors", "fused_events", "contributors", F.col("effective_config")["max_time_delta_s"].alias("max_time_delta_s"),
                       F.col("assumptions.raw_pixels_fused").alias("pixels"), F.inline("inputs")).select(
        "run_id", "sensor_id", "events", "strategy", "input_events", "distinct_sensors", "fused_events", "contributors", "max_time_delta_s", "pixels")


@query("manifests_read_back", """
SELECT run_id, max(sensor_id) AS sensor_id, max(modality) AS modality, 'completed' AS status, 64 AS digest_length FROM v_frames GROUP BY run_id""")
def manifests_read_back(spark, d):
    frames = view(spark, d, "v_frames")
    runs = frames.groupBy("run_id").agg(F.max("sensor_id").alias("sensor_id"), F.max("modality").alias("modality"))
    document = IO.run_manifest(M.run_counters(frames), runs.withColumn("status", F.lit("completed")), options={"max_missed_updates": "2"})
    path = scratch_path(spark, "manifests")
    IO.write_manifests(document, path)
    back = IO.read_manifests(spark, f"{path}/*/*.txt")
    return back.select("run_id", "sensor_id", "modality", "status", F.length("manifest_sha256").alias("digest_length"))


def stored_runs(spark: SparkSession, d: str) -> str:
    """Run folders of the sensor events, with a track row for every event that has a label."""
    events = view(spark, d, "v_sensor_events")
    tracks = events.filter("label IS NOT NULL").withColumns({
        "x1": (F.col("frame_number") % 50).cast("int"), "y1": (F.col("track_id") % 30).cast("int"),
        "x2": (F.col("frame_number") % 50 + 30).cast("int"), "y2": (F.col("track_id") % 30 + 20).cast("int")})
    root = scratch_path(spark, "runs")
    message = F.concat(F.lit('seen "'), "label", F.lit('", then\nleft'))
    run_folders.write_runs({"events": events.withColumn("message", message), "tracks": tracks}, view(spark, d, "v_manifests").drop("run_dir"), root, rows_per_file=1000)
    return root


@query("evidence_of_run_folders", """
SELECT run_id, sensor_id, modality, event_id, frame_number, round(timestamp_s, 6) AS timestamp_s, event_type, severity, track_id, label, round(confidence, 9) AS confidence,
       CASE WHEN label IS NOT NULL THEN frame_number % 50 END AS bx1, CASE WHEN label IS NOT NULL THEN track_id % 30 END AS by1,
       CASE WHEN label IS NOT NULL THEN track_id % 30 + 20 END AS by2 FROM v_evidence""")
def evidence_of_run_folders(spark, d):
    """What ``write_runs`` wrote, in folders and parts, read by ``read_evidence``."""
    evidence = IO.read_evidence(spark, stored_runs(spark, d))
    return evidence.select(
        "run_id", "sensor_id", "modality", "event_id", "frame_number", r6("timestamp_s").alias("timestamp_s"), "event_type", "severity", "track_id", "label",
        r6("confidence", 9).alias("confidence"), *[F.col(f"bbox.{c}").cast("long").alias(f"b{c}") for c in ("x1", "y1", "y2")])


@query("run_folders_fused", FUSE_SQL + """
SELECT event_id, round(t, 2) AS timestamp_s, event_type, label, support_count, sensor_ids, contributor_event_ids FROM fused""")
def run_folders_fused(spark, d):
    """Written, read, checked and fused as a user would chain them."""
    root = stored_runs(spark, d)
    manifests = IO.read_manifests(spark, f"{root}/*/run_manifest.json")
    fused = pipelines.fuse_runs(IO.read_evidence(spark, root), manifests, CONFIG).events
    return fused.select(
        "event_id", r6("timestamp_s", 2).alias("timestamp_s"), "event_type", "label", "support_count",
        F.array_join("sensor_ids", ",").alias("sensor_ids"), F.array_join("contributor_event_ids", ",").alias("contributor_event_ids"))


@query("run_files", """
SELECT run_id, name, count(*) AS rows, CAST(ceil(count(*) / 1000e0) AS BIGINT) AS files, true AS digests_match
FROM (SELECT run_id, 'events.csv' AS name FROM v_sensor_events UNION ALL SELECT run_id, 'tracks.csv' FROM v_sensor_events WHERE label IS NOT NULL) r GROUP BY run_id, name""")
def run_files(spark, d):
    """The files that manifests list, held against the digests of the files there are."""
    root = stored_runs(spark, d)
    listed = spark.read.text(f"{root}/*/run_manifest.json", wholetext=True).select(F.from_json(
        "value", "metadata struct<run_id:string>, files array<struct<name:string, rows:bigint, sha256:string>>").alias("m")).select("m.metadata.run_id", F.inline("m.files"))
    place = r"/([^/]+)/([^/]+\.csv(/[^/]+)?)$"
    found = spark.read.format("binaryFile").load(f"{root}/*/*.csv").select(
        F.regexp_extract("path", place, 1).alias("run_id"), F.regexp_extract("path", place, 2).alias("name"), F.sha2("content", 256).alias("found"))
    both = listed.join(found, ["run_id", "name"], "left").withColumn("name", F.substring_index("name", "/", 1))
    return both.groupBy("run_id", "name").agg(F.sum("rows").alias("rows"), F.count("*").alias("files"), F.bool_and(F.coalesce(F.col("sha256") == F.col("found"), F.lit(False))).alias("digests_match"))


# --------------------------------------------------------------------------
# Extension points.

@query("hook_detector", """
SELECT run_id, frame_number, 'blob' AS label, CAST(frame_ordinal % 50 AS INT) AS x1, CAST(frame_ordinal % 50 + 10 AS INT) AS x2 FROM v_frames""")
def hook_detector(spark, d):
    fields = T.StructType.fromDDL("run_id string, frame_number bigint, label string, x1 int, x2 int")

    def make():
        def detector(frames: pd.DataFrame) -> pd.DataFrame:
            x = (frames["frame_ordinal"] % 50).astype("int32")
            return pd.DataFrame(
                {"run_id": frames["run_id"], "frame_number": frames["frame_number"], "label": "blob", "x1": x, "x2": x + 10}
            )

        return detector

    return hooks.detect_with(view(spark, d, "v_frames"), make, fields)


@query("hook_encoder", """
SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS spaces FROM documents""")
def hook_encoder(spark, d):
    def make():
        return lambda texts: np.array([[len(t), t.count(" ")] for t in texts], dtype=np.float32)

    encoded = hooks.encode_with(view(spark, d, "documents").select("doc_id", "text"), "text", make, dim=2)
    return encoded.select(
        "doc_id", F.col("embedding")[0].cast("double").alias("chars"), F.col("embedding")[1].cast("double").alias("spaces")
    )


@query("hook_tracker", """
SELECT run_id, label, frame_ordinal, sum(count(*)) OVER (PARTITION BY run_id, label ORDER BY frame_ordinal) AS seen
FROM v_detections GROUP BY run_id, label, frame_ordinal""")
def hook_tracker(spark, d):
    fields = T.StructType.fromDDL("run_id string, label string, frame_ordinal bigint, seen bigint")

    def make():
        total = 0

        def update(frame: pd.DataFrame) -> dict[str, list]:
            nonlocal total
            total += len(frame)
            return {**{c: [frame[c].iat[0]] for c in ("run_id", "label", "frame_ordinal")}, "seen": [total]}

        return update

    detections = view(spark, d, "v_detections").select("run_id", "label", "frame_ordinal", "detection_index")
    return hooks.track_with(detections, make, fields)


class LaneTracker:
    """Follows boxes that move little; its state are the live tracks' places, oldest first."""

    def __init__(self):
        self.live: list[list] = []  # id, left edge, last frame
        self.issued = 0

    def dump(self):
        return ";".join(f"{x}:{at}" for _, x, at in self.live), [t[0] for t in self.live], self.issued

    def load(self, text, ids):
        places = [[int(v) for v in p.split(":")] for p in text.split(";")]
        self.live, self.issued = [[i, *p] for i, p in zip(ids, places, strict=True)], 0

    def update(self, frame):
        return pd.DataFrame(self.follow(frame))

    def follow(self, frame) -> dict[str, list]:
        now = int(frame["frame_ordinal"].iat[0])
        self.live = [t for t in self.live if now - t[2] <= 3]
        ids = []
        for x in frame["x1"].tolist():
            track = min((t for t in self.live if abs(t[1] - x) < 40), key=lambda t: abs(t[1] - x), default=None)
            if track is None:
                self.issued += 1
                track = [self.issued, x, now]
                self.live.append(track)
            track[1:] = [x, now]
            ids.append(track[0])
        return {**{c: frame[c].tolist() for c in ("run_id", "label", "frame_ordinal", "detection_index")}, "track_id": ids}


class LaneLists(LaneTracker):
    """The same tracker, which answers with lists."""

    update = LaneTracker.follow


@query("hook_tracker_in_chunks", TRACKS_SQL + """
SELECT run_id, label, frame_ordinal, x1, dense_rank() OVER (PARTITION BY run_id, label ORDER BY first_frame_number, track_id) AS track_id FROM tracks""")
def hook_tracker_in_chunks(spark, d):
    """Chunks of 40 frames of one key run at once and give the ids of one tracker that sees all."""
    fields = T.StructType.fromDDL("run_id string, label string, frame_ordinal bigint, detection_index bigint, track_id bigint")
    detections = view(spark, d, "v_detections").select("run_id", "label", "frame_ordinal", "detection_index", "x1")
    found = hooks.track_with(detections, LaneLists, fields, chunk_frames=40, warmup_frames=10)
    return found.join(detections, ["run_id", "label", "frame_ordinal", "detection_index"]).select("run_id", "label", "frame_ordinal", "x1", "track_id")


@query("hook_rules_and_policy", """
SELECT event_id, event_type AS alert_type, severity FROM v_sensor_events WHERE severity <> 'info' AND confidence > 0.1""")
def hook_rules_and_policy(spark, d):
    rules = [
        lambda df, s=s: df.filter(F.col("severity") == s) for s in ("critical", "warning")
    ]
    events = hooks.apply_rules(view(spark, d, "v_sensor_events").withColumn("frame_ordinal", F.col("frame_number"))
                               .withColumn("message", F.lit("")).withColumn("metadata", F.lit("{}")), *rules)
    return E.alerts_from_events(events, policy=F.col("confidence") > 0.1).select("event_id", "alert_type", "severity")


# --------------------------------------------------------------------------
# Streams.  The derived tables are stored in several files and replayed in
# several micro-batches; results equal the batch definitions.

BATCH_ROWS = 1_000_000  # of a replayed batch: a stateful task holds its keys' rows of one batch


def replay(spark: SparkSession, df: DataFrame, name: str, parts: int = 3, after: float | None = None) -> DataFrame:
    """Store ``df`` as consecutive time slices and read them back as a stream, one slice per batch.

    There are ``parts`` slices, or as many as give about ``BATCH_ROWS`` rows each, so a batch doesn't grow with ``df``.

    Slices are appended one after the other, so file age follows event time;
    a slice is eight files, which is also the batch size.  ``after`` adds an end
    mark so many seconds behind the last row.
    """
    stored = materialize(df, f"{name}-source")
    parts = max(parts, -(-stored.count() // BATCH_ROWS))
    cuts = sorted(set(stored.approxQuantile("timestamp_s", [i / parts for i in range(1, parts)], min(0.01, 0.1 / parts))))
    path = scratch_path(spark, name)
    t = F.col("timestamp_s")
    for low, high in zip([None, *cuts], [*cuts, None]):
        inside = (F.lit(True) if low is None else t > low) & (F.lit(True) if high is None else t <= high)
        stored.filter(inside).repartition(8).write.mode("append").parquet(path)
    if after is not None:
        last = stored.agg(F.max("timestamp_s")).first()[0] or 0.0
        stream_runs.end_marks(spark, stored.schema, last + after).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 8).parquet(path)


def frame_stream(spark, d) -> DataFrame:
    rows = stream_tracker.frame_rows(view(spark, d, "v_frames"), view(spark, d, "v_detections"))
    return replay(spark, rows, "frame-stream")


@query("streaming_tracks", TRACKS_SQL + """
SELECT run_id, frame_ordinal, frame_number, timestamp_s, track_id, label, confidence, hits, timestamp_s - first_timestamp_s AS duration_s, first_frame_number,
       first_timestamp_s, scenario_role, x1, y1, x2, y2 FROM tracks""")
def streaming_tracks(spark, d):
    rows = stream_runs.drain(stream_tracker.track_stream(frame_stream(spark, d)), "stream-tracks")
    return rows.filter("status = 'track'").select(
        "run_id", "frame_ordinal", "frame_number", "timestamp_s", "track_id", "label", "confidence", "hits", "duration_s", "first_frame_number",
        "first_timestamp_s", "scenario_role", "x1", "y1", "x2", "y2",
    )


@query("streaming_alerts", DWELL_SQL + ROLE_SQL + """
SELECT run_id, concat('alert:', event_id) AS alert_id, frame_number, severity, message
FROM (SELECT * FROM roles UNION ALL SELECT * FROM dwell) u WHERE severity <> 'info'""")
def streaming_alerts(spark, d):
    found = stream_tracker.track_stream(frame_stream(spark, d), min_hits=4, max_displacement_px=9)
    events = stream_tracker.track_stream_events(found, max_displacement_px=9)
    rows = stream_runs.drain(E.alerts_from_events(events), "stream-alerts")
    return rows.select("run_id", "alert_id", "frame_number", "severity", "message")


@query("streaming_anomaly_events", "WITH one AS (SELECT 1 AS one)" + STREAK_SQL + """
SELECT p.run_id, event_id, p.frame_number, severity, message, round(a.score, 6) AS score, round(a.margin, 6) AS margin, a.source AS anomaly_source
FROM persistent p JOIN v_anomalies a ON a.run_id = p.run_id AND a.track_id = p.track_id AND a.frame_ordinal = p.frame_ordinal""")
def streaming_anomaly_events(spark, d):
    scores = view(spark, d, "v_anomalies")
    stream = replay(spark, scores, "score-stream", after=5.0)
    events = stream_tracker.persistence_stream(stream, severity="critical", lateness="1 second")
    found = F.from_json("metadata", "score double, margin double, anomaly_source string")
    return stream_runs.drain(events, "stream-anomalies").withColumn("m", found).select(
        "run_id", "event_id", "frame_number", "severity", "message", r6("m.score").alias("score"), r6("m.margin").alias("margin"), "m.anomaly_source")


@query("streaming_scores", REFERENCE_SQL + """, s AS (
  SELECT run_id, track_id, frame_ordinal, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), centroid) AS score, threshold
  FROM v_reps, c, ref WHERE hits >= 3 AND least(400, x2 + 6) - greatest(0, x1 - 6) >= 12 AND least(60, y2 + 6) - greatest(0, y1 - 6) >= 12
)
SELECT run_id, track_id, frame_ordinal, round(score, 6) AS score, score > threshold AS is_anomaly FROM s""")
def streaming_scores(spark, d):
    stream = replay(spark, view(spark, d, "v_reps"), "rep-stream")
    scored = anomaly.score_anomalies(stream, reference_of(spark, d), embedder_name="given")
    return stream_runs.drain(scored, "stream-scores").select(
        "run_id", "track_id", "frame_ordinal", r6("score").alias("score"), "is_anomaly"
    )


def fused_stream(spark, d) -> DataFrame:
    """Fused groups of the evidence, replayed up to an end mark behind the last reach."""
    stream = replay(spark, view(spark, d, "v_evidence"), "evidence-stream", after=CONFIG.max_time_delta_s + 10)
    return stream_fusion.group_stream(stream, CONFIG, lateness="1 second")


@query("streaming_fusion", FUSE_SQL + """
SELECT a.event_id AS anchor_event, CAST(r.member_order AS INT) AS member_order, r.event_id, r.sensor_id, r.modality, r.run_id, r.run_dir,
       r.frame_number, r.severity, r.label, round(r.timestamp_s - fused.t, 2) AS time_delta_from_fused_s
FROM full_rows r JOIN full_rows a ON r.n = a.n AND a.member_order = 0 JOIN fused ON fused.n = r.n""")
def streaming_fusion(spark, d):
    rows = stream_fusion.contributor_rows(stream_runs.drain(fused_stream(spark, d), "stream-fusion"))
    anchor = F.regexp_extract("fusion_event_id", "^fusion:[^/]*/[^/]*/(.*):[^:]*$", 1)
    return rows.select(
        anchor.alias("anchor_event"), "member_order", "event_id", "sensor_id", "modality", "run_id", "run_dir", "frame_number", "severity", "label",
        r6("time_delta_from_fused_s", 2).alias("time_delta_from_fused_s"))


@query("streaming_fused_alerts", FUSE_SQL + """
SELECT concat('alert:fusion:', a.run_id, '/', a.sensor_id, '/', a.event_id, ':', fused.event_type) AS alert_id, fused.frame_number,
       round(fused.t, 2) AS timestamp_s, fused.event_type AS alert_type, fused.severity, fused.label
FROM fused JOIN full_rows a ON fused.n = a.n AND a.member_order = 0 WHERE fused.severity <> 'info'""")
def streaming_fused_alerts(spark, d):
    """Evidence to fused events to alerts on one stream."""
    alerts = stream_fusion.fused_alert_rows(stream_fusion.fused_event_rows(fused_stream(spark, d), CONFIG), CONFIG)
    return stream_runs.drain(alerts, "stream-fused-alerts").select(
        "alert_id", "frame_number", r6("timestamp_s", 2).alias("timestamp_s"), "alert_type", "severity", "label")


@query("streaming_evidence_tables", """
WITH s AS (SELECT run_id, count(*) AS anomaly_observations_emitted, count(CASE WHEN is_anomaly THEN 1 END) AS anomalies_flagged,
  count(CASE WHEN margin > 0.3 THEN 1 END) AS events_emitted, count(CASE WHEN margin > 0.5 THEN 1 END) AS alerts_emitted, round(sum(score), 6) AS score FROM v_anomalies GROUP BY run_id)
SELECT *, events_emitted AS stored_events FROM s""")
def streaming_evidence_tables(spark, d):
    """Three tables and the counters of one stream; its last batch is sent again, which must change nothing."""
    stream = replay(spark, view(spark, d, "v_anomalies"), "evidence-stream")

    def derive(batch: DataFrame) -> dict[str, DataFrame]:
        found = batch.filter("margin > 0.3").withColumns({
            "event_id": F.concat_ws(":", F.lit("score"), "track_id", "frame_ordinal"), "event_type": F.lit("score"), "confidence": F.col("score"), "source": F.lit("test"),
            "severity": F.when(F.col("margin") > 0.5, "warning").otherwise("info"), "message": F.lit(""), "metadata": F.lit("{}")})
        return {"anomalies": batch, "events": found, "alerts": E.alerts_from_events(found)}

    ledger = stream_ledger.EvidenceLedger(spark, scratch_path(spark, "ledger"))
    stream_ledger.evidence_sink(stream, derive, ledger, scratch_path(spark, "ledger-checkpoint")).trigger(availableNow=True).start().awaitTermination()
    last = ledger.commits().agg(F.max("batch")).first()[0]
    ledger.write(last, derive(view(spark, d, "v_anomalies")))
    scores = ledger.table("anomalies").groupBy("run_id").agg(r6(F.sum("score")).alias("score"))
    events = ledger.table("events").groupBy("run_id").agg(F.count("*").alias("stored_events"))
    names = ["anomaly_observations_emitted", "anomalies_flagged", "events_emitted", "alerts_emitted"]
    return ledger.counters().select("run_id", *names).join(scores, "run_id").join(events, "run_id")
