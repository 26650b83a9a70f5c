import json
import random

import pytest
from pyspark.sql import functions as F

from sensorframe.operators import events as E
from sensorframe.schemas import ANOMALIES, TRACKS, conform

TRACK = "run_id string, track_id bigint, frame_ordinal bigint, hits bigint, label string, confidence double, scenario_role string, x1 int, y1 int, x2 int, y2 int"


def tracks(spark, rows):
    df = spark.createDataFrame(rows, TRACK)
    return conform(
        df.withColumn("frame_number", F.col("frame_ordinal")).withColumn("timestamp_s", F.col("frame_ordinal") / 10.0)
        .withColumn("duration_s", F.col("frame_ordinal") / 10.0), TRACKS)


def path(track_id, xs, label="person", role=None):
    return [("r", track_id, k, k + 1, label, 0.9, role, x, 10, x + 20, 30) for k, x in enumerate(xs)]


def test_role_once_per_track_and_role(spark):
    rows = path(1, [10, 12], role="normal_maintenance") + path(2, [10], role="dismount_loiter") + path(3, [5], role="")
    events = E.role_events(tracks(spark, rows)).collect()
    assert {(e.event_id, e.severity) for e in events} == {
        ("scenario:1:normal_maintenance", "info"), ("scenario:2:dismount_loiter", "warning")}
    alerts = E.alerts_from_events(E.role_events(tracks(spark, rows))).collect()
    assert [(a.alert_id, a.source, json.loads(a.metadata)) for a in alerts] == [
        ("alert:scenario:2:dismount_loiter", "severity", {"event_source": "scenario_role"})]


def test_dwell_fires_once_or_not(spark):
    rows = path(1, [10, 11, 12, 12]) + path(2, [10, 20, 30]) + path(3, [10, 11, 12], label="car")
    events = E.dwell_events(tracks(spark, rows), min_hits=3, max_displacement_px=5, labels={"person"}).collect()
    assert [(e.event_id, e.frame_ordinal) for e in events] == [("dwell:1", 2)]
    assert events[0].message == "Track 1 persisted for 3 observations within 5.0px of its origin."
    assert json.loads(events[0].metadata)["max_displacement_px"] == 2.0
    with pytest.raises(ValueError):
        E.dwell_events(tracks(spark, rows), min_hits=1)


def anomalies(spark, rows):
    df = spark.createDataFrame(rows, "run_id string, track_id bigint, frame_ordinal bigint, is_anomaly boolean")
    return conform(df.withColumn("frame_number", F.col("frame_ordinal") * 3).withColumn("score", F.lit(0.5)), ANOMALIES)


@pytest.mark.parametrize("need,span", [(1, 4), (2, 4), (3, 3), (4, 4096)])
def test_persistence_matches_step_by_step(spark, need, span):
    rng = random.Random(need)
    rows, want = [], {}
    for track in range(20):
        count = 0
        for ordinal in range(30):
            if rng.random() < 0.15:
                count = 0
                continue
            odd = rng.random() < 0.6
            rows.append(("r", track, ordinal, odd))
            count = count + 1 if odd else 0
            if count >= need:
                want.setdefault(track, ordinal)
    got = E.persistent_anomaly_events(anomalies(spark, rows), min_consecutive=need, span=span).collect()
    assert {e.track_id: e.frame_ordinal for e in got} == want
    assert all(json.loads(e.metadata)["consecutive_observations"] == need for e in got)


def test_overlay_caption(spark):
    t = tracks(spark, path(7, [10]))
    alerts = spark.createDataFrame([("r", 0, 7)], "run_id string, frame_ordinal bigint, track_id bigint")
    row = E.annotation_overlay(t, alerts, anomalies(spark, [("r", 7, 0, True)])).first()
    assert (row.caption, row.thickness) == ("#7 person 0.90 ALERT ANOM", 3)
    plain = E.annotation_overlay(t, alerts.limit(0), anomalies(spark, [("r", 7, 0, False)])).first()
    assert (plain.caption, plain.thickness) == ("#7 person 0.90", 2)


def test_policy_minimum(spark):
    events = E.role_events(tracks(spark, path(2, [10], role="x")))
    assert E.alerts_from_events(events, minimum_severity="critical").count() == 0
    assert E.alerts_from_events(events, minimum_severity="info").count() == 1
    with pytest.raises(ValueError):
        E.alerts_from_events(events, minimum_severity="fatal")
