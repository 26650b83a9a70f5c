import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorframe.operators import events as batch_events
from sensorframe.operators.fusion import FusionConfig, consensus_support, fuse_events
from sensorframe.operators.tracking import track_detections
from sensorframe.runtime import scratch_path
from sensorframe.schemas import EVIDENCE
from sensorframe.streaming import fusion as stream_fusion
from sensorframe.streaming import runs
from sensorframe.streaming import tracker as stream_tracker
from tests.plain import fuse, track
from tests.test_fusion import evidence_row
from tests.test_tracking import SCHEMA, b, rows_of


def as_stream(spark, df, path, slices):
    """Append slices of ``df`` (lists of predicates) one after the other and read them one per batch."""
    for part in slices:
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def scene(seed, frames):
    rng = random.Random(seed)
    return [
        [(rng.choice(["person", "car"]), b(rng.randrange(0, 60, 3))) for _ in range(rng.choice([0, 1, 3]))]
        for _ in range(frames)
    ]


def test_streamed_tracks_equal_serial_and_report_late_frames(spark, tmp_path):
    runs_of = {"a": scene(1, 30), "b": scene(2, 30)}
    detections = spark.createDataFrame([r for k, v in runs_of.items() for r in rows_of(k, v)], SCHEMA)
    frames = spark.createDataFrame(
        [(k, f, f * 2, f / 10.0) for k, v in runs_of.items() for f in range(len(v))],
        "run_id string, frame_ordinal bigint, frame_number bigint, timestamp_s double",
    )
    rows = stream_tracker.frame_rows(frames, detections)
    # frame 12 arrives a batch late but inside the lateness; frame 3 is sent twice
    early, late = "frame_ordinal < 15 AND frame_ordinal <> 12", "frame_ordinal = 12 OR frame_ordinal BETWEEN 15 AND 20"
    stream = as_stream(spark, rows, str(tmp_path / "in"), [early, late, "frame_ordinal > 20 OR frame_ordinal = 13"])
    out = runs.drain(stream_tracker.track_stream(stream, lateness="5 seconds"), "t").collect()
    got = {(r.run_id, r.frame_ordinal, r.label, (r.x1, r.y1, r.x2, r.y2), r.track_id, r.hits)
           for r in out if r.status == "track"}
    want = {
        (run, f, v[f][j][0], v[f][j][1], tid, hits)
        for run, v in runs_of.items()
        for (f, j), (tid, hits) in track(v, 0.3, 2).items()
    }
    assert got == want
    assert {(r.run_id, r.frame_ordinal) for r in out if r.status == "late"} == {("a", 13), ("b", 13)}


def test_streamed_fusion_equals_serial_behind_the_watermark(spark, tmp_path):
    rng = random.Random(9)
    events, rows = [], []
    for k in range(80):
        e = dict(t=k / 4.0, sensor=rng.choice("ABC"), id=f"e{k:03d}", type=rng.choice(["x", "y"]),
                 label=rng.choice(["p", None]), box=None)
        e["run"] = "run" + e["sensor"]
        events.append(e)
        rows.append(evidence_row(e["run"], e["sensor"], e["id"], e["t"], e["type"], e["label"]))
    df = spark.createDataFrame(rows, EVIDENCE)
    stream = as_stream(spark, df, str(tmp_path / "in"),
                       ["timestamp_s < 6", "timestamp_s BETWEEN 6 AND 12", "timestamp_s > 12"])
    config = FusionConfig(max_time_delta_s=1.0)
    out = runs.drain(stream_fusion.fusion_stream(stream, config, lateness="0 seconds"), "f").collect()
    groups = {}
    for r in sorted(out, key=lambda r: (r.anchor_event, r.member_order)):
        groups.setdefault(r.anchor_event, []).append(r.event_id)
    last = max(e["t"] for e in events)
    when = {e["id"]: e["t"] for e in events}
    want = {g[0]: g for g in fuse(events, 1.0, 2, True, None) if when[g[0]] + 1.0 < last}
    assert groups == want


def test_streamed_streaks(spark, tmp_path):
    rows = [("r", 1, k, k, k / 10.0, "person", k in (2, 3, 5, 6, 7, 8)) for k in range(20)]
    df = spark.createDataFrame(rows, "run_id string, track_id bigint, frame_ordinal bigint, frame_number bigint, timestamp_s double, label string, is_anomaly boolean")
    stream = as_stream(spark, df, str(tmp_path / "in"), ["frame_ordinal < 7", "frame_ordinal >= 7"])
    out = runs.drain(stream_tracker.persistence_stream(stream, lateness="0 seconds"), "s").collect()
    assert [(e.event_id, e.frame_number) for e in out] == [("visual_anomaly:1", 7)]


def test_stream_events_are_stateless_projection(spark):
    row = {n: None for n in stream_tracker.TRACK_ROWS.names}
    row.update(run_id="r", status="track", track_id=1, hits=3, scenario_role="x", new_role=True, dwelt=True,
               timestamp_s=1.0, first_timestamp_s=0.5, max_displacement_px=2.0)
    df = spark.createDataFrame([tuple(row.values())], stream_tracker.TRACK_ROWS)
    events = stream_tracker.track_stream_events(df, max_displacement_px=5).select("event_id").collect()
    assert sorted(e[0] for e in events) == ["dwell:1", "scenario:1:x"]


def drained(stream, name):
    """The sink's rows and the folder of the query's state."""
    runs.use_rocksdb(stream.sparkSession)
    path, state = scratch_path(stream.sparkSession, name), scratch_path(stream.sparkSession, f"{name}-state")
    runs.write_evidence_stream(stream, path, state).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path), state


def held(spark, state, variable):
    return spark.read.format("statestore").option("stateVarName", variable).load(state).count()


def with_marks(spark, df, path, slices, marks):
    """Slices of ``df`` and then end marks (seconds, runs), one batch each."""
    as_stream(spark, df, path, slices)
    for seconds, ended in marks:
        runs.end_marks(spark, df.schema, seconds, ended).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b, columns):
    """Equal rows in any order, every column given."""
    rows = [sorted(map(repr, df.select(*columns).collect())) for df in (a, b)]
    assert rows[0] == rows[1] and rows[0]


def test_streamed_tracks_equal_batch_on_all_columns_and_leave_no_state(spark, tmp_path):
    known = {"a": scene(4, 25), "b": scene(5, 25)}
    detections = spark.createDataFrame([r for k, v in known.items() for r in rows_of(k, v)], SCHEMA).withColumn(
        "sensor_id", F.concat(F.lit("CAM_"), "run_id")).withColumn("modality", F.lit("IR")).withColumn(
        "source_path", F.lit("/in")).withColumn("object_id", F.when(F.col("detection_index") == 1, F.lit(7)).cast("long"))
    frames = spark.createDataFrame(
        [(k, f, f * 2, f / 10.0) for k, v in known.items() for f in range(len(v))],
        "run_id string, frame_ordinal bigint, frame_number bigint, timestamp_s double")
    rows = stream_tracker.frame_rows(frames, detections)
    stream = with_marks(spark, rows, str(tmp_path / "in"), ["frame_ordinal < 9", "frame_ordinal >= 9"], [(10.0, ["a", "b"]), (30.0, [None])])
    out, state = drained(stream_tracker.track_stream(stream, lateness="2 seconds"), "ends")
    batch = track_detections(detections)
    same(out.filter("status = 'track'"), batch, [c for c in batch.columns if c in out.columns])
    assert {"duration_s", "sensor_id", "modality", "source_path", "detection_object_id"} <= set(batch.columns) & set(out.columns)
    assert held(spark, state, "run") == 0 and held(spark, state, "waiting") == 0


def test_streamed_fusion_equals_batch_on_all_columns_and_leaves_no_state(spark, tmp_path):
    rng = random.Random(12)
    rows = []
    for k in range(120):
        sensor, x = rng.choice("ABC"), rng.randrange(0, 30)
        box = rng.choice([None, (x, 0, x + 40, 20)])
        rows.append((*evidence_row("run;" + sensor, sensor, f"e/{k:03d}", k / 4.0 + rng.choice([0, 0.05]), rng.choice(["x", "y"]),
                                   rng.choice(["p", None]), rng.choice(["info", "warning", "critical"]), box), rng.choice(["north", None])))
    df = spark.createDataFrame(rows, T.StructType([*EVIDENCE.fields, T.StructField("site", T.StringType())]))
    for gate in (None, 0.3):
        config = FusionConfig(max_time_delta_s=1.0, spatial_iou_threshold=gate)
        stream = with_marks(spark, df, str(tmp_path / f"in{gate}"), ["timestamp_s < 9", "timestamp_s BETWEEN 9 AND 20", "timestamp_s > 20"], [(60.0, [None])])
        groups, state = drained(stream_fusion.group_stream(stream, config, lateness="1 second", scope=["site"]), "g")
        events = stream_fusion.fused_event_rows(groups, config, scope=["site"])
        batch = fuse_events(df, config, scope=["site"])
        # only the names differ: a stream has no number to give
        same(events, batch.events, [c for c in batch.events.columns if c != "event_id"])
        assert events.columns == batch.events.columns
        members = stream_fusion.contributor_rows(groups, scope=["site"])
        same(members, batch.contributors, [c for c in batch.contributors.columns if c != "fusion_event_id"])
        assert members.columns == batch.contributors.columns
        assert events.select("event_id").distinct().count() == batch.events.count()
        same(stream_fusion.fused_alert_rows(events, config), batch.alerts, [c for c in batch.alerts.columns if c not in ("event_id", "alert_id")])
        assert held(spark, state, "events") == 0


def test_streamed_persistence_equals_batch_and_forgets_idle_tracks(spark, tmp_path):
    rng = random.Random(3)
    rows = [("r", tid, k, k * 2, k / 10.0, "person", (s := rng.random()), 0.4, s - 0.4, s > 0.4, "given") for tid in (1, 2, 3) for k in range(30)]
    df = spark.createDataFrame(rows, "run_id string, track_id bigint, frame_ordinal bigint, frame_number bigint, timestamp_s double, "
                                     "label string, score double, threshold double, margin double, is_anomaly boolean, source string")
    stream = with_marks(spark, df, str(tmp_path / "in"), ["frame_ordinal < 11", "frame_ordinal >= 11"], [(20.0, [None])])
    out, state = drained(stream_tracker.persistence_stream(stream, lateness="1 second", idle_s=5), "p")
    batch = batch_events.persistent_anomaly_events(df)
    same(out, batch, batch.columns)
    assert held(spark, state, "streak") == 0


def test_support_with_a_spatial_gate_equals_counting_pairs(spark):
    rng = random.Random(8)
    rows = []
    for k in range(150):
        x = rng.randrange(0, 40)
        sensor = rng.choice("ABC")
        rows.append(evidence_row("r" + sensor, sensor, f"e{k}", rng.randrange(0, 200) / 10, "x", rng.choice(["p", None]), box=rng.choice([None, (x, 0, x + 30, 20)])))
    gated = FusionConfig(max_time_delta_s=1.0, spatial_iou_threshold=0.4)

    def iou(a, b):
        w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
        return w * 20 / (1200 - w * 20)

    want = {
        a[4]: sum(c[2] != a[2] and c[11] == a[11] and abs(a[6] - c[6]) <= 1.0 and a[13] is not None and c[13] is not None and iou(a[13], c[13]) >= 0.4 for c in rows)
        for a in rows
    }
    got = consensus_support(spark.createDataFrame(rows, EVIDENCE), gated).collect()
    assert {r.event_id: r.compatible_events for r in got} == want and sum(want.values())
