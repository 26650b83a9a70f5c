import random

import pytest
from pyspark.sql import functions as F

from sensorframe.operators.representations import representation_changes, sample_tracks
from sensorframe.streaming import representations as stream_reps
from tests.test_streaming import drained, same, with_marks

SCHEMA = ("run_id string, frame_ordinal bigint, frame_number bigint, timestamp_s double, track_id bigint, label string, confidence double, "
          "hits bigint, sensor_id string, modality string, source_path string, x1 int, y1 int, x2 int, y2 int, width int, height int")  # fmt: skip


def crowd(seed, run, frames=24, tracks=7):
    """Tracks with gaps, ties of confidence and, now and then, boxes too small for a crop."""
    r = random.Random(seed)
    rows, hits = [], dict.fromkeys(range(1, tracks + 1), 0)
    for f in range(frames):
        for t in hits:
            if r.random() < 0.8:
                hits[t] += 1
                x, side = r.randrange(0, 80), r.choice([2, 40, 40, 40])
                rows.append((run, f, f * 2, f / 4.0, t, r.choice(["person", "car"]), r.choice([0.5, 0.9, None]), hits[t], "S", "EO", "/in", x, 5, x + side, 5 + side, 320, 200))
    return rows


def encode(rows):
    """A stateless stand-in for an encoder: the vector follows from the row."""
    a = F.col("x1") + 1.0
    return rows.withColumn("embedding", F.array(a, F.col("frame_ordinal") + 0.5, F.sin(a)).cast("array<double>"))


OPTIONS = dict(min_track_hits=2, sample_every_n_hits=2, max_per_frame=2, pad_px=1)


def test_streamed_changes_equal_batch_and_leave_no_state(spark, tmp_path):
    df = spark.createDataFrame(crowd(1, "a") + crowd(2, "b"), SCHEMA)
    want = representation_changes(encode(sample_tracks(df, **OPTIONS)), bucket=4)
    slices = ["frame_ordinal < 9 AND frame_ordinal <> 7", "frame_ordinal = 7 OR frame_ordinal BETWEEN 9 AND 15", "frame_ordinal > 15"]
    stream = with_marks(spark, df, str(tmp_path / "in"), slices, [(8.0, ["a", "b"]), (100.0, [None]), (200.0, [None])])
    rows, state = drained(stream_reps.change_stream(stream, encode, lateness="1 second", idle_s=30, **OPTIONS), "reps")
    got = rows.cache()
    assert got.columns == want.columns
    same(got, want, want.columns)
    per_frame = want.groupBy("run_id", "frame_ordinal").count().agg(F.max("count")).first()[0]
    assert per_frame == 2 and want.filter("representation_change > 0").count() > 10
    left = {}
    for operator, variable in enumerate(("frame", "next_row", "previous")):
        left[variable] = spark.read.format("statestore").option("stateVarName", variable).option("operatorId", 2 - operator).load(state).count()
    assert not any(left.values()), left


def test_idle_tracks_start_anew(spark, tmp_path):
    rows = [("r", f, f, t, 1, "person", 0.9, h, "S", "EO", "/in", 10 + f, 5, 160, 60, 320, 200) for h, (f, t) in enumerate([(0, 0.0), (1, 1.0), (90, 90.0), (91, 91.0)], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    stream = with_marks(spark, df, str(tmp_path / "in"), ["frame_ordinal < 2", "frame_ordinal >= 2"], [(300.0, [None])])
    out, _ = drained(stream_reps.change_stream(stream, encode, lateness="1 second", idle_s=30, min_track_hits=1, sample_every_n_hits=1), "idle")
    got = [(r.embedding_row, r.representation_change is not None) for r in out.orderBy("embedding_row").collect()]
    assert [n for n, _ in got] == [0, 1, 2, 3] and [c for _, c in got] == [False, True, False, True]


def test_late_frames_are_left_out(spark, tmp_path):
    df = spark.createDataFrame(crowd(5, "a"), SCHEMA)
    stream = with_marks(spark, df, str(tmp_path / "in"), ["frame_ordinal > 12", "frame_ordinal > 22", "frame_ordinal <= 3"], [(100.0, [None])])
    out, _ = drained(stream_reps.sample_stream(stream, lateness="0 seconds", **OPTIONS).drop("event_time"), "late")
    ordinals = {r.frame_ordinal for r in out.select("frame_ordinal").collect()}
    assert ordinals and min(ordinals) > 3


def test_options_are_checked(spark):
    df = spark.createDataFrame(crowd(1, "a"), SCHEMA)
    for bad in ({"max_per_frame": 0}, {"pad_px": -1}, {"min_track_hits": 0}):
        with pytest.raises(ValueError):
            stream_reps.sample_stream(df, **bad)
