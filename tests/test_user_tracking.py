"""User trackers in chunks give what one tracker gives that sees all frames."""

import random

import pandas as pd
import pytest
from pyspark.sql import types as T

from sensorframe import hooks
from sensorframe.operators import handoff
from sensorframe.plans.catalog import LaneTracker
from sensorframe.runtime import ship

SCHEMA = "run_id string, label string, frame_ordinal bigint, detection_index bigint, x1 int"
OUT = T.StructType([T.StructField(n, T.StringType() if n in ("run_id", "label") else T.LongType()) for n in ("run_id", "label", "frame_ordinal", "detection_index", "track_id")])


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def rounds(monkeypatch):
    """How often chunks were run again."""
    seen = []
    real = handoff.rerun
    monkeypatch.setattr(handoff, "rerun", lambda *a: (seen.append(1), real(*a))[1])
    return seen


def scene(seed, frames, keys, gap=0.0):
    r = random.Random(seed)
    rows = []
    for run, label in keys:
        at = {k: 60 * k for k in range(6)}
        for f in range(frames):
            if r.random() < gap:
                continue
            lanes = [k for k in at if r.random() < 0.7]
            r.shuffle(lanes)
            for i, k in enumerate(lanes):
                at[k] += r.randint(-9, 9)
                rows.append((run, label, f, i, at[k]))
    return rows


def serial(rows, make=LaneTracker, columns=None):
    """One tracker per key over all frames."""
    out = []
    df = pd.DataFrame(rows, columns=["run_id", "label", "frame_ordinal", "detection_index", "x1"])
    for _, key in df.groupby(["run_id", "label"], dropna=False):
        tracker = make()
        for _, frame in key.sort_values(["frame_ordinal", "detection_index"]).groupby("frame_ordinal"):
            out += [tuple(v) for v in tracker.update(frame.reset_index(drop=True)).to_numpy().tolist()]
    return sorted(out, key=str)


def chunked(spark, rows, make=LaneTracker, out=OUT, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((tuple(r) for r in hooks.track_with(df, make, out, **how).collect()), key=str)


def test_equals_the_serial_tracker(spark, rounds):
    rows = scene(1, 400, [("a", "car"), ("a", None), (None, "car")])
    rows += [("gap", "car", f, 0, 5) for f in (*range(30), *range(95, 130), 1000, 1001)]
    assert chunked(spark, rows, chunk_frames=20, warmup_frames=6) == serial(rows)
    assert chunked(spark, scene(2, 300, [("a", "car")], 0.5), chunk_frames=7, warmup_frames=1) == serial(scene(2, 300, [("a", "car")], 0.5))
    assert rounds  # the warm-ups alone did not do


class Parity(LaneTracker):
    """Never falls into step by a warm-up: its state is the parity of all frames so far."""

    def __init__(self):
        self.odd = False

    def dump(self):
        return str(self.odd), [], 0

    def load(self, text, ids):
        self.odd = text == "True"

    def update(self, frame):
        self.odd = not self.odd
        return frame[["run_id", "label", "frame_ordinal"]].head(1).assign(odd=self.odd)


def test_a_hundred_chunks_settle_in_few_rounds(spark, rounds):
    rows = [("a", "car", f, 0, 1) for f in range(1000) if f % 7 != 3]
    fields = T.StructType.fromDDL("run_id string, label string, frame_ordinal bigint, odd boolean")
    assert chunked(spark, rows, Parity, fields, chunk_frames=10, warmup_frames=3) == serial(rows, Parity)
    assert len(rounds) <= 7


class Total(Parity):
    """Each state is met once, so chunks follow one another; the rows are right all the same."""

    def __init__(self):
        self.n = 0

    def dump(self):
        return str(self.n), [], 0

    def load(self, text, ids):
        self.n = int(text)

    def update(self, frame):
        self.n += len(frame)
        return frame[["run_id", "label", "frame_ordinal"]].head(1).assign(n=self.n)


def test_states_that_only_grow(spark):
    rows = [("a", "car", f, i, 1) for f in range(60) for i in range(f % 3)]
    fields = T.StructType.fromDDL("run_id string, label string, frame_ordinal bigint, n bigint")
    assert chunked(spark, rows, Total, fields, chunk_frames=15, warmup_frames=4) == serial(rows, Total)


def test_trackers_without_the_protocol_are_refused(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(TypeError, match="has no update, dump, load"):
        hooks.track_with(df, lambda: lambda frame: frame, OUT, chunk_frames=10)
    with pytest.raises(ValueError, match="lacks its keys"):
        hooks.track_with(df, LaneTracker, T.StructType.fromDDL("track_id bigint"), chunk_frames=10)
    assert hooks.track_with(df, LaneTracker, OUT, chunk_frames=10).collect() == []


@pytest.mark.parametrize("chunk_frames", [None, 8])
def test_columns_as_lists_count_as_rows(spark, chunk_frames):
    """A tracker that answers with lists gives what it gives with tables, absent values included."""
    rows = [("r", k % 2 and "a" or "b", k // 2, 0, k) for k in range(120)]
    detections = spark.createDataFrame(rows, "run_id string, label string, frame_ordinal bigint, detection_index bigint, x bigint")
    schema = T.StructType.fromDDL("run_id string, label string, frame_ordinal bigint, x bigint")

    class Plain:
        lists = False

        def update(self, frame):
            odd = [None if v % 3 else v + 2**60 for v in frame["x"].tolist()]
            got = {**{c: frame[c].tolist() for c in ("run_id", "label", "frame_ordinal")}, "x": odd}
            return got if self.lists else pd.DataFrame(got, dtype=object)

        def __call__(self, frame):
            return self.update(frame)

        def dump(self):
            return "", [], 0

        def load(self, text, ids):
            pass

    class Lists(Plain):
        lists = True

    options = {"chunk_frames": chunk_frames, "warmup_frames": 2}
    found = [sorted(map(tuple, hooks.track_with(detections, make, schema, **options).collect()), key=str) for make in (Plain, Lists)]
    assert found[0] == found[1] and len(found[0]) == 120
