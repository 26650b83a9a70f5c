import random
import tracemalloc

import pytest

from sensorframe.operators import tracking
from sensorframe.operators.tracking import observation_history, track_detections
from tests.plain import iou, track

SCHEMA = (
    "run_id string, frame_ordinal bigint, frame_number bigint, timestamp_s double, detection_index bigint, "
    "label string, confidence double, scenario_role string, x1 int, y1 int, x2 int, y2 int"
)


def rows_of(run, frames, role=None):
    return [
        (run, f, f * 2, f / 10.0, j, label, 0.9, role, *box)
        for f, dets in enumerate(frames)
        for j, (label, box) in enumerate(dets)
    ]


def tracked(spark, runs, **kw):
    data = [r for run, frames in runs.items() for r in rows_of(run, frames)]
    out = track_detections(spark.createDataFrame(data, SCHEMA), **kw).collect()
    ids = {(r.run_id, r.label, r.frame_ordinal, tuple((r.x1, r.y1, r.x2, r.y2)), r.track_id, r.hits) for r in out}
    return out, ids


def expected(runs, threshold, missed):
    return {
        (run, frames[f][j][0], f, frames[f][j][1], tid, hits)
        for run, frames in runs.items()
        for (f, j), (tid, hits) in track(frames, threshold, missed).items()
    }


def b(x, y=10, w=20):
    return (x, y, x + w, y + w)


def test_motion_class_and_expiry(spark):
    runs = {
        "motion": [[("person", b(10))], [("person", b(12))]],
        "class": [[("person", b(10))], [("car", b(10))]],
        "expiry": [[("person", b(10))], [], [], [("person", b(10))]],
    }
    out, ids = tracked(spark, runs, max_missed_updates=1)
    assert ids == expected(runs, 0.3, 1)
    motion = sorted((r for r in out if r.run_id == "motion"), key=lambda r: r.frame_ordinal)
    assert [(r.track_id, r.hits, r.first_frame_number) for r in motion] == [(1, 1, 0), (1, 2, 0)]
    assert motion[1].duration_s == pytest.approx(0.1)
    assert {r.track_id for r in out if r.run_id == "expiry" and r.frame_ordinal == 3} == {2}


@pytest.mark.parametrize("seed", range(3))
def test_random_scenes_match_serial_tracker(spark, seed):
    """Dense, tie-rich scenes cut into tiny chunks equal the serial scan."""
    rng = random.Random(seed)
    runs = {}
    for run in range(12):
        frames = []
        for _ in range(rng.choice([5, 30, 60])):
            n = rng.choice([0, 1, 2, 4])
            frames.append(
                [
                    (rng.choice(["person", "car"]), b(rng.randrange(0, 40, rng.choice([1, 5])), rng.choice([0, 5])))
                    for _ in range(n)
                ]
            )
        runs[f"r{run}"] = frames
    threshold, missed = rng.choice([(0.3, 2), (0.0, 1), (0.5, 0), (0.1, 3)])
    _, ids = tracked(
        spark, runs, iou_threshold=threshold, max_missed_updates=missed, chunk_frames=2, warmup_frames=1
    )
    assert ids == expected(runs, threshold, missed)


def test_age_decides_ties_across_chunks(spark):
    """Two standing twins: which one takes the single detection depends on birth order."""
    frames = [[("car", b(0)), ("car", b(10))]]
    for k in range(30):
        pair = [("car", b(10)), ("car", b(0))] if k % 2 else [("car", b(0)), ("car", b(10))]
        frames.append([("car", b(5))] if k % 7 == 6 else pair)
    runs = {"twins": frames}
    _, ids = tracked(spark, runs, chunk_frames=2, warmup_frames=1, max_missed_updates=2)
    assert ids == expected(runs, 0.3, 2)


def test_history_of_foreign_tracks(spark):
    runs = {"a": [[("person", b(10 + k))] for k in range(5)]}
    out = track_detections(spark.createDataFrame(rows_of("a", runs["a"]), SCHEMA))
    again = observation_history(out).orderBy("frame_ordinal").collect()
    assert [r.hits for r in again] == [1, 2, 3, 4, 5]
    assert {r.first_frame_number for r in again} == {0}


def test_rejects_bad_options(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError):
        track_detections(df, iou_threshold=1.5)
    with pytest.raises(ValueError):
        track_detections(df, max_missed_updates=-1)


@pytest.mark.parametrize("threshold", [0.0, 0.05, 0.3])
def test_association_equals_all_pairs(threshold, monkeypatch):
    """Pairs found by sorted edges, in blocks, against the plain statement; many ties, some inherited."""
    monkeypatch.setattr(tracking, "PAIRS", 37)
    rng = random.Random(int(threshold * 100))
    for _ in range(60):
        def box():
            x, y = rng.randrange(0, 60, 4), rng.randrange(0, 24, 4)
            return (x, y, x + rng.choice([0, 4, 8, 50]), y + rng.choice([0, 4, 8]))  # noqa: B023

        tracks = [tracking._Track(box(), (0, k), None, 0, rng.random() < 0.4) for k in range(rng.randrange(0, 30))]
        boxes = [box() for _ in range(rng.randrange(0, 30))]
        if not tracks or not boxes:
            continue
        pairs = sorted((-iou(t.box, x), i, j) for i, t in enumerate(tracks) for j, x in enumerate(boxes) if iou(t.box, x) >= threshold)
        match, taken, seen, tie = {}, set(), set(), False
        for value, i, j in pairs:
            if i not in taken and j not in match:
                taken.add(i)
                match[j] = i
            if tracks[i].inherited:
                tie = tie or (value, j) in seen
                seen.add((value, j))
        assert tracking.associate(tracks, boxes, threshold) == (match, tie)


def test_crowded_frame_in_bounded_memory():
    n = 20_000
    tracks = [tracking._Track((30 * (k % 200), 30 * (k // 200), 30 * (k % 200) + 20, 30 * (k // 200) + 20), (0, k), None, 0, False) for k in range(n)]
    boxes = [(x1 + 2, y1, x2 + 2, y2) for x1, y1, x2, y2 in (t.box for t in tracks)]
    tracemalloc.start()
    match, tie = tracking.associate(tracks, boxes, 0.3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert match == {k: k for k in range(n)} and not tie and peak < 300e6
