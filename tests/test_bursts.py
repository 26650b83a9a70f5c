"""Many events of one group within a few reaches, and the pairs among them."""

import random

import pytest
from pyspark.sql import functions as F

from sensorframe.operators import fusion
from sensorframe.operators.fusion import FusionConfig, Nearest, compatible_pairs, corroborating, fuse_events
from sensorframe.runtime import ship
from sensorframe.schemas import EVIDENCE
from tests.plain import fuse, iou
from tests.test_fusion import evidence_row, groups

BOXES = [None, (0, 0, 20, 20), (5, 0, 25, 20), (12, 0, 32, 20)]


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def burst(seed, n, seconds, labels=("p",), step=None):
    r = random.Random(seed)
    when = (lambda: r.randrange(0, int(seconds / step)) * step) if step else (lambda: r.random() * seconds)
    return [dict(t=when(), sensor=(s := r.choice("ABCDE")), id=f"e{k:04d}", run=f"run{s}", type="x", label=r.choice(labels), box=r.choice(BOXES)) for k in range(n)]


def rows_of(spark, events):
    return spark.createDataFrame([evidence_row(e["run"], e["sensor"], e["id"], e["t"], e["type"], e["label"], box=e["box"]) for e in events], EVIDENCE)


@pytest.mark.parametrize("gate", [None, 0.3])
def test_nearest_equals_the_pass_over_the_window(gate):
    r = random.Random(7)
    for trial in range(30):
        n = r.choice([5, 40, 120])
        t = sorted(r.choice([r.random() * 4, r.randrange(0, 8) / 2]) for _ in range(n))
        sensor, boxes = [r.choice(["A", "B", "C", None]) for _ in t], [r.choice(BOXES) for _ in t]
        config = FusionConfig(max_time_delta_s=r.choice([0.0, 0.3, 2.0]), spatial_iou_threshold=gate)
        consumed = [r.random() < 0.3 for _ in t]
        near = Nearest(t, sensor, boxes, consumed, config)
        for i in range(n):
            if not consumed[i]:
                assert near.of(i) == corroborating(i, range(n), t, sensor, ["p"] * n, boxes, consumed, config)
                for _, _, j in near.of(i)[: r.randrange(3)]:
                    consumed[j] = True


@pytest.mark.parametrize(("gate", "step"), [(None, None), (0.3, 0.125), (None, 0.5)])
def test_a_burst_uses_several_tasks(spark, monkeypatch, gate, step):
    monkeypatch.setattr(fusion, "CHUNK_ROWS", 100)
    events = burst(3, 1500, 8.0, step=step) + [dict(t=900.0 + k, sensor="AB"[k % 2], id=f"q{k}", run="runA", type="x", label="q", box=None) for k in range(8)]
    config = FusionConfig(max_time_delta_s=0.5, min_sensors=3, spatial_iou_threshold=gate)
    chunks = []
    real = fusion.run_chunks
    monkeypatch.setattr(fusion, "run_chunks", lambda rows, *a: (chunks.extend(rows.filter("_own").groupBy("label", "_chunk").agg(F.count("*").alias("n")).collect()), real(rows, *a))[1])
    got = groups(fuse_events(rows_of(spark, events), config))
    assert sorted(got.values()) == sorted(fuse(events, 0.5, 3, True, gate))
    assert sum(c.label == "p" for c in chunks) >= 4 and sum(c.label == "q" for c in chunks) <= 2  # each group has its own width


def test_a_dense_burst_is_not_quadratic(spark):
    """Every event lies within reach of every other."""
    events = burst(5, 20_000, 0.4)
    result = fuse_events(rows_of(spark, events), FusionConfig(max_time_delta_s=0.5, min_sensors=2))
    members = result.contributors.groupBy("fusion_event_id").agg(F.count("*").alias("n"), F.count_distinct("sensor_id").alias("s")).collect()
    assert all(m.n == m.s >= 2 for m in members) and sum(m.n for m in members) > 19_000


@pytest.mark.parametrize(("gate", "match", "cell_rows"), [(None, True, 10_000), (0.3, True, 2), (None, False, 5), (0.3, False, 3)])
def test_pairs_equal_all_pairs(spark, gate, match, cell_rows):
    events = burst(11, 150, 12.0, ("p", "q", None), 0.25)
    for e in events[:10]:
        e["sensor"] = None
    config = FusionConfig(max_time_delta_s=0.5, require_matching_label=match, spatial_iou_threshold=gate)
    want = set()
    for a in events:
        for b in events:
            key = lambda e: (e["t"], e["sensor"] or "", e["id"], e["run"])
            both = a["box"] is not None and b["box"] is not None
            value = iou(a["box"], b["box"]) if both else None
            if key(a) < key(b) and a["sensor"] != b["sensor"] and abs(a["t"] - b["t"]) <= 0.5 and (not match or a["label"] == b["label"]) and (gate is None or (both and value >= gate)):
                want.add((a["id"], b["id"], abs(a["t"] - b["t"]), value))
    got = [(r.a_event_id, r.b_event_id, r.time_gap_s, r.iou) for r in compatible_pairs(rows_of(spark, events), config, cell_rows=cell_rows).collect()]
    assert len(got) == len(set(got)) and set(got) == want
