import random

import pytest

from sensorframe.operators import fusion, handoff
from sensorframe.operators.fusion import FusionConfig, attach_boxes, consensus_support, fuse_events
from sensorframe.schemas import EVIDENCE
from tests.plain import fuse, iou


def evidence_row(run, sensor, event_id, t, kind="dwell", label="person", severity="warning", box=None, modality="EO"):
    return (run, f"/runs/{run}", sensor, modality, event_id, int(t * 10), float(t), kind, severity, "test", 1, label,
            0.5, None if box is None else tuple(float(v) for v in box))


def groups(result):
    rows = result.contributors.collect()
    out = {}
    for r in sorted(rows, key=lambda r: (r.fusion_event_id, r.member_order)):
        out.setdefault(r.fusion_event_id, []).append(r.event_id)
    return out


def test_two_sensors_fuse(spark):
    df = spark.createDataFrame(
        [evidence_row("a", "EO", "dwell:1", 10.0), evidence_row("b", "IR", "dwell:1", 10.2, severity="critical")],
        EVIDENCE,
    )
    result = fuse_events(df, FusionConfig())
    event = result.events.collect()[0]
    assert event.event_id == "fusion:000001:dwell" and event.track_id is None and event.confidence is None
    assert event.severity == "critical" and event.label == "person"
    assert event.timestamp_s == pytest.approx(10.1)
    assert event.message == "2 sensors corroborated 'dwell' within 0.200s."
    assert result.contributors.count() == 2 and result.alerts.count() == 1


@pytest.mark.parametrize(
    "config,second,fused",
    [
        (FusionConfig(max_time_delta_s=0.25), dict(t=10.5), 0),
        (FusionConfig(), dict(t=10.1, label="vehicle"), 0),
        (FusionConfig(require_matching_label=False), dict(t=10.1, label="vehicle"), 1),
        (FusionConfig(spatial_iou_threshold=0.3), dict(t=10.1, box=(100, 100, 120, 120)), 0),
        (FusionConfig(), dict(t=10.1, box=(100, 100, 120, 120)), 1),
        (FusionConfig(spatial_iou_threshold=0.3), dict(t=10.1), 0),
    ],
)
def test_gates(spark, config, second, fused):
    df = spark.createDataFrame(
        [evidence_row("a", "EO", "e1", 10.0, box=(0, 0, 20, 20)), evidence_row("b", "IR", "e2", **second)], EVIDENCE
    )
    result = fuse_events(df, config)
    assert result.events.count() == fused
    if not config.require_matching_label:
        assert result.events.first().label is None


@pytest.mark.parametrize("seed", range(3))
def test_random_evidence_matches_serial_fuser(spark, seed, monkeypatch):
    rng = random.Random(seed)
    events, rows = [], []
    for k in range(150):
        box = rng.choice([None, (0, 0, 20, 20), (5, 0, 25, 20), (12, 0, 32, 20)])
        e = dict(t=rng.randrange(0, 240) / 8.0, sensor=rng.choice("ABCD"), id=f"e{k:03d}", type=rng.choice(["x", "y"]),
                 label=rng.choice(["p", "q", None]), box=box)
        e["run"] = "run" + e["sensor"]
        events.append(e)
        rows.append(evidence_row(e["run"], e["sensor"], e["id"], e["t"], e["type"], e["label"], box=box))
    config = FusionConfig(
        max_time_delta_s=rng.choice([0.0, 0.25, 1.0]), min_sensors=rng.choice([2, 3]),
        require_matching_label=seed % 2 == 0, spatial_iou_threshold=rng.choice([None, 0.3]),
    )
    monkeypatch.setattr(fusion, "CHUNK_ROWS", 10)  # numbering spans several slices
    want = fuse(events, config.max_time_delta_s, config.min_sensors, config.require_matching_label,
                config.spatial_iou_threshold)
    df = spark.createDataFrame(rows, EVIDENCE)
    got = groups(fuse_events(df, config, width_s=2.5))
    assert [got[k] for k in sorted(got)] == want


def test_scope_separates_fusions(spark):
    rows = [(site, *evidence_row(f"{site}{s}", s, "e", 1.0)) for site in ("n", "s") for s in ("EO", "IR")]
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("site", T.StringType()), *EVIDENCE.fields])
    result = fuse_events(spark.createDataFrame(rows, schema), scope=["site"])
    assert sorted((r.site, r.event_id) for r in result.events.collect()) == [
        ("n", "fusion:000001:dwell"), ("s", "fusion:000001:dwell")
    ]


def test_support_counts(spark):
    rng = random.Random(5)
    events = [(rng.choice("AB"), rng.randrange(0, 40) / 4.0, rng.choice(["p", None])) for _ in range(60)]
    rows = [evidence_row("r", s, f"e{k}", t, label=lab) for k, (s, t, lab) in enumerate(events)]
    got = {r.event_id: r.compatible_events for r in consensus_support(spark.createDataFrame(rows, EVIDENCE)).collect()}
    for k, (s, t, lab) in enumerate(events):
        n = sum(1 for s2, t2, l2 in events if s2 != s and abs(t - t2) <= 0.5 and l2 == lab)
        assert got[f"e{k}"] == n


def test_boxes_attach_last_duplicate(spark):
    events = spark.createDataFrame([("r", 3, 7, "e")], "run_id string, frame_number bigint, track_id bigint, event_id string")
    tracks = spark.createDataFrame(
        [("r", 3, 7, 0, 0, 0, 5, 5), ("r", 3, 7, 1, 1, 1, 6, 6)],
        "run_id string, frame_number bigint, track_id bigint, frame_ordinal bigint, x1 int, y1 int, x2 int, y2 int",
    )
    row = attach_boxes(events, tracks).first()
    assert tuple(row.bbox) == (1.0, 1.0, 6.0, 6.0)


def test_rejects_single_sensor_consensus():
    with pytest.raises(ValueError):
        FusionConfig(min_sensors=1)
    assert iou((0, 0, 1, 1), (0, 0, 1, 1)) == 1.0


@pytest.mark.parametrize("mark", ["", ";"])
def test_steady_chain_settles_in_few_rounds(spark, monkeypatch, mark):
    """Two sensors that alternate at one rate never fall back into step: the chunks' maps have to be composed."""
    rows = [evidence_row("ab"[k % 2], ("EO", "IR")[k % 2], f"e{mark}{k}", 10 + 0.4 * k) for k in range(1010)]
    rows.append(evidence_row("a", "EO", "rare", 11.0, kind="rare"))
    rounds = []
    inner = handoff.rerun
    monkeypatch.setattr(handoff, "rerun", lambda *a: rounds.append(1) or inner(*a))
    seen = spark.sparkContext.accumulator(0)

    def upstream(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, EVIDENCE)
    result = fuse_events(df.mapInArrow(upstream, EVIDENCE), FusionConfig(), width_s=4.04)
    got = groups(result)
    assert 0 < len(rounds) <= 9
    assert [v for _, v in sorted(got.items())] == [[f"e{mark}{k}", f"e{mark}{k + 1}"] for k in range(0, 1010, 2)]
    assert seen.value <= 2 * len(rows)  # once for the widths, once to be stored
