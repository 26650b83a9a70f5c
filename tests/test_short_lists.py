"""What is settled or numbered stays where it lies: short lists go to the rows, not rows to the lists."""

import random

import pytest

from sensorframe.operators import fusion, handoff
from sensorframe.operators.fusion import FusionConfig, Nearest, corroborating, fuse_events, fusion_counters
from sensorframe.runtime import ship
from tests.plain import fuse
from tests.test_bursts import burst, rows_of
from tests.test_fused_groups import _exchanges
from tests.test_fusion import groups


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture
def no_guess(spark):
    """Spark itself finds no table small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_contributors_are_numbered_without_a_shuffle_of_lists(spark, monkeypatch, no_guess):
    monkeypatch.setattr(fusion, "CHUNK_ROWS", 40)
    events = burst(5, 300, 40.0, step=0.25)
    result = fuse_events(rows_of(spark, events), FusionConfig(max_time_delta_s=0.5), width_s=2.0)
    assert not _exchanges(result.contributors)
    assert sorted(groups(result).values()) == sorted(fuse(events, 0.5, 2, True, None))


def test_counting_after_rounds_moves_no_list(spark, monkeypatch, no_guess):
    written, real = [], handoff.materialize
    monkeypatch.setattr(handoff, "materialize", lambda df, name, *a, **k: (written.append((name, _exchanges(df))), real(df, name, *a, **k))[1])
    events = burst(5, 300, 40.0, step=0.25)
    evidence = rows_of(spark, events)
    result = fuse_events(evidence, FusionConfig(max_time_delta_s=0.5), width_s=2.0)
    rounds = [moved for name, moved in written if name.startswith("fusion-round")]
    assert rounds and not any(rounds)
    assert not [line for line in _exchanges(fusion_counters(evidence, result)) if "_chunk" in line]


@pytest.mark.parametrize("most", [handoff.__dict__.get("STATE_BYTES", 0), 0])
def test_one_row_of_a_chunk_carries_its_entry_state(spark, monkeypatch, tmp_path, most):
    monkeypatch.setattr(handoff, "STATE_BYTES", most, raising=False)
    fed, real = [], type(spark.range(1)).mapInArrow
    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", lambda df, *a, **k: (fed.append(df), real(df, *a, **k))[1])
    events = burst(5, 300, 40.0, step=0.25)
    result = fuse_events(rows_of(spark, events), FusionConfig(max_time_delta_s=0.5), width_s=2.0)
    again = [df for df in fed if "_init" in df.columns][1:]
    assert again
    for df in again:
        carried = df.groupBy("event_type", "label", "_chunk").agg({"_init": "count", "_place": "max"}).collect()
        assert carried and all(r["count(_init)"] == 1 for r in carried)
    assert sorted(groups(result).values()) == sorted(fuse(events, 0.5, 2, True, None))


def test_nearest_without_boxes_equals_the_pass_over_the_window():
    r = random.Random(11)
    for _ in range(60):
        t = sorted(r.choice([r.random() * 4, r.randrange(0, 6) / 2]) for _ in range(r.choice([5, 40, 120])))
        sensor, boxes = [r.choice(["A", "B", None]) for _ in t], [None] * len(t)
        config = FusionConfig(max_time_delta_s=r.choice([0.0, 0.5, 2.0]))
        consumed = [r.random() < 0.3 for _ in t]
        near = Nearest(t, sensor, boxes, consumed, config)
        for i in range(len(t)):
            if not consumed[i]:
                assert near.of(i) == corroborating(i, range(len(t)), t, sensor, ["p"] * len(t), boxes, consumed, config)
                for _, _, j in near.of(i)[: r.randrange(3)]:
                    consumed[j] = True


def test_only_events_near_a_boundary_are_named(spark, monkeypatch, tmp_path):
    named = []
    real = fusion._Rows.names
    monkeypatch.setattr(fusion._Rows, "names", lambda self, places: (named.append(places := list(places)), real(self, places))[1])
    t = [k / 10 for k in range(400)]
    rows = fusion._Rows(_table(t))
    chunk = fusion._Chunk(rows, 0, 400, 0, 40.0, 2.0, None, FusionConfig(max_time_delta_s=0.5), 0.6)
    assert len(chunk.run()[0]) == 200
    assert sum(map(len, named)) < 20


def _table(t):
    import pyarrow as pa

    n = len(t)
    sensor = ["AB"[k % 2] for k in range(n)]
    return pa.table({"run_id": sensor, "sensor_id": sensor, "event_id": [str(k) for k in range(n)], "timestamp_s": t,
                     "label": ["p"] * n, "_own": [True] * n, "bbox": pa.nulls(n, pa.struct([("x1", pa.float64())]))})
