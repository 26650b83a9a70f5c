"""A fused group stays one row with its members from the task that found it."""

import pytest

from sensorframe.operators import handoff
from sensorframe.operators.fusion import Fusion, FusionConfig, fuse_events, fusion_counters
from sensorframe.runtime import ship
from sensorframe.schemas import EVIDENCE
from tests.plain import fuse
from tests.test_bursts import burst, rows_of
from tests.test_fusion import evidence_row, groups


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_rounds_write_no_second_copy_of_the_result(spark, monkeypatch):
    written, real = [], handoff.materialize
    monkeypatch.setattr(handoff, "materialize", lambda df, name, *a, **k: (written.append(name), real(df, name, *a, **k))[1])
    events = burst(5, 300, 40.0, step=0.25)
    result = fuse_events(rows_of(spark, events), FusionConfig(max_time_delta_s=0.5), width_s=2.0)
    assert "fusion-round1" in written and "fusion-settled" not in written
    assert sorted(groups(result).values()) == sorted(fuse(events, 0.5, 2, True, None))


def test_anchors_of_one_name_are_two_groups(spark):
    rows = [evidence_row(f"run{s}", s, "same", t, "x", "p") for t in (1.0, 100.0) for s in "AB"]
    result = fuse_events(spark.createDataFrame(rows, EVIDENCE), FusionConfig(max_time_delta_s=0.5))
    assert [(r.event_id, r.support_count) for r in result.events.orderBy("event_id").collect()] == [("fusion:000001:x", 2), ("fusion:000002:x", 2)]
    assert result.contributors.filter("fusion_event_id = 'fusion:000002:x' AND timestamp_s = 100").count() == 2


def _exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_chunks_of_evidence_are_run_without_a_shuffle(spark, monkeypatch):
    found, real = [], handoff.materialize
    monkeypatch.setattr(handoff, "materialize", lambda df, name, *a, **k: (found.extend(_exchanges(df) if name == "fusion" else []), real(df, name, *a, **k))[1])
    events = burst(3, 60, 40.0)
    result = fuse_events(rows_of(spark, events), FusionConfig(max_time_delta_s=0.5))
    assert not found
    assert sorted(groups(result).values()) == sorted(fuse(events, 0.5, 2, True, None))


def test_counts_need_no_numbers(spark):
    events = burst(3, 60, 40.0)
    evidence = rows_of(spark, events)
    result = fuse_events(evidence, FusionConfig(max_time_delta_s=0.5))
    counted = fusion_counters(evidence, result)
    assert not [line for line in _exchanges(counted) if "_bucket" in line]
    assert counted.first().asDict() == fusion_counters(evidence, Fusion(result.events, result.alerts, result.contributors)).first().asDict()
