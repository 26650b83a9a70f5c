"""Entry and exit states of chunks, which may name thousands of rows, don't travel with the chain of chunks."""

import os
import subprocess
import sys
from pathlib import Path

from sensorframe.operators import fusion, handoff
from sensorframe.operators.fusion import FusionConfig, fuse_events
from sensorframe.runtime import ship
from tests.plain import fuse
from tests.test_bursts import rows_of
from tests.test_fusion import groups

STEADY = [dict(t=100.0 + 0.4 * k, sensor="AB"[k % 2], id=f"event-with-a-long-name-{k:05d}" * 4, run="run", type="x", label="p", box=None) for k in range(120)]


def test_chains_hold_no_states(spark, monkeypatch):
    """Two sensors at one steady rate never fall back into step, so chunks run again."""
    ship(spark)
    stored, plans = [], []
    real, outcome = handoff.materialize, handoff._disagree

    def keep(df, name, *a, **b):
        out = real(df, name, *a, **b)
        if name.endswith("-chain"):
            stored.append(max(len(str(v)) for r in out.collect() for v in r))
        return out

    def seen(*a):
        out = outcome(*a)
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        return out

    monkeypatch.setattr(handoff, "materialize", keep)
    monkeypatch.setattr(handoff, "_disagree", seen)
    config = FusionConfig(max_time_delta_s=0.5)
    got = groups(fuse_events(rows_of(spark, STEADY), config, width_s=2.0))
    assert sorted(got.values()) == sorted(fuse(STEADY, 0.5, 2, True, None))
    assert stored and max(stored) <= 64 and plans


def test_large_states_are_not_broadcast(spark, monkeypatch):
    """Parquet files of states are small, so Spark would send them to every task by itself."""
    ship(spark)
    monkeypatch.setattr(handoff, "STATE_BYTES", 10)
    fed = []
    real = handoff.materialize
    monkeypatch.setattr(handoff, "materialize", lambda df, name, *a, **b: (fed.append(df._jdf.queryExecution().executedPlan().toString()) if "-round" in name else None, real(df, name, *a, **b))[1])
    got = groups(fuse_events(rows_of(spark, STEADY), FusionConfig(max_time_delta_s=0.5), width_s=2.0))
    assert sorted(got.values()) == sorted(fuse(STEADY, 0.5, 2, True, None))
    outer = [line for plan in fed for line in plan.split("\n") if "LeftOuter" in line]
    assert outer and all("SortMergeJoin" in line for line in outer)


def test_python_workers_leave_out_what_they_don_t_use():
    code = "import sys, sensorframe.operators.fusion; sys.exit('pyspark.ml.feature' in sys.modules)"
    root = Path(fusion.__file__).parents[2]
    assert subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": str(root)}).returncode == 0
