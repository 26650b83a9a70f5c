"""Events of run folders are parsed once, though their keys and their rows are both used."""

from sensorframe.runtime import ship
from sensorframe.sources import tables as IO
from sensorframe.sources import run_folders as RF
from tests.test_run_folders import evidence_rows, runs  # noqa: F401


def test_events_are_parsed_once(spark, tmp_path, runs):  # noqa: F811
    ship(spark)
    events, tracks, manifests = runs
    root = str(tmp_path / "runs")
    RF.write_runs({"events": events, "tracks": tracks}, manifests, root, rows_per_file=7)
    evidence = IO.read_evidence(spark, root)
    plan = evidence._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1  # the tracks
    assert evidence_rows(evidence) == evidence_rows(IO.evidence_from_runs(events, manifests, tracks))
