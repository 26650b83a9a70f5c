"""Run folders are read back as they were written, and only whole ones are seen."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from sensorframe.operators.contracts import ContractError
from sensorframe.runtime import ship
from sensorframe.sources import run_folders as RF
from sensorframe.sources import tables as IO

EVENT = "run_id string, event_id string, frame_number bigint, timestamp_s double, event_type string, severity string, track_id bigint, label string, confidence double, source string, message string"
TRACK = "run_id string, frame_ordinal bigint, frame_number bigint, track_id bigint, label string, x1 int, y1 int, x2 int, y2 int"
RUN = "run_id string, sensor_id string, modality string, status string, note string"


@pytest.fixture
def runs(spark):
    ship(spark)
    odd = ['plain', 'a "quoted", text\nof two lines', "", None, " spaced ", "back\\slash", "é\U0001f600", '"', "\\N"]
    events = [(f"r{k % 3}", f"e{k}", k, k / 3, "dwell", "warning", k % 4 if k % 5 else None, odd[k % 9], None if k % 7 == 0 else k / 7, "s", odd[(k + 1) % 9]) for k in range(90)]
    events.append(("a/b c", "x", 1, 0.1, "role", "info", 1, "car", 1e-9, "s", None))
    tracks = [(f"r{k % 3}", k // 4, k, k % 4, "car", k, k + 1, k + 20, k + 31) for k in range(90)]
    manifests = [(f"r{k}", f"S{k}", ("EO", "IR", "OTHER")[k], "completed", 'x "y"') for k in range(3)] + [("a/b c", "S9", "EO", "completed", None), ("empty", "S8", "IR", "completed", None)]
    return spark.createDataFrame(events, EVENT), spark.createDataFrame(tracks, TRACK), spark.createDataFrame(manifests, RUN)


def evidence_rows(df):
    return sorted((r.run_id, r.sensor_id, r.modality, r.event_id, r.frame_number, r.timestamp_s, r.severity, r.track_id, r.label, r.confidence, tuple(r.bbox) if r.bbox else None) for r in df.collect())


@pytest.mark.parametrize("per_file", [1000, 7])
def test_read_as_written(spark, tmp_path, runs, per_file):
    events, tracks, manifests = runs
    root = str(tmp_path / "runs")
    assert RF.write_runs({"events": events, "tracks": tracks}, manifests, root, rows_per_file=per_file) == 5
    want = IO.evidence_from_runs(events, manifests, tracks)
    assert evidence_rows(IO.read_evidence(spark, root)) == evidence_rows(want)
    assert sorted(os.listdir(root)) == ["a%2Fb c", "empty", "r0", "r1", "r2"]
    back = IO.read_csv(spark, f"{root}/*/events.csv", ["event_id", "message"])
    assert sorted((r.event_id, r.message or "") for r in back.collect()) == sorted((r.event_id, r.message or "") for r in events.collect())
    order = [(r._file, r._position, int(r.frame_number)) for r in IO.read_csv(spark, f"{root}/r1/events.csv", ["frame_number"]).collect()]
    assert [f for _, _, f in sorted(order, key=lambda r: r[1])] == sorted(f for _, _, f in order)
    for run in os.listdir(root):
        document = json.load(open(f"{root}/{run}/run_manifest.json"))
        assert os.path.isdir(f"{root}/{run}/events.csv") == (per_file == 7 and run.startswith("r"))
        for f in document["files"]:
            raw = open(f"{root}/{run}/{f['name']}", "rb").read()
            assert (len(raw), hashlib.sha256(raw).hexdigest()) == (f["bytes"], f["sha256"])
        assert sum(f["rows"] for f in document["files"]) == events.where(F.col("run_id") == document["metadata"]["run_id"]).count() + tracks.where(F.col("run_id") == document["metadata"]["run_id"]).count()


def test_existing_stray_and_repeated_runs_are_refused(spark, tmp_path, runs):
    events, tracks, manifests = runs
    root = str(tmp_path / "runs")
    RF.write_runs({"events": events}, manifests, root)
    before = open(f"{root}/r0/run_manifest.json").read()
    with pytest.raises(FileExistsError):
        RF.write_runs({"events": events}, manifests, root)
    for other, fault in ((manifests.where("run_id <> 'r1'"), "r1"), (manifests.union(manifests), "repeat")):
        with pytest.raises(ContractError, match=fault):
            RF.write_runs({"events": events}, other, str(tmp_path / "other"))
    assert os.listdir(tmp_path / "other") == [] and open(f"{root}/r0/run_manifest.json").read() == before


def test_a_failing_task_leaves_nothing(spark, tmp_path, runs):
    events, _, manifests = runs
    broken = events.withColumn("label", F.when(F.col("event_id") == "e71", F.raise_error(F.lit("lost"))).otherwise(F.col("label")))
    with pytest.raises(Exception, match="lost"):
        RF.write_runs({"events": broken}, manifests, str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_only_committed_journals_count(tmp_path):
    """Files of an attempt that wasn't committed are not in a journal that counts."""
    import pyarrow as pa

    staging = str(tmp_path / "s")
    for name in ("files", "journals"):
        os.makedirs(f"{staging}/{name}")
    writer = RF.RunFolderWriter(staging, {"events.csv": "a,b"})
    batch = pa.RecordBatch.from_arrays([pa.array(["r", "r"]), pa.array(["events.csv"] * 2), pa.array([0, 1], pa.int32()), pa.array(["1,2", "3,4"])], ["folder", "name", "part", "line"])
    first, second = writer.write(iter([batch])), writer.write(iter([batch]))
    writer.commit([second, writer.write(iter([]))])
    assert [json.loads(x) for x in open(f"{staging}/committed.json")] == [{"journal": second.name}] and first.name != second.name
    writer.abort([])
    assert not os.path.exists(staging)


def test_publishing_again_changes_nothing(tmp_path):
    import pyarrow as pa

    staging, root = tmp_path / "_staging-1", tmp_path
    os.makedirs(staging / "files")
    (staging / "files" / "x").write_text("a\n1\n")
    files = [{"name": "events.csv", "part": 0, "path": str(staging / "files" / "x"), "rows": 1, "bytes": 4, "sha256": "d"}]
    rows = pa.RecordBatch.from_pylist([{"folder": "r", "document": '{"n": 1}', "write_id": "1", "files": files}])
    publish = RF._publish(str(root), str(staging), {"events.csv": "a", "tracks.csv": "b"})
    for _ in range(2):
        assert [b.column(0).to_pylist() for b in publish(iter([rows]))] == [["r"]]
    assert (root / "r" / "events.csv").read_text() == "a\n1\n" and (root / "r" / "tracks.csv").read_text() == "b\n"
    with pytest.raises(FileExistsError):
        list(publish(iter([pa.RecordBatch.from_pylist([{"folder": "r", "document": "{}", "write_id": "2", "files": []}])])))


def put(root, name, manifest, events):
    folder = root / name
    folder.mkdir()
    if manifest is not None:
        (folder / "run_manifest.json").write_text(json.dumps(manifest))
    if events is not None:
        (folder / "events.csv").write_text(events)
    (folder / "tracks.csv").write_text("frame_number,track_id,x1,y1,x2,y2\n")


HEAD = "event_id,frame_number,timestamp_s,event_type,severity,source,track_id,label,confidence\n"


@pytest.mark.parametrize(("manifest", "events", "message"), [
    ({"sensor_id": "A", "modality": "RADAR"}, HEAD, "unsupported_modality"), ({"sensor_id": "A"}, HEAD, "unsupported_modality"), ({"sensor_id": " ", "modality": "EO"}, HEAD, "missing_sensor_id"),
    ({"sensor_id": "A", "modality": "EO"}, None, "no_events_file"), ({"sensor_id": "A", "modality": "EO"}, HEAD.replace("label,", "").replace("source,", ""), "missing required columns: label, source"),
    ({"sensor_id": "A", "modality": "EO"}, HEAD + "e,1,1.0,t,urgent,s,,,\n", "severity urgent")])
def test_contract_on_load(spark, tmp_path, manifest, events, message):
    put(tmp_path, "good", {"sensor_id": "G", "modality": "IR"}, HEAD + "e,1,1.0,t,info,s,,,\n")
    put(tmp_path, "bad", manifest, events)
    with pytest.raises(Exception, match=message):
        IO.read_evidence(spark, str(tmp_path)).collect()


def test_headers_with_line_breaks_and_too_many_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"two\nlines",b\n1,2\n')
    (tmp_path / "b.csv").write_text("﻿b,c\n3,4,5\n6\n\n")
    (tmp_path / "c.csv").write_text("")
    rows = sorted((r["b"], r["c"], r["two\nlines"], r._position) for r in IO.read_csv(spark, str(tmp_path), ["b", "c", "two\nlines"]).where("b is not null").collect())
    assert rows == [("2", None, "1", 0), ("3", "4", None, 0), ("6", None, None, 1)]
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "wide.csv").write_text(",".join(f"c{i}" for i in range(80)) + "\n")
    with pytest.raises(Exception, match="more than 64 columns"):
        IO.read_csv(spark, str(tmp_path / "w"), ["c1"]).collect()
