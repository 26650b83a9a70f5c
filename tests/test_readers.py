"""Exchange files as they are found: quoted fields, any column order, missing parts."""

import json

import pytest
from pyspark.sql import functions as F

from sensorframe.functions.text import natural_key
from sensorframe.operators.anomaly import centroid_distances
from sensorframe.operators.fusion import attach_boxes
from sensorframe.operators.summaries import tail_rows
from sensorframe.sources import tables as IO

EVENT = ["event_id", "frame_number", "timestamp_s", "event_type", "severity", "track_id", "label", "confidence", "source", "message", "metadata"]
TRACK = ["frame_number", "track_id", "x1", "y1", "x2", "y2"]


def write_run(root, name, *, event=None, manifest=True, order=1, tracks=(("3", "7", "0", "0", "5", "5"),)):
    folder = root / name
    folder.mkdir()
    row = {"event_id": "e1", "frame_number": "3", "timestamp_s": "1.5", "event_type": "dwell", "severity": "warning", "track_id": "7.0", "label": "car", "confidence": "",
           "source": "s", "message": 'he said ""hi"", then\nleft', "metadata": '{""a"": ""b,c""}'} | (event or {})
    names = EVENT[::order]
    (folder / "events.csv").write_text(",".join(names) + "\r\n" + ",".join(f'"{row[c]}"' for c in names) + "\r\n")
    (folder / "tracks.csv").write_text(",".join(TRACK) + "\n" + "".join(",".join(t) + "\n" for t in tracks))
    if manifest:
        (folder / "run_manifest.json").write_text(json.dumps({"sensor_id": f"S_{name}", "modality": "EO", "metadata": {"run_id": name}}))


def test_read_evidence(spark, tmp_path):
    write_run(tmp_path, "r1")
    write_run(tmp_path, "r2", order=-1, tracks=(("3", "7", "0", "0", "5", "5"), ("3", "7", "1", "1", "6", "6"), ("3", "7", "0", "1", "2", "3")))
    got = {r.run_id: r for r in IO.read_evidence(spark, str(tmp_path)).collect()}
    assert {(r.run_id, r.sensor_id, r.event_id, r.severity, r.frame_number, r.timestamp_s) for r in got.values()} == {(f"r{k}", f"S_r{k}", "e1", "warning", 3, 1.5) for k in (1, 2)}
    assert tuple(got["r1"].bbox) == (0, 0, 5, 5) and tuple(got["r2"].bbox) == (0, 1, 2, 3)  # the last row of the file


@pytest.mark.parametrize(("wrong", "message"), [({"manifest": False}, "no manifest for run bad"), ({"event": {"severity": "nope"}}, "has severity nope")])
def test_faults_are_raised(spark, tmp_path, wrong, message):
    write_run(tmp_path, "good")
    write_run(tmp_path, "bad", **wrong)
    with pytest.raises(Exception, match=message):
        IO.read_evidence(spark, str(tmp_path)).collect()


def test_csv_round_trip_and_column_orders(spark, tmp_path):
    text = 'a "quoted", text\nof two lines'
    df = spark.createDataFrame([(text, '{"a": "b"}', None)], "message string, metadata string, label string")
    df.write.options(header=True, quote='"', escape='"').csv(str(tmp_path / "x"))
    (tmp_path / "x" / "part-z.csv").write_text("metadata,message,extra\nm2,t2,e\n")
    rows = sorted(IO.read_csv(spark, str(tmp_path / "x")).collect(), key=lambda r: r.message)
    assert [(r.message, r.metadata, r.extra) for r in rows] == [(text, '{"a": "b"}', None), ("t2", "m2", "e")]


def test_last_duplicate_whatever_the_layout(spark):
    events = spark.createDataFrame([("r", 3, 7, "e")], "run_id string, frame_number bigint, track_id bigint, event_id string")
    rows = [("r", 3, 7, k, k % 5, 0, 9, 9) for k in range(40)]
    schema = "run_id string, frame_number bigint, track_id bigint, _position bigint, x1 int, y1 int, x2 int, y2 int"
    for parts in (1, 3, 8):
        tracks = spark.createDataFrame(rows, schema).repartition(parts, "x1")
        assert attach_boxes(events, tracks).first().bbox.x1 == 39 % 5


def test_long_digit_runs_sort_as_numbers(spark):
    names = ["f2222222222222222222x", "f10000000000000000000x", "f007", "f7", "f8", "f", "9z", "F10"] + ["f1" + "0" * 30]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(natural_key(F.col("n")), "n").collect()]
    assert got == ["9z", "f", "f007", "f7", "f8", "F10", "f2222222222222222222x", "f10000000000000000000x", "f1" + "0" * 30]


def test_tail_honours_its_limit(spark):
    assert tail_rows(spark.range(6000).withColumn("x", F.lit(1.0)), [F.col("id")], 5000).count() == 5000


def test_centroid_of_other_length_is_refused(spark):
    df = spark.createDataFrame([([1.0, 0.0],)], "embedding array<float>")
    assert centroid_distances(df, [0.0, 2.0]).first().score == pytest.approx(1.0)
    with pytest.raises(Exception, match="dimension"):
        centroid_distances(df, [1.0, 0.0, 0.0]).collect()
