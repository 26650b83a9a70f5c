import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.functions import geometry as G
from sensorframe.functions import text as X
from sensorframe.operators import sampling as S
from sensorframe.operators import summaries as M
from sensorframe.operators.contracts import ContractError, missing_files, validate_frame_manifest
from sensorframe.operators.sequence import number_rows, previous
from sensorframe.schemas import FRAMES, conform
from sensorframe.sources import datasets as D
from sensorframe.sources import tables as IO


def touch(root, *names, content=b"x"):
    for name in names:
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(content)


def test_natural_order_of_folder(spark, tmp_path):
    names = ["img10.jpg", "img2.jpg", "IMG1.png", "10.jpg", "2.jpg", "notes.txt", "a1b10.bmp", "a1b9.bmp", "a.tif"]
    touch(tmp_path, *names)
    frames = D.index_image_folder(spark, str(tmp_path), fps=10.0).orderBy("frame_ordinal").collect()
    assert [f.image_path.split("/")[-1] for f in frames] == [
        "2.jpg", "10.jpg", "a1b9.bmp", "a1b10.bmp", "a.tif", "IMG1.png", "img2.jpg", "img10.jpg"]
    assert frames[3].timestamp_s == pytest.approx(0.3)


def test_listing_never_reads_contents(spark, tmp_path):
    touch(tmp_path, "a.jpg")
    plan = D.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_visdrone_frames_annotations_and_sampling(spark, tmp_path):
    touch(tmp_path, *[f"sequences/s1/{k:07d}.jpg" for k in (1, 2, 3, 4)])
    (tmp_path / "annotations").mkdir()
    (tmp_path / "annotations" / "s1.txt").write_text(
        "1,101,10,12,20,15,1,4,0,0\n1,102,0,0,5,5,1,0,0,0\n2,101,11,12,20,15,1,1,0,0\n3,103,1,1,4,4,0,99,1,1\n")
    frames = D.index_visdrone(spark, str(tmp_path), fps=10.0)
    picked = S.sample_frames(frames, frame_step=2, max_frames=2).orderBy("frame_number").collect()
    assert [(f.frame_number, f.timestamp_s, f.sensor_id) for f in picked] == [
        (1, 0.0, "VISDRONE:s1"), (3, 0.2, "VISDRONE:s1")]
    truth = D.read_visdrone_annotations(spark, str(tmp_path / "annotations"))
    rows = {(r.frame_index, r.target_id): r for r in truth.collect()}
    car = rows[(1, 101)]
    assert (car.label, car.x1, car.y1, car.x2, car.y2, car.ignored) == ("car", 10, 12, 30, 27, False)
    assert rows[(1, 102)].ignored and rows[(3, 103)].ignored and rows[(3, 103)].label == "unknown"
    found = D.annotations_as_detections(truth, source="visdrone_ground_truth").collect()
    assert {(d.frame_number, d.object_id, d.confidence) for d in found} == {(1, 101, 1.0), (2, 101, 1.0)}
    assert json.loads(found[0].metadata)["ignored"] is False


def test_uavdt_names(spark, tmp_path):
    touch(tmp_path, *[f"UAV-benchmark-M/M1/img{k:06d}.jpg" for k in (1, 2, 10)])
    frames = D.index_uavdt(spark, str(tmp_path)).orderBy("frame_ordinal").collect()
    assert [f.frame_number for f in frames] == [1, 2, 10]
    touch(tmp_path, "UAV-benchmark-M/M1/frame7.jpg")
    with pytest.raises(ContractError):
        D.index_uavdt(spark, str(tmp_path))
    gt = spark.createDataFrame([("/GT/M1_gt.txt",), ("/GT/M1_gt_whole.txt",), ("/GT/x.csv",)], "path string")
    assert {r.sequence_id for r in D.uavdt_annotation_candidates(gt).collect()} == {"M1"}


def test_coco_document(spark, tmp_path):
    doc = {
        "images": [{"id": i, "file_name": f"{i}.jpg", "width": 100, "height": 100} for i in (1, 2, 3)],
        "annotations": [{"id": 10 + k, "image_id": i, "category_id": c, "bbox": [1, 1, 10, 10]}
                        for k, (i, c) in enumerate([(1, 1), (1, 2), (2, 2), (3, 3)])],
        "categories": [{"id": 1, "name": "person"}, {"id": 2, "name": "car"}, {"id": 3, "name": "dog"}],
    }
    path = tmp_path / "instances.json"
    path.write_text(json.dumps(doc))
    tables = D.read_coco(spark, str(path))
    first = S.coco_subset(*tables, names=["person", "car"], max_images=2, seed=7)
    again = S.coco_subset(*tables, names=["person", "car"], max_images=2, seed=7)
    assert sorted(r.id for r in first.images.collect()) == sorted(r.id for r in again.images.collect()) == [1, 2]
    assert {r.id for r in first.categories.collect()} == {1, 2}
    assert tuple(first.counts().first()) == (2, 3)
    with pytest.raises(ValueError):
        S.coco_subset(*tables, names=["zebra"])
    path.write_text(json.dumps({"images": []}))
    with pytest.raises(ContractError):
        D.read_coco(spark, str(path))


def test_reference_inventory(spark, tmp_path):
    touch(tmp_path, "a/one.jpg", "b/two.PNG", "c/skip.txt")
    inventory = D.inventory_reference_images(spark, str(tmp_path))
    assert inventory.count() == 2
    before = D.inventory_digest(inventory).first()
    assert before.files == 2
    touch(tmp_path, "a/one.jpg", content=b"changed")
    assert D.inventory_digest(D.inventory_reference_images(spark, str(tmp_path))).first().digest != before.digest


def test_embedding_pack(spark, tmp_path):
    data = np.arange(12, dtype="<f4").reshape(4, 3)
    path = tmp_path / "pack.f32"
    path.write_bytes(data.tobytes())
    pack = D.read_embedding_pack(spark, str(path), 3)
    got = {r.embedding_row: list(r.embedding) for r in pack.collect()}
    assert got == {k: data[k].tolist() for k in range(4)}
    index = spark.createDataFrame([(2, 5)], "embedding_row bigint, track_id bigint")
    assert list(D.join_vectors(index, pack).first().embedding) == [6.0, 7.0, 8.0]


def manifest_dir(root, run, sensor, modality="EO"):
    d = root / run
    d.mkdir()
    (d / "run_manifest.json").write_text(json.dumps(
        {"sensor_id": sensor, "modality": modality, "status": "completed", "metadata": {"run_id": run}}))
    (d / "events.csv").write_text(
        "event_id,frame_number,timestamp_s,event_type,severity,track_id,label,confidence,source,message,metadata\n"
        "dwell:1,3,0.3,dwell,warning,1,person,0.5,dwell,m,{}\ndwell:2,4,0.4,dwell,warning,,,,dwell,m,{}\n")
    (d / "tracks.csv").write_text("frame_number,track_id,x1,y1,x2,y2\n3,1,1,2,3,4\n9,1,5,5,6,6\n")


def test_evidence_of_run_folders(spark, tmp_path):
    manifest_dir(tmp_path, "eo", "CAM_A")
    manifest_dir(tmp_path, "ir", "CAM_B", "IR")
    rows = {(r.run_id, r.event_id): r for r in IO.read_evidence(spark, str(tmp_path)).collect()}
    assert len(rows) == 4
    a = rows[("eo", "dwell:1")]
    assert (a.sensor_id, a.modality, tuple(a.bbox), a.track_id) == ("CAM_A", "EO", (1.0, 2.0, 3.0, 4.0), 1)
    b = rows[("ir", "dwell:2")]
    assert b.bbox is None and b.label is None and b.confidence is None and b.track_id is None
    digests = [r.manifest_sha256 for r in IO.read_manifests(spark, f"{tmp_path}/*/run_manifest.json").collect()]
    assert len(set(digests)) == 2


def frame_table(spark, **change):
    row = dict(run_id="r", frame_id="f0", frame_number=0, frame_ordinal=0, timestamp_s=0.0, image_path="/x/0.jpg",
               width=64, height=48, sensor_id="s", modality="EO", source_path="v")
    row.update(change)
    return spark.createDataFrame([tuple(row[n] for n in FRAMES.names)], FRAMES)


def test_manifest_contract(spark):
    good = frame_table(spark)
    assert validate_frame_manifest(good).count() == 1
    with pytest.raises(ContractError):
        validate_frame_manifest(good.drop("sensor_id"))
    with pytest.raises(ContractError):
        validate_frame_manifest(good.limit(0))
    with pytest.raises(ContractError, match="duplicate_frame_id"):
        validate_frame_manifest(good.union(good))
    with pytest.raises(ContractError, match="missing files"):
        validate_frame_manifest(good, spark.createDataFrame([("/y.jpg",)], "path string"))
    assert missing_files(good, spark.createDataFrame([("/x/0.jpg",)], "path string")).count() == 0


def test_empty_tables_keep_their_schema(spark, tmp_path):
    IO.write_evidence({"events": spark.createDataFrame([], IO.TABLES["events"])}, str(tmp_path / "out"))
    back = IO.read_table(spark, "events", str(tmp_path / "out" / "events"))
    assert back.count() == 0 and back.columns == IO.TABLES["events"].names


def test_letterbox(spark):
    def run(name, first, second):
        return [(name, k, w, h) for k, (w, h) in enumerate([first, second])]

    rows = run("a", (64, 48), (96, 32)) + run("tall", (60, 100), (60, 30)) + run("wide", (100, 60), (30, 60))
    df = spark.createDataFrame(rows, "run_id string, frame_ordinal bigint, width int, height int")
    placed = {(r.run_id, r.frame_ordinal): r for r in G.letterbox_geometry(df).collect()}
    assert (placed[("tall", 1)].x_offset, placed[("tall", 1)].y_offset) == (0, 35)
    assert (placed[("wide", 1)].x_offset, placed[("wide", 1)].y_offset) == (35, 0)
    dims = {r.run_id: r for r in G.source_dimensions(df).collect()}
    assert dims["a"].source_dimensions == {"64x48": 1, "96x32": 1} and dims["a"].normalized_frames == 1
    boxed = G.letterbox_geometry(df).filter("run_id = 'wide' AND frame_ordinal = 1")
    there = G.to_canvas((F.lit(0.0), F.lit(0.0), F.lit(30.0), F.lit(60.0)))
    row = boxed.select(*[c.alias(n) for c, n in zip(there, "abcd")], "*")
    back = G.from_canvas(tuple(F.col(n) for n in "abcd"))
    assert tuple(row.select("a", "b", "c", "d").first()) == (35.0, 0.0, 65.0, 60.0)
    assert tuple(row.select(*back).first()) == (0.0, 0.0, 30.0, 60.0)


def test_raw_boxes_and_iou(spark):
    raw = spark.createDataFrame(
        [(2, 0.9, 10.2, 20.4, 80.8, 90.1), (0, 0.8, 95.0, 95.0, 110.0, 120.0), (7, 0.1, 2.5, 3.5, 2.4, 9.0)],
        "class_id int, confidence double, x1 double, y1 double, x2 double, y2 double",
    ).withColumn("width", F.lit(100)).withColumn("height", F.lit(100))
    got = [(r.label, r.x1, r.y1, r.x2, r.y2) for r in G.normalise_raw_boxes(raw, {0: "person", 2: "car"}).collect()]
    assert sorted(got) == [("car", 10, 20, 81, 90), ("person", 95, 95, 99, 99)]
    lit = lambda *v: tuple(F.lit(x) for x in v)
    a = lit(0, 0, 10, 10)
    row = spark.range(1).select(G.iou(a, a), G.iou(a, lit(20, 20, 30, 30)), G.iou(a, lit(5, 0, 15, 10))).first()
    assert tuple(row) == (1.0, 0.0, pytest.approx(1 / 3))


def test_text_expressions(spark):
    row = spark.range(1).select(
        X.media_kind(F.lit("/a/b.MP4")).alias("m"), X.split_name(F.lit("Set-VAL")).alias("s"),
        X.split_name(F.lit("my_testset")).alias("t"), X.split_name(F.lit("other")).alias("o"),
        X.frame_id(F.lit("clip"), F.lit(7)).alias("f"), X.class_color_index(F.lit(" Person ")).alias("c"),
    ).first()
    assert tuple(row) == ("video", "val", "test", "other", "clip_000007", 6)
    with pytest.raises(Exception, match="unsupported media"):
        spark.range(1).select(X.media_kind(F.lit("a.txt"))).collect()


def test_bucketed_numbering_and_lag(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", None]), k * rng.choice([1, 7]) + k, k) for k in range(200)]
    df = spark.createDataFrame(rows, "k string, pos bigint, id bigint")
    order = [F.col("pos"), F.col("id")]
    got = number_rows(df, ["k"], F.floor(F.col("pos") / 16), order, "n").collect()
    lagged = {r.id: r.b for r in previous(df, ["k"], "pos", ["id"], "b", 16, tie=["id"]).collect()}
    for key in ("a", None):
        ordered = sorted((r[1], r[2]) for r in rows if r[0] == key)
        rank = {i: n + 1 for n, (_, i) in enumerate(ordered)}
        assert {r.id: r.n for r in got if r.k == key} == rank
        before = [None] + [i for _, i in ordered]
        for (_, i), b in zip(ordered, before):
            assert (lagged[i].id if lagged[i] else None) == b


def test_split_and_class_summary(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(60)], "id bigint, label int")
    split = S.stratified_split(df, "label", ["id"]).groupBy("label").agg(F.count_if("is_test").alias("n")).collect()
    assert [r.n for r in split] == [6, 6, 6]
    with pytest.raises(ValueError):
        S.stratified_split(df.limit(1), "label", ["id"])
    d = spark.createDataFrame([("r", "car", 0.9), ("r", "person", 0.8), ("r", "car", 0.7), ("r", None, float("nan"))],
                              "run_id string, label string, confidence double")
    t = spark.createDataFrame([("r", "car", 1), ("r", "car", 1), ("r", "person", 2)], "run_id string, label string, track_id bigint")
    rows = {r.label: r for r in M.class_summary(d, t).collect()}
    assert (rows["car"].detections, rows["car"].tracks, rows["car"].mean_confidence) == (2, 1, pytest.approx(0.8))
    assert rows["unknown"].mean_confidence is None and rows["unknown"].tracks == 0


def test_conform_orders_and_casts(spark):
    df = conform(spark.createDataFrame([("5", "r")], "frame_number string, run_id string"), FRAMES)
    assert df.columns == FRAMES.names and df.first().frame_number == 5
