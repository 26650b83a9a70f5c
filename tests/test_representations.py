import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.operators import anomaly
from sensorframe.operators.quantiles import exact_quantile
from sensorframe.operators import quantiles
from sensorframe.operators.representations import mature_crops, representation_changes, sample_tracks

ROW = "run_id string, track_id bigint, frame_ordinal bigint, hits bigint, confidence double, label string, x1 int, y1 int, x2 int, y2 int, width int, height int, embedding array<float>"


def rows(spark, items):
    data = [("r", t, f, h, c, "person", 4, 4, 28, 28, 32, 32, v) for t, f, h, c, v in items]
    df = spark.createDataFrame(data, ROW)
    return df.withColumn("frame_number", F.col("frame_ordinal")).withColumn("timestamp_s", F.col("frame_ordinal") / 10.0)


def test_cadence_and_similarity(spark):
    v = [10.0, 20.0, 30.0]
    t = rows(spark, [(1, k, h, 0.9, v) for k, h in enumerate([2, 3, 3, 4, 5])])
    sampled = sample_tracks(t, labels={"person"}, min_track_hits=3, sample_every_n_hits=2, pad_px=0, unique_hits=False)
    out = representation_changes(sampled, source="mean").orderBy("embedding_row").collect()
    assert [(r.track_hits, r.embedding_row, r.embedding_dim) for r in out] == [(3, 0, 3), (5, 1, 3)]
    assert out[0].previous_cosine_similarity is None and out[0].representation_change is None
    assert out[1].previous_cosine_similarity == pytest.approx(1.0)
    assert out[1].representation_change == pytest.approx(0.0, abs=1e-9)
    assert out[0].embedding_norm == pytest.approx(1.0)


def test_cap_per_frame_and_crop_gate(spark):
    t = rows(spark, [(k, 1, 1, 0.9, [1.0]) for k in range(1, 5)])
    kept = sample_tracks(t, min_track_hits=1, sample_every_n_hits=1, max_per_frame=2, pad_px=0)
    assert sorted(r.track_id for r in kept.collect()) == [1, 2]
    # a crop that is too small uses up its slot
    small = t.withColumn("x2", F.when(F.col("track_id") == 1, F.lit(8)).otherwise(F.col("x2")))
    kept = sample_tracks(small, min_track_hits=1, sample_every_n_hits=1, max_per_frame=2, pad_px=0)
    assert [r.track_id for r in kept.collect()] == [2]
    assert mature_crops(small, min_track_hits=1, pad_px=0).count() == 3


@pytest.mark.parametrize("bucket", [2, 4096])
def test_previous_sample_crosses_buckets(spark, bucket):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(12, 4)).astype(np.float32)
    frames = [0, 1, 5, 6, 7, 20, 21, 22, 30, 31, 40, 41]
    t = rows(spark, [(1, f, k + 1, 0.5, vectors[k].tolist()) for k, f in enumerate(frames)])
    out = representation_changes(t, bucket=bucket).orderBy("frame_ordinal").collect()
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    for k in range(1, 12):
        assert out[k].previous_cosine_similarity == pytest.approx(float(unit[k] @ unit[k - 1]), abs=1e-6)
    assert [r.embedding_row for r in out] == list(range(12))


def test_zero_vector_is_an_error(spark):
    with pytest.raises(Exception, match="zero length"):
        representation_changes(rows(spark, [(1, 0, 1, 0.5, [0.0, 0.0])])).collect()


def test_reference_and_scores(spark):
    normal = spark.createDataFrame([([1.0, 0.0],), ([0.99, 0.01],), ([0.98, 0.02],)], "embedding array<float>")
    ref = anomaly.fit_reference(normal, embedder_name="m", quantile=0.95).first()
    m = np.array([[1, 0], [0.99, 0.01], [0.98, 0.02]])
    c = m.mean(axis=0)
    d = 1 - m @ c / (np.linalg.norm(m, axis=1) * np.linalg.norm(c))
    assert ref.sample_count == 3 and ref.threshold == pytest.approx(np.quantile(d, 0.95), abs=1e-7)
    fixed = spark.createDataFrame([(1, "m", [1.0, 0.0], 2, 0.2, 3, 0.95, {})], anomaly.REFERENCE)
    t = rows(spark, [(1, 0, 3, 0.9, [1.0, 0.0]), (2, 0, 3, 0.9, [0.0, 1.0]), (3, 0, 2, 0.9, [0.0, 1.0])])
    out = {r.track_id: r for r in anomaly.score_anomalies(t, fixed, embedder_name="m").collect()}
    assert set(out) == {1, 2}
    assert (out[1].score, out[1].is_anomaly) == (pytest.approx(0.0), False)
    assert (out[2].score, out[2].is_anomaly, out[2].margin) == (pytest.approx(1.0), True, pytest.approx(0.8))
    with pytest.raises(ValueError):
        anomaly.score_anomalies(t, fixed, embedder_name="other")
    with pytest.raises(ValueError):
        anomaly.fit_reference(normal.limit(1), embedder_name="m")


def test_quantile_by_narrowing(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "GATHER", 50)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = random.Random(1)
    values = [rng.choice([0.25, rng.random(), rng.random() ** 8]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "score double")
    for q in (0.05, 0.5, 0.95, 0.999):
        assert exact_quantile(df, "score", q) == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_vector_expressions(spark):
    from sensorframe.functions import vectors as V

    df = spark.createDataFrame([([3.0, 4.0], [0.0, 2.0])], "v array<float>, c array<float>")
    row = df.select(
        V.norm(F.col("v")), V.dot(F.col("v"), F.col("c")), V.cosine_distance(F.col("v"), F.col("c")),
        V.l2_normalise(F.col("v")), V.is_finite_vector(F.col("v")), V.is_finite_vector(F.array(F.lit(float("nan")))),
    ).first()
    assert tuple(row) == (5.0, 8.0, pytest.approx(0.2), [0.6, 0.8], True, False)
    for bad in ([0.0, 0.0], [1.0]):
        with pytest.raises(Exception, match="equal dimensions"):
            df.select(V.cosine_distance(F.col("v"), F.lit(bad))).collect()
