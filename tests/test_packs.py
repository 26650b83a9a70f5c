"""Packed vectors are read by ranges as they were written."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.operators.contracts import ContractError
from sensorframe.operators.sampling import timestamp_of
from sensorframe.runtime import ship
from sensorframe.sources.packs import PackReader, read_vectors, write_vectors


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def vectors_of(spark, data):
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "embedding_row bigint, embedding array<float>").repartition(4)


@pytest.mark.parametrize(("n", "per_file", "range_bytes"), [(1000, 10**6, 1 << 20), (1000, 90, 400), (7, 1, 1), (0, 5, 64)])
def test_round_trip(spark, tmp_path, n, per_file, range_bytes):
    data = np.random.default_rng(n).normal(size=(n, 5)).astype("<f4")
    data[:1] = [np.nan, np.inf, -np.inf, -0.0, 1e-40]
    path = str(tmp_path / "pack.f32")
    write_vectors(vectors_of(spark, data), path, 5, rows_per_file=per_file)
    got = sorted((r.embedding_row, np.array(r.embedding, "<f4").tobytes()) for r in read_vectors(spark, path, 5, range_bytes=range_bytes).collect())
    assert got == [(i, v.tobytes()) for i, v in enumerate(data)]
    assert os.path.isdir(path) == (n > per_file) and os.listdir(tmp_path) == ["pack.f32"]
    if os.path.isfile(path):
        assert open(path, "rb").read() == data.tobytes()
    assert len(PackReader(path, 5, range_bytes).partitions()) >= n * 20 / max(range_bytes, 20)


@pytest.mark.parametrize(("rows", "message"), [
    ([(0, [1.0, 2.0]), (2, [1.0, 2.0])], "gap"), ([(0, [1.0, 2.0]), (0, [1.0, 2.0])], "repeat"), ([(1, [1.0, 2.0])], "follow"), ([(0, [1.0])], "2 values"), ([(0, None)], "null"), ([(0, [1.0, None])], "null")])
def test_faults_leave_nothing(spark, tmp_path, rows, message):
    df = spark.createDataFrame(rows, "embedding_row bigint, embedding array<float>")
    with pytest.raises(Exception, match=message):
        write_vectors(df, str(tmp_path / "p"), 2)
    assert os.listdir(tmp_path) == []


def test_wrong_sizes_and_gaps_are_refused(spark, tmp_path):
    (tmp_path / "odd.f32").write_bytes(b"x" * 10)
    with pytest.raises(Exception, match="no rows of 2"):
        read_vectors(spark, str(tmp_path / "odd.f32"), 2).collect()
    (tmp_path / "pack").mkdir()
    (tmp_path / "pack" / "part-000000000000004.f32").write_bytes(b"x" * 8)
    with pytest.raises(ContractError, match="begins at row 4"):
        PackReader(str(tmp_path / "pack"), 2, 64).partitions()
    with pytest.raises(FileExistsError):
        write_vectors(vectors_of(spark, [[1.0, 2.0]]), str(tmp_path / "pack"), 2)


def test_a_frame_rate_of_none_is_a_value_error(spark):
    with pytest.raises(ValueError, match="fps 0"):
        timestamp_of(F.lit(1), 0)
