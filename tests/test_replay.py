"""Batches of a replayed stream don't grow with the table."""

import pytest

from sensorframe.plans import catalog
from sensorframe.runtime import ship


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_a_large_table_has_more_batches(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(catalog, "BATCH_ROWS", 1_000, raising=False)
    rows = spark.range(6_000).selectExpr("id", "CAST(id AS DOUBLE) AS timestamp_s")
    sizes = []
    stream = catalog.replay(spark, rows, "replay-test")
    writer = stream.writeStream.foreachBatch(lambda batch, _: sizes.append(batch.count())).option("checkpointLocation", str(tmp_path))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == 6_000 and max(sizes) < 1_500


def test_times_that_are_all_one_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(catalog, "BATCH_ROWS", 10, raising=False)
    stream = catalog.replay(spark, spark.range(50).selectExpr("id", "1.0D AS timestamp_s"), "replay-one")
    from sensorframe.streaming.runs import drain
    assert drain(stream, "replay-one-out").count() == 50
