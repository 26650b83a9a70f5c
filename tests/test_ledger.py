"""Evidence tables of a stream advance together, once per batch."""

import pytest
from pyspark.sql import functions as F

from sensorframe.operators.summaries import run_counters
from sensorframe.runtime import ship
from sensorframe.schemas import TABLES, conform
from sensorframe.streaming.ledger import EvidenceLedger, evidence_sink


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def frames_of(spark, low, high):
    rows = spark.range(low, high).select(F.concat(F.lit("r"), F.col("id") % 2).alias("run_id"), F.col("id").alias("frame_ordinal"), (F.col("id") * 3).alias("frame_number"), (F.col("id") / 10).alias("timestamp_s"))
    return rows.withColumns({"width": F.lit(10), "height": F.lit(10)})


def derive(batch):
    """Six tables; a track lives for four frames of its run."""
    tracks = batch.withColumns({"track_id": F.floor(F.col("frame_ordinal") / 8), "hits": F.floor(F.col("frame_ordinal") % 8 / 2) + 1, "label": F.lit("car")})
    reps = tracks.withColumn("previous_cosine_similarity", F.when(F.col("hits") > 1, 0.5))
    scores = tracks.withColumn("is_anomaly", F.col("frame_ordinal") % 3 == 0)
    events = scores.filter("is_anomaly").withColumn("event_id", F.concat(F.lit("e"), "frame_ordinal"))
    return {"frames": batch, "detections": batch, "tracks": tracks, "representations": reps, "anomalies": scores, "events": events, "alerts": events.filter("frame_ordinal % 2 = 0").withColumn("alert_id", F.col("event_id"))}


def state(ledger):
    counters = sorted(tuple(sorted(r.asDict().items())) for r in ledger.counters().collect())
    return counters, {n: ledger.table(n).count() for n in TABLES}


def test_counters_and_tables_equal_a_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    for k in range(3):
        frames_of(spark, 20 * k, 20 * k + 20).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(frames_of(spark, 0, 1).schema).option("maxFilesPerTrigger", 1).parquet(source)
    ledger = EvidenceLedger(spark, str(tmp_path / "out"))
    evidence_sink(stream, derive, ledger, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    tables = {n: conform(df, TABLES[n]) for n, df in derive(frames_of(spark, 0, 60)).items()}
    got, want = ledger.counters(), run_counters(**tables)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    for name, df in tables.items():
        assert sorted(map(repr, ledger.table(name).collect())) == sorted(map(repr, df.collect()))
    assert ledger.commits().count() == 3


def test_repeated_and_broken_batches(spark, tmp_path, monkeypatch):
    ledger = EvidenceLedger(spark, str(tmp_path))
    assert state(ledger) == ([], dict.fromkeys(TABLES, 0))
    assert ledger.write("s-0", derive(frames_of(spark, 0, 20)))
    before = state(ledger)
    assert not ledger.write("s-0", derive(frames_of(spark, 0, 20))) and state(ledger) == before
    broken = derive(frames_of(spark, 20, 40))
    broken["alerts"] = broken["alerts"].withColumn("alert_id", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):  # five tables are written by then
        ledger.write("s-1", broken)
    assert state(ledger) == before
    with monkeypatch.context() as m:
        m.setattr(EvidenceLedger, "_commit", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            ledger.write("s-1", derive(frames_of(spark, 20, 40)))
    assert state(ledger) == before
    assert ledger.write("s-1", derive(frames_of(spark, 20, 40)))
    assert state(ledger)[1]["frames"] == 40 and ledger.write("s-2", {"events": derive(frames_of(spark, 0, 3))["events"]})
    assert state(ledger)[1]["frames"] == 40
