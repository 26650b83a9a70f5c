"""The probe's tasks follow its rows, not the files they come in."""

from pyspark.sql import functions as F

from sensorframe.operators import sampling as S
from sensorframe.runtime import ship


def test_tasks_of_a_step_follow_the_rows(spark, monkeypatch):
    ship(spark)
    parts, real = [], S._with_class_count
    monkeypatch.setattr(S, "_with_class_count", lambda ready, n: (parts.append(ready.rdd.getNumPartitions()), real(ready, n))[1])
    train = spark.range(240).repartition(40).select(
        (F.col("id") % 3).alias("label"), F.array((F.col("id") % 3).cast("double"), (F.col("id") % 7).cast("double")).alias("embedding"))
    for rows, most in ((50_000, 1), (60, 4)):
        monkeypatch.setattr(S, "PROBE_ROWS", rows, raising=False)
        model = S.linear_probe(train, max_iter=3)
        assert parts[-1] <= most
    assert S.probe_predictions(model, train).count() == 240
