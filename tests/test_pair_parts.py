"""A crowded cell is dealt in few parts, and its pairs are the same."""

from pyspark.sql import functions as F

from sensorframe.operators import fusion
from sensorframe.operators.fusion import FusionConfig, compatible_pairs
from sensorframe.runtime import ship
from tests.test_bursts import burst, rows_of


def test_parts_don_t_grow_with_the_cell(spark):
    n = [(1,), (3,), (4,), (400,), (20_000,), (50_000,), (10_000_000,)]
    parts = spark.createDataFrame(n, "n long")
    assert [r[0] for r in parts.select(fusion._parts(F.col("n"), 3)).collect()] == [1, 1, 2, 2, 3, 4, 12]
    assert [r[0] for r in parts.select(fusion._parts(F.col("n"), 20_000)).collect()] == [1, 1, 1, 1, 1, 3, 12]


def test_pairs_of_a_crowded_cell(spark):
    ship(spark)
    events = burst(11, 240, 2.0, step=0.125)
    found = compatible_pairs(rows_of(spark, events), FusionConfig(max_time_delta_s=0.5), cell_rows=3)
    got = {frozenset((r.a_event_id, r.b_event_id)) for r in found.collect()}
    want = {frozenset((a["id"], b["id"])) for a in events for b in events if a["sensor"] != b["sensor"] and abs(a["t"] - b["t"]) <= 0.5}
    assert got == want and found.count() == len(want)
