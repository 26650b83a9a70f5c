"""What runs once per pair of events is short enough to be compiled, shares its work and follows the rows, not their bytes."""

import math
import random

from pyspark.sql import functions as F

from sensorframe.operators import fusion
from sensorframe.operators.fusion import FusionConfig, compatible_pairs
from sensorframe.plans.catalog import r6, r6_of_many
from sensorframe.runtime import ship
from sensorframe.schemas import EVIDENCE
from tests.test_bursts import burst, rows_of
from tests.test_fusion import evidence_row

HUGE_METHOD = 8000  # bytes; Java compiles no longer one


def _longest_method(df) -> int:
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
        return max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size()))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_methods_are_compiled(spark):
    ship(spark)
    rows = rows_of(spark, burst(11, 60, 2.0, step=0.125))
    for gate in (None, 0.3):
        pairs = compatible_pairs(rows, FusionConfig(max_time_delta_s=0.5, spatial_iou_threshold=gate), cell_rows=3)
        assert _longest_method(pairs) < HUGE_METHOD / 2


def test_a_row_travels_less_and_to_as_many_tasks_as_rows_ask(spark, monkeypatch):
    """Five in two parts, with the half that lies within reach of the cell before: 3.5 copies (6 before)."""
    ship(spark)
    monkeypatch.setattr(fusion, "PAIR_ROWS", 500)
    seen = []
    frame = type(spark.range(1))
    real = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, n, *by: (seen.append((n, df.count())), real(df, n, *by))[1])
    events = burst(4, 2000, 100.0)
    compatible_pairs(rows_of(spark, events), FusionConfig(max_time_delta_s=0.5), cell_rows=3).count()
    copies = sum(n for _, n in seen)
    assert 3.2 * len(events) < copies < 3.8 * len(events)
    assert [n for n, _ in seen] == [math.ceil(copies / 500)] * 2


def test_incomplete_boxes(spark):
    """A corner that is null bounds nothing, but makes the box's own area 0, as before."""
    ship(spark)
    boxes = [(None, 0.0, 20.0, 20.0), (0.0, 0.0, 20.0, 20.0), (None, 0.0, 30.0, 20.0), (5.0, 40.0, None, None), (None, None, None, None), None, (0.0, 5.0, 20.0, 9.0)]
    rows = [evidence_row(f"run{k}", f"s{k}", f"e{k}", k / 100, "x", "p", box=None) for k in range(len(boxes))]
    rows = [[*r[:-1], b and dict(zip(("x1", "y1", "x2", "y2"), b))] for r, b in zip(rows, boxes)]
    got = {(r.a_event_id, r.b_event_id): r.iou for r in compatible_pairs(spark.createDataFrame(rows, EVIDENCE), FusionConfig(max_time_delta_s=0.5)).collect()}
    known = lambda f, *v: f([x for x in v if x is not None], default=None)

    def area(x1, y1, x2, y2):
        return math.prod(max(0.0, hi - lo) if None not in (lo, hi) else 0.0 for lo, hi in ((x1, x2), (y1, y2)))

    for i, a in enumerate(boxes):
        for j in range(i + 1, len(boxes)):
            b = boxes[j]
            if a is None or b is None:
                want = None
            else:
                inter = area(known(max, a[0], b[0]), known(max, a[1], b[1]), known(min, a[2], b[2]), known(min, a[3], b[3]))
                union = area(*a) + area(*b) - inter
                want = inter / union if inter > 0 and union > 0 else 0.0
            assert got.pop((f"e{i}", f"e{j}")) == want, (a, b)
    assert not got


def test_rounding_equals_sparks(spark):
    r = random.Random(5)
    values = [r.random() * 10.0 ** r.randint(-8, 16) * r.choice([1, -1]) for _ in range(20_000)]
    values += [k / 2**r.randint(0, 20) for k in range(-3000, 3000)] + [(k + 0.5) / 10.0**d for k in range(-2000, 2000) for d in (3, 6)]
    values += [math.nextafter((k + 0.5) / 1000, s * math.inf) for k in range(500) for s in (1, -1)] + [0.0, -0.0, 1e300, -1e300, math.nan, math.inf, None]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (3, 6):
        other = rows.where(~r6_of_many("v", digits).cast("string").eqNullSafe(r6("v", digits).cast("string")))
        assert other.collect() == []
