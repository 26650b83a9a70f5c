"""One crowded picture matched by many tasks gives the serial outcome."""

import random

import pytest
from pyspark.sql import functions as F

from sensorframe.operators import crowds
from sensorframe.operators.evaluation import match_predictions
from sensorframe.runtime import ship
from tests.plain import match

PRED = "run_id string, frame_number bigint, shared_class string, label string, prediction_index bigint, confidence double, x1 double, y1 double, x2 double, y2 double"
TRUTH = "run_id string, frame_number bigint, shared_class string, label string, ground_truth_index bigint, target_id bigint, x1 double, y1 double, x2 double, y2 double"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def outcome(spark, preds, truth, crowd, threshold=0.4):
    p = spark.createDataFrame([("r", 1, "car", "p", i, c, *b) for i, c, b in preds], PRED)
    g = spark.createDataFrame([("r", 1, "car", "g", i, 7, *b) for i, b in truth], TRUTH)
    return {(r.status, r.prediction_index, r.ground_truth_index, r.iou, r.pred_x1, r.gt_x1) for r in match_predictions(p, g, iou_threshold=threshold, crowd=crowd).collect()}


def wanted(preds, truth, threshold=0.4):
    at_p, at_g = {i: b[0] for i, _, b in preds}, {i: b[0] for i, b in truth}
    return {(s, i, j, v, at_p.get(i), at_g.get(j)) for s, i, j, v in match(preds, truth, threshold)}


def chain(n, seed, ranks="random", wide=1.0):
    """Boxes each of which overlaps the next, so that one pile holds all."""
    r = random.Random(seed)
    truth = [(k, (8.0 * k, 0.0, 8.0 * k + 14 * wide, 10.0)) for k in range(n)]
    conf = {"random": lambda k: r.random(), "along": lambda k: 1 - k / n, "equal": lambda k: 0.5}[ranks]
    preds = [(k, conf(k), (8.0 * k + r.randint(-4, 4), 0.0, 8.0 * k + 14 * wide + r.randint(-4, 4), 10.0)) for k in range(n)]
    return preds, truth


@pytest.mark.parametrize(("n", "crowd", "ranks", "wide"), [(600, 60, "random", 1.0), (150, 60, "along", 1.0), (200, 150, "random", 8.0)])
def test_chains_equal_the_serial_rule(spark, n, crowd, ranks, wide):
    preds, truth = chain(n, 3, ranks, wide)
    assert outcome(spark, preds, truth, crowd) == wanted(preds, truth)


def test_ties_and_lonely_boxes(spark):
    box = (0.0, 0.0, 10.0, 10.0)
    preds = [(k, 0.5, box) for k in range(6)] + [(9, 0.9, (4.0, 0.0, 30.0, 10.0)), (10, 0.1, (5.0, 50.0, 20.0, 60.0))]
    truth = [(k, box) for k in (3, 1, 2)] + [(8, (9.0, 0.0, 31.0, 10.0)), (11, (20.0, 70.0, 40.0, 90.0))]
    assert outcome(spark, preds, truth, 2) == wanted(preds, truth)
    assert outcome(spark, preds, [], 2) == wanted(preds, [])
    assert outcome(spark, [], truth, 2) == wanted([], truth)


def test_a_large_pile_uses_several_tasks(spark, monkeypatch):
    preds, truth = chain(20_000, 5)
    rounds, stripes = [], []
    real = crowds._dealt

    def dealt(*args):
        out = real(*args)
        rounds.append(1)
        if len(rounds) == 1:
            stripes.append(out.filter("side = 1").groupBy("_stripe").agg(F.count("*").alias("n")).collect())
        return out

    monkeypatch.setattr(crowds, "_dealt", dealt)
    assert outcome(spark, preds, truth, 2500) == wanted(preds, truth)
    assert len(stripes[0]) >= 7 and max(r.n for r in stripes[0]) < 5000 and len(rounds) <= 5
