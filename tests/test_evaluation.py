import random

import pytest

from sensorframe.operators.contracts import ContractError
from sensorframe.operators.evaluation import evaluate, match_predictions
from sensorframe.plans.pipelines import evaluate_runs
from tests.plain import match

PRED = "run_id string, frame_number bigint, label string, confidence double, x1 int, y1 int, x2 int, y2 int"
TRUTH = "run_id string, frame_index bigint, target_id bigint, label string, ignored boolean, x1 int, y1 int, x2 int, y2 int"


def square(a, b):
    return (a, a, b, b)


@pytest.fixture(scope="module")
def tables(spark):
    p = [("r", f, label, c, *square(a, a + 10)) for f, label, c, a in [
        (1, "person", 0.9, 0), (1, "person", 0.7, 0), (1, "motorcycle", 0.8, 20), (2, "car", 0.6, 40),
        (1, "sports ball", 0.5, 60)]]
    g = [("r", f, t, label, ignored, *square(a, a + 10)) for f, t, label, ignored, a in [
        (1, 101, "pedestrian", False, 0), (1, 102, "motor", False, 20), (2, 103, "bicycle", False, 5),
        (2, 104, "van", False, 70), (2, 105, "pedestrian", True, 80)]]
    return spark.createDataFrame(p, PRED), spark.createDataFrame(g, TRUTH)


def test_shared_class_evaluation(tables):
    result = evaluate(*tables)
    by_class = {r.shared_class: r for r in result.class_metrics.collect()}
    assert set(by_class) == {"person", "bicycle", "motor", "car", "truck", "bus"}
    person = by_class["person"]
    assert (person.true_positive, person.false_positive, person.false_negative) == (1, 1, 0)
    assert (person.precision, person.recall) == (0.5, 1.0)
    assert (by_class["motor"].true_positive, by_class["bicycle"].false_negative) == (1, 1)
    assert by_class["bicycle"].recall == 0.0 and by_class["car"].precision == 0.0
    assert by_class["truck"].precision is None and by_class["truck"].f1 is None
    total = result.overall.first()
    assert (total.true_positive, total.false_positive, total.false_negative) == (2, 2, 1)
    assert total.precision == 0.5 and total.recall == pytest.approx(2 / 3)
    counts = result.counts.first()
    assert (counts.ground_truth_ignored, counts.predictions_out_of_ontology, counts.evaluable_frames) == (1, 1, 2)
    labels = {(r.kind, r.label): r.rows for r in result.label_counts.collect()}
    assert labels == {("excluded_prediction", "sports ball"): 1, ("excluded_ground_truth", "van"): 1,
                      ("ignored_ground_truth", "pedestrian"): 1}


@pytest.mark.parametrize("crowd", [10**6, 3])
def test_random_frames_match_serial_statement(spark, crowd):
    rng = random.Random(crowd)
    preds, truth = [], []
    for frame in range(40):
        big = frame % 10 == 0
        for k in range(rng.randrange(0, 30 if big else 6)):
            x = rng.randrange(0, 900 if big else 40)
            preds.append(("r", frame, "car", f"p{k}", frame * 100 + k, rng.choice([0.2, 0.5, 0.9]), float(x), 0.0, x + 20.0, 20.0))
        for k in range(rng.randrange(0, 30 if big else 6)):
            x = rng.randrange(0, 900 if big else 40, 3)
            truth.append(("r", frame, "car", f"g{k}", frame * 100 + k, k, float(x), 0.0, x + 20.0, 20.0))
    p = spark.createDataFrame(preds, "run_id string, frame_number bigint, shared_class string, label string, prediction_index bigint, confidence double, x1 double, y1 double, x2 double, y2 double")
    g = spark.createDataFrame(truth, "run_id string, frame_number bigint, shared_class string, label string, ground_truth_index bigint, target_id bigint, x1 double, y1 double, x2 double, y2 double")
    got = {(r.frame_number, r.status, r.prediction_index, r.ground_truth_index, r.iou)
           for r in match_predictions(p, g, iou_threshold=0.4, crowd=crowd).collect()}
    want = set()
    for frame in range(40):
        rows = match([(r[4], r[5], r[6:]) for r in preds if r[1] == frame],
                     [(r[4], r[6:]) for r in truth if r[1] == frame], 0.4)
        want |= {(frame, s, i, j, v) for s, i, j, v in rows}
    assert got == want


def test_invalid_inputs(spark, tables):
    p, g = tables
    with pytest.raises(ContractError):
        evaluate(p.drop("confidence"), g)
    with pytest.raises(ValueError):
        evaluate(p, g, iou_threshold=0.0)
    flat = spark.createDataFrame([("r", 1, "car", 0.5, 5, 5, 5, 9)], PRED)
    with pytest.raises(Exception, match="invalid XYXY box"):
        evaluate(flat, g).matches.collect()


def test_scope_gate(spark, tables):
    runs = spark.createDataFrame([("r", None)], "run_id string, ground_truth_scope string")
    with pytest.raises(ContractError):
        evaluate_runs(*tables, runs)
    ok = spark.createDataFrame([("r", "processed_frames")], "run_id string, ground_truth_scope string")
    assert evaluate_runs(*tables, ok).overall.first().true_positive == 2
