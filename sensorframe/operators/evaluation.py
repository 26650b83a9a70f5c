"""Detector evaluation against ground truth at one fixed IoU threshold.

Matching is greedy per ``(run, frame, class)``.  Rows of both populations are
sorted into these groups by one shuffle and matched from Arrow batches; the
metrics on top are ordinary aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.geometry import Box, box, invalid_box
from ..functions.ontology import (
    SHARED_CLASSES,
    shared_class_of_ground_truth,
    shared_class_of_prediction,
)
from ..functions.text import truthy
from ..runtime import materialize
from ..schemas import MATCH_COLUMNS
from .contracts import require_columns
from .crowds import match_crowd
from .handoff import changes
from .sequence import number_rows

# Column and metric names of the result tables
PREDICTION_COLUMNS = ("frame_number", "label", "confidence", "x1", "y1", "x2", "y2")
GROUND_TRUTH_COLUMNS = ("frame_index", "label", "ignored", "x1", "y1", "x2", "y2")
_GROUP = ["run_id", "frame_number", "shared_class"]
_BOX = ["x1", "y1", "x2", "y2"]
CROWD = 50_000


@dataclass(frozen=True)
class Evaluation:
    """Result tables of one evaluation."""

    matches: DataFrame
    class_metrics: DataFrame
    overall: DataFrame
    counts: DataFrame
    label_counts: DataFrame
    excluded_predictions: DataFrame
    excluded_ground_truth: DataFrame


def _numeric_boxes(df: DataFrame) -> DataFrame:
    """Doubles (ANSI cast raises on text) and a hard error on an empty box."""
    b: Box = box()
    checked = df.withColumns({c: F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")})
    broken = F.raise_error(F.format_string("invalid XYXY box in run %s frame %s", F.col("run_id"), F.col("frame_number")))
    return checked.withColumn("x1", F.when(invalid_box(b), broken.cast("double")).otherwise(F.col("x1")))


def invalid_boxes(df: DataFrame, limit: int = 5) -> DataFrame:
    """First rows that break the box contract."""
    return df.filter(invalid_box(box())).limit(limit)


def _indexed(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Use the table's own row index, else number rows per run by frame."""
    if name in df.columns:
        return df
    return number_rows(
        df, ["run_id"], F.floor(F.col("frame_number") / 256), [F.col(c) for c in order], name, start=0
    )


def prepare_predictions(predictions: DataFrame) -> DataFrame:
    require_columns(predictions, PREDICTION_COLUMNS, "predictions")
    typed = _numeric_boxes(
        predictions.withColumn("frame_number", F.col("frame_number").cast("long"))
        .withColumn("confidence", F.col("confidence").cast("double"))
    )
    order = ["frame_number"] + (["detection_index"] if "detection_index" in typed.columns else
                                ["confidence", "label", "x1", "y1", "x2", "y2"])
    return _indexed(typed, "prediction_index", order).withColumn(
        "shared_class", shared_class_of_prediction(F.col("label"))
    )


def prepare_ground_truth(ground_truth: DataFrame) -> DataFrame:
    require_columns(ground_truth, GROUND_TRUTH_COLUMNS, "ground truth")
    typed = _numeric_boxes(ground_truth.withColumn("frame_number", F.col("frame_index").cast("long")))
    if "target_id" not in typed.columns:
        typed = typed.withColumn("target_id", F.lit(None).cast("long"))
    order = ["frame_number", "target_id", "label", "x1", "y1", "x2", "y2"]
    return _indexed(typed, "ground_truth_index", order).withColumns(
        {"ignored_flag": truthy(F.col("ignored")), "shared_class": shared_class_of_ground_truth(F.col("label"))}
    )


def restrict_to_frames(ground_truth: DataFrame, frames: DataFrame) -> DataFrame:
    """Ground truth of processed frames only."""
    chosen = frames.select("run_id", F.col("frame_number").alias("frame_index"))
    return ground_truth.join(chosen, ["run_id", "frame_index"], "left_semi")


def _sides(predictions: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """Both populations in one table: ``side`` 0 predictions, 1 truth, with the order each is visited in."""
    p = predictions.select(
        *_GROUP, F.lit(0).alias("side"), (-F.col("confidence")).alias("rank"), F.col("prediction_index").alias("index"),
        F.col("label"), F.col("confidence"), F.lit(None).cast("long").alias("target_id"), *_BOX,
    )
    g = ground_truth.select(
        *_GROUP, F.lit(1).alias("side"), F.lit(0.0).alias("rank"), F.col("ground_truth_index").alias("index"),
        F.col("label"), F.lit(None).cast("double").alias("confidence"), F.col("target_id").cast("long"), *_BOX,
    )
    return p.unionByName(g)


def _with_piles(rows: DataFrame, cell: float = 256.0) -> DataFrame:
    """Split frames into piles of boxes that overlap along x.

    A row opens a pile when no row left of it reaches past its left edge, so
    boxes of different piles have IoU 0.  The running maximum is two-level over
    x cells, so one crowded frame is spread over tasks.
    """
    key = [*_GROUP, "_cell"]
    cut = rows.withColumn("_cell", F.floor(F.col("x1") / cell))
    inside = Window.partitionBy(*key).orderBy("x1", "x2").rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*_GROUP).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    ends = cut.groupBy(*key).agg(F.max("x2").alias("_end"))
    ends = ends.select(*key, F.max("_end").over(across).alias("_before"))
    reach = F.greatest(F.max("x2").over(inside), F.col("_before"))
    opened = cut.join(ends, key).withColumn("_reach", reach).withColumn(
        "_open", F.when(F.col("_reach").isNull() | (F.col("_reach") <= F.col("x1")), F.col("x1"))
    ).drop("_reach", "_before")
    last = opened.groupBy(*key).agg(F.max("_open").alias("_last"))
    last = last.select(*key, F.max("_last").over(across).alias("_carried"))
    # by range: boxes with one left edge share a pile, whichever of them this sort has first
    upto = Window.partitionBy(*key).orderBy("x1").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return opened.join(last, key).withColumn(
        "_pile", F.coalesce(F.max("_open").over(upto), F.col("_carried"))
    ).drop("_cell", "_open", "_carried")


def _pair_up(boxes: np.ndarray, n: int, threshold: float) -> list[tuple[int, int, float, bool]]:
    """Greedy choice in one pile: the first ``n`` boxes are predictions in visiting order, the rest truth by index.

    Returns (prediction, truth or -1, IoU, hit) with positions in ``boxes``.
    """
    p, g = boxes[:n], boxes[n:]
    if len(g) == 0:
        return [(i, -1, 0.0, False) for i in range(n)]
    area_p = (p[:, 2] - p[:, 0]) * (p[:, 3] - p[:, 1])
    area_g = (g[:, 2] - g[:, 0]) * (g[:, 3] - g[:, 1])
    out = []
    if len(p) * len(g) <= 64:
        free = list(range(len(g)))
        rows_p, rows_g = p.tolist(), g.tolist()
        sizes_p, sizes_g = area_p.tolist(), area_g.tolist()
        for i, (x1, y1, x2, y2) in enumerate(rows_p):
            best, value = -1, 0.0
            for k in free:
                q = rows_g[k]
                w = min(x2, q[2]) - max(x1, q[0])
                h = min(y2, q[3]) - max(y1, q[1])
                if w > 0 and h > 0:
                    v = w * h / (sizes_p[i] + sizes_g[k] - w * h)
                    if v > value:
                        best, value = k, v
            hit = best >= 0 and value >= threshold
            if hit:
                free.remove(best)
            out.append((i, n + best if best >= 0 else -1, value, hit))
        return out
    by_left = np.argsort(g[:, 0], kind="stable")
    lefts, widest = g[by_left, 0], float((g[:, 2] - g[:, 0]).max())
    free = np.ones(len(g), dtype=bool)
    lows = np.searchsorted(lefts, p[:, 0] - widest)
    highs = np.searchsorted(lefts, p[:, 2], side="right")
    for i in range(n):
        near = by_left[lows[i]:highs[i]]
        near = np.sort(near[free[near]])
        q = g[near]
        w = np.minimum(p[i, 2], q[:, 2]) - np.maximum(p[i, 0], q[:, 0])
        h = np.minimum(p[i, 3], q[:, 3]) - np.maximum(p[i, 1], q[:, 1])
        inter = np.clip(w, 0, None) * np.clip(h, 0, None)
        value = inter / (area_p[i] + area_g[near] - inter)
        k = int(value.argmax()) if len(near) else -1
        if k < 0 or value[k] <= 0:
            out.append((i, -1, 0.0, False))
            continue
        hit = bool(value[k] >= threshold)
        if hit:
            free[near[k]] = False
        out.append((i, n + int(near[k]), float(value[k]), hit))
    return out


def _match_kernel(threshold: float, schema: T.StructType):
    out_schema = to_arrow_schema(schema)
    keys = [*_GROUP, "_pile"]

    def match(table: pa.Table, edges: list[int]) -> pa.RecordBatch:
        """All piles of ``table``; output rows are picked by position, so columns are never unpacked."""
        boxes = np.column_stack([table.column(c).to_numpy() for c in _BOX])
        sides = table.column("side").to_numpy()
        left, right, values, status = [], [], [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            n = int(hi - lo - sides[lo:hi].sum())
            taken = set()
            for i, k, value, hit in _pair_up(boxes[lo:hi], n, threshold):
                left.append(lo + i)
                right.append(lo + k if k >= 0 else None)
                values.append(value)
                status.append("TP" if hit else "FP")
                if hit:
                    taken.add(k)
            for k in range(n, hi - lo):
                if k not in taken:
                    left.append(None)
                    right.append(lo + k)
                    values.append(None)
                    status.append("FN")
        p, g = pa.array(left, pa.int64()), pa.array(right, pa.int64())
        either = pc.coalesce(p, g)

        def pick(column: str, where: pa.Array) -> pa.Array:
            return table.column(column).combine_chunks().take(where)

        columns = {c: pick(c, either) for c in _GROUP}
        columns |= {"status": pa.array(status), "iou": pa.array(values, pa.float64())}
        columns |= {f"prediction_{c}": pick(c, p) for c in ("index", "label", "confidence")}
        columns |= {f"ground_truth_{c}": pick(c, g) for c in ("index", "label", "target_id")}
        columns |= {f"pred_{c}": pick(c, p) for c in _BOX}
        columns |= {f"gt_{c}": pick(c, g) for c in _BOX}
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in out_schema], schema=out_schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()
            edges = np.flatnonzero(changes(table, keys)).tolist()
            if len(edges) > 1:
                yield match(table.slice(0, edges[-1]), edges)
            held = [table.slice(edges[-1])]
        if held:
            yield match(held[0], [0, held[0].num_rows])

    return scan


def match_predictions(
    predictions: DataFrame, ground_truth: DataFrame, *, iou_threshold: float = 0.50, crowd: int = CROWD
) -> DataFrame:
    """Greedy TP / FP / FN rows (W8) from prepared, in-ontology tables.

    Predictions in (-confidence, index) order each look at the still unmatched
    ground truth with the strictly highest IoU (ties: lowest index).  A false
    positive keeps the columns and IoU of that best candidate.

    One shuffle brings a frame's boxes of one class together.  A frame is one
    picture, so groups are small; groups above ``crowd`` rows are found by a
    count first and cut into independent piles before they are matched.  A pile
    above ``crowd`` rows is matched by several tasks (:mod:`.crowds`).
    """
    if not 0 < iou_threshold <= 1:
        raise ValueError(f"iou_threshold {iou_threshold} lies outside (0, 1]")
    rows = _sides(predictions, ground_truth)
    full = rows.groupBy(*_GROUP).agg(F.count("*").alias("_n")).filter(F.col("_n") > crowd).select(*_GROUP)
    piled, heaped = rows.withColumn("_pile", F.lit(0.0)), None
    if not full.isEmpty():
        crowded = materialize(full, "crowded-frames")
        split = materialize(_with_piles(rows.join(crowded, _GROUP, "left_semi")), "crowded-piles")
        key = [*_GROUP, "_pile"]
        large = materialize(split.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > crowd).select(*key), "large-piles")
        piled = piled.join(crowded, _GROUP, "left_anti").unionByName(split.join(large, key, "left_anti"))
        if not large.isEmpty():
            heaped = match_crowd(split.join(large, key, "left_semi"), key, float(iou_threshold), crowd)
    types = {**{f.name: f.dataType for f in rows.schema}, "status": T.StringType(), "iou": T.DoubleType()}

    def type_of(name: str) -> T.DataType:
        for prefix in ("prediction_", "ground_truth_", "pred_", "gt_"):
            if name.startswith(prefix):
                return types[name[len(prefix):]]
        return types[name]

    schema = T.StructType([T.StructField(c, type_of(c)) for c in MATCH_COLUMNS])
    order = [*_GROUP, "_pile", "side", "rank", "index"]
    laid_out = piled.repartition(*_GROUP, "_pile").sortWithinPartitions(*order)
    matched = laid_out.mapInArrow(_match_kernel(float(iou_threshold), schema), schema)
    if heaped is None:
        return matched
    status = F.when(F.col("_told") == "missed", "FN").when(F.col("_iou") >= iou_threshold, "TP").otherwise("FP")
    given = {"status": status, "iou": F.col("_iou"), **{c: F.col(c) for c in _GROUP}}
    for side, prefixes in (("p", ("prediction_", "pred_")), ("g", ("ground_truth_", "gt_"))):
        given |= {c: F.col(f"_{side}_{c.removeprefix(x)}") for x in prefixes for c in MATCH_COLUMNS if c.startswith(x)}
    return matched.unionByName(heaped.select(*[given[f.name].cast(f.dataType).alias(f.name) for f in schema]))


def _ratios(df: DataFrame) -> DataFrame:
    tp, fp, fn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative"))
    p, r = F.col("precision"), F.col("recall")
    return (
        df.withColumn("precision", F.try_divide(tp, tp + fp))
        .withColumn("recall", F.try_divide(tp, tp + fn))
        .withColumn("f1", F.when(p + r == 0, F.lit(0.0)).otherwise(2 * p * r / (p + r)))
    )


def _class_grid(runs: DataFrame) -> DataFrame:
    classes = F.explode(F.array(*[F.lit(c) for c in SHARED_CLASSES]))
    return runs.select("run_id", classes.alias("shared_class"))


def class_metrics(matches: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """Per run and class counts and ratios (A7); every class of the ontology is present.

    Prediction and ground-truth totals follow from the statuses: every
    evaluated prediction is a TP or FP row, every evaluated truth a TP or FN row.
    """
    is_tp = F.col("status") == "TP"
    counted = matches.groupBy("run_id", "shared_class").agg(
        F.count_if(is_tp).alias("true_positive"),
        F.count_if(F.col("status") == "FP").alias("false_positive"),
        F.count_if(F.col("status") == "FN").alias("false_negative"),
        F.sum(F.when(is_tp, F.col("iou"))).alias("matched_iou_sum"),
    )
    grid = _class_grid(matches.select("run_id").distinct() if runs is None else runs.select("run_id").distinct())
    zero = {c: 0 for c in ("true_positive", "false_positive", "false_negative")}
    filled = grid.join(counted, ["run_id", "shared_class"], "left").na.fill(zero)
    return _ratios(
        filled.withColumn("predictions", F.col("true_positive") + F.col("false_positive")).withColumn(
            "ground_truth", F.col("true_positive") + F.col("false_negative")
        )
    ).withColumn("mean_matched_iou", F.try_divide("matched_iou_sum", "true_positive"))


def overall_metrics(per_class: DataFrame) -> DataFrame:
    """Micro totals over all classes of each run."""
    sums = ["true_positive", "false_positive", "false_negative", "matched_iou_sum"]
    total = per_class.groupBy("run_id").agg(*[F.sum(c).alias(c) for c in sums])
    return (
        _ratios(total)
        .withColumn("mean_matched_iou", F.try_divide("matched_iou_sum", "true_positive"))
        .drop("matched_iou_sum")
    )


def population_counts(predictions: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """Sizes of the evaluated, ignored and out-of-ontology populations (A10), per run.

    Both tables are reduced to one row per (run, frame) before they meet.
    """
    in_scope = F.col("shared_class").isNotNull()
    kept = ~F.col("ignored_flag")
    p = predictions.groupBy("run_id", "frame_number").agg(
        F.count("*").alias("predictions_total"), F.count_if(in_scope).alias("predictions_evaluated")
    )
    g = ground_truth.groupBy("run_id", "frame_number").agg(
        F.count("*").alias("ground_truth_total"),
        F.count_if(~kept).alias("ground_truth_ignored"),
        F.count_if(kept & in_scope).alias("ground_truth_evaluated"),
        F.count_if(kept & ~in_scope).alias("ground_truth_out_of_ontology"),
    )
    names = [c for df in (p, g) for c in df.columns if c not in ("run_id", "frame_number")]
    per_frame = (
        p.unionByName(g, allowMissingColumns=True)
        .groupBy("run_id", "frame_number")
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    )
    used = (F.col("predictions_evaluated") + F.col("ground_truth_evaluated")) > 0
    frame = F.when(used, F.col("frame_number"))
    return (
        per_frame.groupBy("run_id")
        .agg(
            *[F.sum(c).alias(c) for c in names],
            F.count(frame).alias("evaluable_frames"),
            F.min(frame).alias("first_evaluable_frame"),
            F.max(frame).alias("last_evaluable_frame"),
        )
        .withColumn(
            "predictions_out_of_ontology", F.col("predictions_total") - F.col("predictions_evaluated")
        )
    )


def excluded_label_counts(predictions: DataFrame, ground_truth: DataFrame) -> DataFrame:
    """Raw label counts of out-of-ontology predictions / truth and ignored truth."""
    outside = F.col("shared_class").isNull()
    parts = [
        predictions.filter(outside).select("run_id", F.lit("excluded_prediction").alias("kind"), "label"),
        ground_truth.select(
            "run_id",
            F.when(F.col("ignored_flag"), F.lit("ignored_ground_truth"))
            .when(outside, F.lit("excluded_ground_truth"))
            .alias("kind"),
            "label",
        ).filter(F.col("kind").isNotNull()),
    ]
    return parts[0].unionByName(parts[1]).groupBy("run_id", "kind", "label").agg(F.count("*").alias("rows"))


def evaluate(predictions: DataFrame, ground_truth: DataFrame, *, iou_threshold: float = 0.50) -> Evaluation:
    """Full evaluation of raw prediction and ground-truth tables, many runs at once.

    Matches feed every metric and the match table itself, so they are stored once.
    """
    p, g = prepare_predictions(predictions), prepare_ground_truth(ground_truth)
    inside = F.col("shared_class").isNotNull()
    kept = g.filter(~F.col("ignored_flag"))
    matches = materialize(
        match_predictions(p.filter(inside), kept.filter(inside), iou_threshold=iou_threshold), "matches"
    )
    runs = p.select("run_id").unionByName(g.select("run_id")).distinct()
    per_class = class_metrics(matches, runs)
    return Evaluation(
        matches=matches,
        class_metrics=per_class,
        overall=overall_metrics(per_class),
        counts=population_counts(p, g),
        label_counts=excluded_label_counts(p, g),
        excluded_predictions=p.filter(~inside),
        excluded_ground_truth=kept.filter(~inside),
    )


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per label."""
    counts = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    hit = F.col("t") == F.col("p")
    by_truth = counts.groupBy(F.col("t").alias("label")).agg(
        F.sum("n").alias("support"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("true_positive")
    )
    by_guess = counts.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    joined = by_truth.join(by_guess, "label", "full").na.fill(0)
    precision = F.coalesce(F.try_divide("true_positive", "predicted"), F.lit(0.0))
    recall = F.coalesce(F.try_divide("true_positive", "support"), F.lit(0.0))
    scored = joined.withColumn("precision", precision).withColumn("recall", recall)
    total = F.col("precision") + F.col("recall")
    f1 = F.when(total == 0, F.lit(0.0)).otherwise(2 * F.col("precision") * F.col("recall") / total)
    return scored.select("label", "precision", "recall", f1.alias("f1"), "support")


def confusion_matrix(df: DataFrame, truth: str, predicted: str, labels: list | None = None) -> DataFrame:
    """Label by prediction counts; pass ``labels`` to skip the extra scan for them."""
    pivot = df.groupBy(F.col(truth).alias("label")).pivot(predicted, labels)
    return pivot.agg(F.count(F.lit(1))).na.fill(0)


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(
        F.count("*").alias("rows"),
        F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"),
    )
