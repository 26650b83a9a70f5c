"""Greedy matching of one crowded picture by many tasks.

The serial rule visits predictions by rank; each takes the free truth with the highest IoU.  That choice is settled as
soon as no earlier prediction that is still open could take the same truth, because all else that earlier ones take
only thins out the choice.  A truth is taken only if no earlier open prediction overlaps it at all, as it could be the
candidate that one reports.  So every round settles all such predictions at once (deterministic reservations, Blelloch
et al. 2012), and the outcome is the serial one.

What is open of a pile is cut along x into stripes of about equally many truths, until it fits one.  A prediction that reaches truths of one stripe only
is decided there, in one pass by rank: an open prediction *reserves* the truths it could take and *watches* those it
overlaps, and a later one whose best truth is held so stays open itself.  A prediction that reaches several stripes gets the best offer of each, and
is decided between rounds by the best of these if that isn't reserved.  The first open prediction of any chain is
always decided, so rounds end; where ranks don't follow the chain from one end to the other a few do.

Boxes with equal left edges aren't cut, so a pile of copies of one box is one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import materialize
from .handoff import changes

BOX = ["x1", "y1", "x2", "y2"]
NAME = "crowd"
FEW = 1_000


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal; the columns of ``left``, then the others of ``right``."""
    rest = [c for c in right.columns if c not in keys]
    other = right.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *rest)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return left.join(other, same, how).select(*left.columns, *([] if how in ("left_anti", "left_semi") else rest))


def _near(preds: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """The truths that open predictions may overlap, by cells as wide as the widest boxes of the pile."""
    width = F.max(F.col("x2") - F.col("x1"))
    cells = preds.groupBy(*keys).agg(width.alias("_wp")).unionByName(truth.groupBy(*keys).agg(width.alias("_wp")))
    cells = cells.groupBy(*keys).agg(F.max("_wp").alias("_cell"))
    at = _joined(truth, cells, keys).withColumn("_at", F.floor(F.col("x1") / F.col("_cell")))
    asked = _joined(preds, cells, keys).select(*keys, F.explode(F.sequence(F.floor(F.col("x1") / F.col("_cell")) - 1, F.floor(F.col("x2") / F.col("_cell")))).alias("_at"))
    return _joined(at, asked.distinct(), [*keys, "_at"], "left_semi").select(*truth.columns)


def _cuts(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Per pile the left edges at which its stripes begin, and the widest truth; a pile of ``size`` rows isn't cut.

    A pile of up to ``FEW`` rows is cut at its sorted edges, a larger one at approximate quantiles of them.
    """
    truth = F.col("side") == 1
    counted = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max(F.when(truth, F.col("x2") - F.col("x1"))).alias("_widest"))
    lefts = _joined(rows.filter(truth).select(*keys, "x1"), counted.filter(F.col("_n") > size).select(*keys, "_n"), keys)
    few = lefts.filter(F.col("_n") <= FEW).groupBy(*keys).agg(F.sort_array(F.collect_list("x1")).alias("_q"))
    few = few.select(*keys, F.filter("_q", lambda x, i: (i > 0) & (i % size == 0)).alias("_cuts"))
    quantiles = F.percentile_approx("x1", [k / 256 for k in range(1, 256)], 10_000)
    many = lefts.filter(F.col("_n") > FEW).groupBy(*keys).agg(F.max("_n").alias("_n"), quantiles.alias("_q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(256.0) * size / F.col("_n")).cast("int"))
    many = many.select(*keys, F.filter("_q", lambda x, i: (i + 1) % step == 0).alias("_cuts"))
    cut = _joined(counted, few.unionByName(many), keys, "left")
    none = F.array().cast("array<double>")
    return cut.select(*keys, F.coalesce("_widest", F.lit(0.0)).alias("_widest"), F.coalesce(F.array_distinct("_cuts"), none).alias("_cuts"))


def _dealt(preds: DataFrame, truth: DataFrame, keys: list[str], size: int) -> DataFrame:
    """Both sides with their stripe; a prediction is copied to each stripe it may reach (``_spans`` of them)."""
    rows = materialize(preds.unionByName(_near(preds, truth, keys)), f"{NAME}-dealt")
    cut = _joined(rows, _cuts(rows, keys, size), keys)

    def stripe(x):
        return F.size(F.filter("_cuts", lambda c: c <= x))

    is_truth = F.col("side") == 1
    first, last = stripe(F.col("x1") - F.when(is_truth, F.lit(0.0)).otherwise(F.col("_widest"))), stripe(F.when(is_truth, F.col("x1")).otherwise(F.col("x2")))
    return cut.withColumn("_stripe", F.explode(F.sequence(first, last))).withColumn("_spans", last - first + 1).drop("_cuts", "_widest")


class Stripe:
    """The truths of one stripe while its predictions pass by rank."""

    def __init__(self, boxes: np.ndarray, threshold: float):
        self.by_left = np.argsort(boxes[:, 0], kind="stable")
        self.boxes, self.threshold = boxes, threshold
        self.lefts = boxes[self.by_left, 0]
        self.widest = float((boxes[:, 2] - boxes[:, 0]).max()) if len(boxes) else 0.0
        self.areas = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
        self.free, self.reserved, self.watched = np.ones(len(boxes), bool), np.zeros(len(boxes), bool), np.zeros(len(boxes), bool)

    def visit(self, box: np.ndarray, inside: bool) -> tuple[int, float, str]:
        """Position and IoU of the best free truth (-1 if none), and what becomes of the prediction."""
        near = self.by_left[np.searchsorted(self.lefts, box[0] - self.widest) : np.searchsorted(self.lefts, box[2], side="right")]
        near = np.sort(near[self.free[near]])
        q = self.boxes[near]
        w, h = np.minimum(box[2], q[:, 2]) - np.maximum(box[0], q[:, 0]), np.minimum(box[3], q[:, 3]) - np.maximum(box[1], q[:, 1])
        inter = np.clip(w, 0, None) * np.clip(h, 0, None)
        value = inter / ((box[2] - box[0]) * (box[3] - box[1]) + self.areas[near] - inter)
        k = int(value.argmax()) if len(near) else -1
        if k < 0 or value[k] <= 0:
            return -1, 0.0, "settled" if inside else "offer"
        best, top = int(near[k]), float(value[k])
        takes = top >= self.threshold
        held = bool((self.watched if takes else self.reserved)[best])
        if inside and not held:
            if takes:
                self.free[best] = False
            return best, top, "settled"
        self.reserved[near[value >= self.threshold]] = True
        self.watched[near[value > 0]] = True
        return best, top, "open" if inside else ("reserved" if held else "offer")


def _kernel(keys: list[str], columns: list[str], threshold: float, schema: T.StructType):
    out_schema = to_arrow_schema(schema)

    group = [*keys, "_stripe"]

    def several(table: pa.Table, edges: list[int]) -> pa.RecordBatch:
        """All stripes of ``table``; rows are picked by position, so small stripes cost little more than their boxes."""
        sides, spans = table.column("side").to_numpy(), table.column("_spans").to_numpy()
        boxes = np.column_stack([table.column(c).to_numpy() for c in BOX]).astype(np.float64)
        mine, pick, values, told = [], [], [], []
        for lo, hi in zip(edges[:-1], edges[1:]):
            n = lo + int(hi - lo - sides[lo:hi].sum())
            stripe = Stripe(boxes[n:hi], threshold)
            for i in range(lo, n):
                k, value, what = stripe.visit(boxes[i], spans[i] == 1)
                mine.append(i)
                pick.append(n + k if k >= 0 else None)
                values.append(value)
                told.append(what)
        p, g = table.take(pa.array(mine, pa.int64())), pa.array(pick, pa.int64())
        arrays = {f"_p_{c}": p.column(c).combine_chunks() for c in columns} | {f"_g_{c}": table.column(c).combine_chunks().take(g) for c in columns}
        arrays |= {k: p.column(k).combine_chunks() for k in keys}
        arrays |= {"_iou": pa.array(values, pa.float64()), "_told": pa.array(told, pa.string())}
        return pa.RecordBatch.from_arrays([arrays[f.name].cast(f.type) if arrays[f.name].type != f.type else arrays[f.name] for f in out_schema], schema=out_schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if held and len(np.flatnonzero(changes(pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table]), group))) == 1:
                held.append(table)  # all of it belongs to the stripe held
                continue
            table = pa.concat_tables([*held, table]).combine_chunks()
            edges = np.flatnonzero(changes(table, group)).tolist()
            if len(edges) > 1:
                yield several(table.slice(0, edges[-1]), edges)
            held = [table.slice(edges[-1])]
        if held:
            table = pa.concat_tables(held).combine_chunks()
            yield several(table, [0, table.num_rows])

    return scan


def match_crowd(rows: DataFrame, keys: list[str], threshold: float, size: int) -> DataFrame:
    """Matches of the piles ``keys`` in ``rows`` (``side``, ``rank``, ``index``, box and further columns).

    Returns the columns of ``rows`` twice, as ``_p_*`` of the prediction and ``_g_*`` of the truth (null where there is
    none), with ``keys``, ``_iou`` and ``_told`` of ``settled`` (a prediction and its best free truth) or ``missed`` (a
    truth without a prediction).
    """
    columns = [c for c in rows.columns if c not in keys]
    fields = {f.name: f.dataType for f in rows.schema}
    schema = T.StructType([*(T.StructField(k, fields[k]) for k in keys), *(T.StructField(f"_{s}_{c}", fields[c]) for s in "pg" for c in columns), T.StructField("_iou", T.DoubleType()), T.StructField("_told", T.StringType())])
    stored = materialize(rows, f"{NAME}-rows")
    preds, truth, done, round_no = stored.filter("side = 0"), stored.filter("side = 1"), [], 0
    while True:
        round_no += 1
        laid = _dealt(preds, truth, keys, size).repartition(*keys, "_stripe").sortWithinPartitions(*keys, "_stripe", "side", "rank", "index")
        told = materialize(laid.mapInArrow(_kernel(keys, columns, threshold, schema), schema), f"{NAME}-round{round_no}", partition_by=["_told"])
        offers = told.filter("_told IN ('offer', 'reserved')")
        best = F.max_by(F.struct(*offers.columns), F.struct("_iou", (-F.coalesce("_g_index", F.lit(0))).alias("_first")))
        agreed = offers.groupBy(*keys, "_p_index").agg(best.alias("_b")).select("_b.*").filter("_told = 'offer'").withColumn("_told", F.lit("settled"))
        settled = materialize(told.filter("_told = 'settled'").unionByName(agreed), f"{NAME}-settled{round_no}")
        done.append(settled)
        taken = settled.filter(F.col("_iou") >= threshold)
        row = [*keys, "index"]
        preds = _joined(preds, settled.select(*keys, F.col("_p_index").alias("index")), row, "left_anti")
        truth = _joined(truth, taken.select(*keys, F.col("_g_index").alias("index")), row, "left_anti")
        preds, truth = materialize(preds, f"{NAME}-open"), materialize(truth, f"{NAME}-free")
        if preds.isEmpty():
            break
    done.append(truth.select(*keys, *[F.lit(None).cast(fields[c]).alias(f"_p_{c}") for c in columns], *[F.col(c).alias(f"_g_{c}") for c in columns], F.lit(None).cast("double").alias("_iou"), F.lit("missed").alias("_told")))
    return reduce(DataFrame.unionByName, done)
