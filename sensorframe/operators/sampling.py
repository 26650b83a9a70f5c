"""Frame sampling, seeded subsets, splits and the linear probe."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..functions.vectors import as_double
from ..runtime import materialize
from .sequence import BUCKET, number_rows

# Categories chosen when the caller names none.
DEFAULT_CATEGORIES = ("person", "car", "truck", "bus", "motorcycle", "bicycle", "airplane")

PROBE_ROWS = 50_000  # vectors a task of the probe adds up in one step


def sample_frames(frames: DataFrame, *, frame_step: int = 1, max_frames: int | None = None) -> DataFrame:
    """Keep listing positions divisible by ``frame_step``, the first ``max_frames`` of them per run.

    Positions are dense, so both rules are one filter on the position itself.
    ``frame_ordinal`` becomes the position among the frames that are kept.
    """
    if frame_step <= 0:
        raise ValueError("frame_step must be positive")
    if max_frames is not None and max_frames <= 0:
        raise ValueError(f"max_frames {max_frames}: want 1 or more, or None")
    position = F.col("frame_ordinal")
    kept = frames.filter(position % frame_step == 0)
    if max_frames is not None:
        kept = kept.filter(position < frame_step * max_frames)
    return kept.withColumn("frame_ordinal", F.floor(position / frame_step).cast("long"))


def timestamp_of(ordinal: Column, fps: float) -> Column:
    """Seconds from the source start; ``ordinal`` counts all listed frames."""
    if fps <= 0:
        raise ValueError(f"fps {fps}: want more than 0")
    return ordinal / F.lit(float(fps))


def order_frames(listing: DataFrame, name: str = "name", run: str = "run_id") -> DataFrame:
    """Dense ``frame_ordinal`` in natural name order per run.

    The total order comes from one range-partitioned sort, stored once because
    sort boundaries are sampled; positions are offsets of (run, partition)
    counts, so no run is numbered in one task.
    """
    keyed = listing.withColumn("_key", natural_key(F.col(name)))
    ordered = materialize(
        keyed.orderBy(run, "_key", name).withColumn("_id", F.monotonically_increasing_id()), "frame-order"
    )
    return number_rows(
        ordered, [run], F.shiftright("_id", 33), [F.col("_id")], "frame_ordinal", start=0
    ).drop("_key", "_id")


@dataclass(frozen=True)
class CocoSubset:
    images: DataFrame
    annotations: DataFrame
    categories: DataFrame

    def counts(self) -> DataFrame:
        """Selected images and annotations as one row."""
        n = self.images.agg(F.count("*").alias("selected_images"))
        return n.crossJoin(self.annotations.agg(F.count("*").alias("selected_annotations")))  # one row each


def category_ids(categories: DataFrame, names: Sequence[str]) -> list[int]:
    """Ids of the requested categories; raises when one is absent.

    Only requested categories are collected, so the list is as long as the request.
    """
    found = categories.filter(F.col("name").isin(*names)).groupBy("name").agg(F.max("id").alias("id")).collect()
    absent = sorted(set(names) - {r["name"] for r in found})
    if absent:
        raise ValueError(f"categories absent from the annotations: {absent}")
    return sorted(r["id"] for r in found)


def eligible_images(images: DataFrame, annotations: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Images with at least one annotation of the chosen categories."""
    wanted = annotations.filter(F.col("category_id").isin(*ids))
    return images.join(wanted.select(F.col("image_id").alias("id")), "id", "left_semi")


def coco_subset(
    images: DataFrame,
    annotations: DataFrame,
    categories: DataFrame,
    *,
    names: Sequence[str] | None = None,
    max_images: int = 2000,
    seed: int = 42,
) -> CocoSubset:
    """Seeded subset of eligible images with their annotations and categories (M1).

    The order is a seeded digest of the image id, so the choice is repeatable
    on any cluster layout; ``limit`` keeps ``max_images`` per task before the
    final merge.
    """
    if max_images <= 0:
        raise ValueError(f"max_images {max_images}: want 1 or more")
    names = list(DEFAULT_CATEGORIES if names is None else names)
    if not names:
        raise ValueError("at least one category is required")
    if len(set(names)) != len(names):
        raise ValueError("categories must be unique")
    ids = category_ids(categories, names)
    picked = materialize(
        eligible_images(images, annotations, ids).orderBy(*seeded_order(seed, "id")).limit(max_images), "subset-images"
    )
    chosen = picked.select(F.col("id").alias("image_id"))
    kept = annotations.filter(F.col("category_id").isin(*ids)).join(chosen, "image_id", "left_semi")
    return CocoSubset(picked, kept, categories.filter(F.col("id").isin(*ids)))


def seeded_order(seed: int, *ids: str) -> list[Column]:
    """Repeatable shuffle: MD5 text of ``seed:id``, then the ids themselves."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids])
    return [F.md5(text.cast("binary")), *[F.col(c) for c in ids]]


def stratified_split(
    df: DataFrame, label: str, ids: Sequence[str], *, test_size: float = 0.30, seed: int = 42
) -> DataFrame:
    """Adds boolean ``is_test``: an exact share of every class, in seeded hash order (M2).

    Ranks are two-level over hash buckets, so a dominant class is spread over tasks.
    """
    if not 0.0 < test_size < 1.0:
        raise ValueError("test_size must be between 0 and 1")
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    small = sizes.filter(F.col("_size") < 2).limit(1).collect()
    if small:
        raise ValueError(f"at least two samples per class are required, see class {small[0][0]!r}")
    order = seeded_order(seed, *ids)
    ranked = number_rows(df, [label], F.substring(order[0], 1, 3), order, "_rank")
    quota = F.greatest(F.lit(1), F.bround(F.col("_size") * test_size, 0).cast("long"))
    return ranked.join(sizes, label).withColumn("is_test", F.col("_rank") <= quota).drop("_rank", "_size")


def every_kth(df: DataFrame, keys: Sequence[str], position: str, k: int) -> DataFrame:
    """Systematic sample: rows 0, k, 2k ... of each key (M4)."""
    if k < 1:
        raise ValueError("k must be positive")
    numbered = number_rows(df, keys, F.floor(F.col(position) / BUCKET), [F.col(position)], "_rn", start=0)
    return numbered.filter(F.col("_rn") % k == 0).drop("_rn")


def linear_probe(
    train: DataFrame, *, label: str = "label", column: str = "embedding", c: float = 0.5, max_iter: int = 50,
    tolerance: float = 1e-4, parallelism: int = 8,
):
    """Standardised one-vs-rest linear SVM on stored vectors (M3); returns an ML pipeline model.

    Regularisation follows the usual C form, ``1 / (C * rows)``.  Standardised
    vectors are stored once; the one-vs-rest fits run concurrently on them.
    """
    features = train.select(F.col(label), array_to_vector(as_double(F.col(column))).alias("_raw"))
    front = Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc"),
            StandardScaler(inputCol="_raw", outputCol="_x", withMean=True, withStd=True),
        ]
    ).fit(features)
    ready = materialize(front.transform(features).select("_y", "_x"), "probe-features")
    rows = ready.count()
    # every step of every fit is a job over all tasks, so their number follows the rows, not files or settings
    ready = ready.coalesce(max(1, math.ceil(rows / PROBE_ROWS)))
    svm = LinearSVC(maxIter=max_iter, tol=tolerance, regParam=1.0 / (c * rows), standardization=False)
    rest = OneVsRest(
        classifier=svm, featuresCol="_x", labelCol="_y", predictionCol="_p", parallelism=parallelism
    ).fit(_with_class_count(ready, len(front.stages[0].labels)))
    return PipelineModel(stages=[*front.stages, rest])


def _with_class_count(ready: DataFrame, classes: int) -> DataFrame:
    """Declare the number of classes in the column's metadata, saving a scan."""
    values = [str(float(i)) for i in range(classes)]
    meta = {"ml_attr": {"type": "nominal", "vals": values, "name": "_y"}}
    return ready.withColumn("_y", F.col("_y").alias("_y", metadata=meta))


def probe_predictions(model, df: DataFrame, *, column: str = "embedding") -> DataFrame:
    """Adds ``predicted`` (label text) to held-out vectors or proposal boxes."""
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    prepared = df.withColumn("_raw", array_to_vector(as_double(F.col(column))))
    for stage in model.stages[1:]:
        prepared = stage.transform(prepared)
    return prepared.withColumn("predicted", F.element_at(labels, F.col("_p").cast("int") + 1)).drop(
        "_raw", "_x", "_p", "rawPrediction"
    )
