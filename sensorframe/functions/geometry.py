"""Box arithmetic as Column expressions (whole-stage codegen, no Python)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Box = tuple[Column, Column, Column, Column]


def box(prefix: str = "") -> Box:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def struct_box(column: Column) -> Box:
    return tuple(column[c] for c in ("x1", "y1", "x2", "y2"))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of XYXY boxes; 0.0 when disjoint or degenerate."""
    zero = F.lit(0.0)

    def area(x1, y1, x2, y2):
        return F.greatest(zero, x2.cast("double") - x1) * F.greatest(zero, y2.cast("double") - y1)

    inter = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = area(*a) + area(*b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(zero)


def xywh_to_xyxy(left: Column, top: Column, width: Column, height: Column) -> Box:
    """Corner form with integer truncation after the sum."""
    return (
        left.cast("int"),
        top.cast("int"),
        (left + width).cast("int"),
        (top + height).cast("int"),
    )


def centroid(b: Box) -> tuple[Column, Column]:
    return (b[0] + b[2]) / 2.0, (b[1] + b[3]) / 2.0


def displacement(cx: Column, cy: Column, ox: Column, oy: Column) -> Column:
    return F.hypot(cx - ox, cy - oy)


def invalid_box(b: Box) -> Column:
    return (b[2] <= b[0]) | (b[3] <= b[1])


def crop_window(width: Column, height: Column, b: Box, pad: int, min_size: int) -> Column:
    """Padded box clipped to the frame, or null when a side is below ``min_size``."""
    x1 = F.greatest(F.lit(0), b[0] - pad)
    y1 = F.greatest(F.lit(0), b[1] - pad)
    x2 = F.least(width, b[2] + pad)
    y2 = F.least(height, b[3] + pad)
    big_enough = (x2 - x1 >= min_size) & (y2 - y1 >= min_size)
    return F.when(big_enough, F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2")))


def normalise_raw_boxes(
    raw: DataFrame, names: Mapping[int, str] | None = None, *, detector: str = "raw", model: str | None = None
) -> DataFrame:
    """Model output (float boxes, class ids) to detections clipped to the frame.

    Expects ``class_id``, ``confidence``, ``x1..y2`` and frame ``width``/``height``.
    Rounds half to even, clamps to ``[0, size-1]`` and drops empty boxes.
    """
    class_id = F.col("class_id").cast("int")

    def snap(name: str, size: str) -> Column:
        rounded = F.bround(F.col(name).cast("double"), 0).cast("long")
        return F.greatest(F.lit(0), F.least(F.col(size) - 1, rounded)).cast("int")

    label = class_id.cast("string")
    if names:
        lookup = F.create_map(*[F.lit(v) for kv in sorted(names.items()) for v in kv])
        label = F.coalesce(lookup[class_id], label)
    snapped = raw.select(
        *[c for c in raw.columns if c not in ("class_id", "x1", "y1", "x2", "y2", "label")],
        class_id.alias("class_id"),
        label.alias("label"),
        snap("x1", "width").alias("x1"),
        snap("y1", "height").alias("y1"),
        snap("x2", "width").alias("x2"),
        snap("y2", "height").alias("y2"),
        F.lit(detector).alias("detector"),
        F.lit(model).cast("string").alias("model"),
    )
    return snapped.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def letterbox_geometry(frames: DataFrame) -> DataFrame:
    """Aspect-preserving placement of each frame on its run's canonical canvas.

    The canvas is the first frame's size.  ``min_by`` aggregates it with
    map-side combine, so a run of any length costs one row in the shuffle.
    """
    canvas = frames.groupBy("run_id").agg(
        F.min_by(F.struct("width", "height"), "frame_ordinal").alias("_canvas")
    )
    cw, ch = F.col("canvas_width"), F.col("canvas_height")
    same = (F.col("width") == cw) & (F.col("height") == ch)
    scale = F.least(cw / F.col("width"), ch / F.col("height"))

    def fit(size: str, limit: Column) -> Column:
        rounded = F.bround(F.col(size) * F.col("scale"), 0).cast("int")
        return F.least(limit, F.greatest(F.lit(1), rounded))

    return (
        frames.join(canvas, "run_id")
        .withColumns({"canvas_width": F.col("_canvas.width"), "canvas_height": F.col("_canvas.height")})
        .drop("_canvas")
        .withColumn("normalized", ~same)
        .withColumn("scale", F.when(same, F.lit(1.0)).otherwise(scale))
        .withColumn("resized_width", fit("width", cw))
        .withColumn("resized_height", fit("height", ch))
        .withColumn("x_offset", F.floor((cw - F.col("resized_width")) / 2).cast("int"))
        .withColumn("y_offset", F.floor((ch - F.col("resized_height")) / 2).cast("int"))
    )


def to_canvas(b: Box) -> Box:
    """Source-frame box to canvas coordinates, given ``letterbox_geometry`` columns."""
    sx = F.col("resized_width") / F.col("width")
    sy = F.col("resized_height") / F.col("height")
    return (
        b[0] * sx + F.col("x_offset"),
        b[1] * sy + F.col("y_offset"),
        b[2] * sx + F.col("x_offset"),
        b[3] * sy + F.col("y_offset"),
    )


def from_canvas(b: Box) -> Box:
    """Inverse of :func:`to_canvas`."""
    sx = F.col("resized_width") / F.col("width")
    sy = F.col("resized_height") / F.col("height")
    return (
        (b[0] - F.col("x_offset")) / sx,
        (b[1] - F.col("y_offset")) / sy,
        (b[2] - F.col("x_offset")) / sx,
        (b[3] - F.col("y_offset")) / sy,
    )


def source_dimensions(frames: DataFrame) -> DataFrame:
    """Frames per ``WxH`` and how many differ from the canvas, per run."""
    per_size = (
        letterbox_geometry(frames)
        .groupBy("run_id", F.format_string("%dx%d", F.col("width"), F.col("height")).alias("size"))
        .agg(F.count("*").alias("n"), F.sum(F.col("normalized").cast("long")).alias("changed"))
    )
    return per_size.groupBy("run_id").agg(
        F.sum("n").alias("total_frames"),
        F.sum("changed").alias("normalized_frames"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("size", "n")))).alias("source_dimensions"),
    )
