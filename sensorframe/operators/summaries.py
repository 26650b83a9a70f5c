"""Run counters, class summaries, frame series, catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import finite_or_null
from .sequence import BUCKET, number_rows

SERIES_POINTS = 240
TOP = 30


def run_counters(
    frames: DataFrame,
    *,
    detections: DataFrame | None = None,
    tracks: DataFrame | None = None,
    representations: DataFrame | None = None,
    anomalies: DataFrame | None = None,
    events: DataFrame | None = None,
    alerts: DataFrame | None = None,
) -> DataFrame:
    """One row of counts per run (A1).

    Each table is reduced to one row per run before the union, and distinct
    tracks are counted over a de-duplicated (run, track) table.
    """
    counts: list[DataFrame] = [
        frames.groupBy("run_id").agg(
            F.count("*").alias("frames_processed"),
            F.min_by("frame_number", "frame_ordinal").alias("first_frame_number"),
            F.max_by("frame_number", "frame_ordinal").alias("last_frame_number"),
        )
    ]

    def per_track(df: DataFrame, rows: str, distinct: str) -> DataFrame:
        small = df.groupBy("run_id", "track_id").agg(F.count("*").alias("_n"))
        return small.groupBy("run_id").agg(F.sum("_n").alias(rows), F.count("track_id").alias(distinct))

    def plain(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("run_id").agg(F.count("*").alias(name))

    if detections is not None:
        counts.append(plain(detections, "detections_emitted"))
    if tracks is not None:
        counts.append(per_track(tracks, "track_observations_emitted", "unique_tracks"))
    if representations is not None:
        counts.append(per_track(representations, "representations_emitted", "represented_tracks"))
    if anomalies is not None:
        counts.append(
            anomalies.groupBy("run_id").agg(
                F.count("*").alias("anomaly_observations_emitted"),
                F.count_if("is_anomaly").alias("anomalies_flagged"),
            )
        )
    if events is not None:
        counts.append(plain(events, "events_emitted"))
    if alerts is not None:
        counts.append(plain(alerts, "alerts_emitted"))
    names = [c for df in counts for c in df.columns if c != "run_id"]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counts)
    zero = F.lit(0)
    return stacked.groupBy("run_id").agg(
        *[
            (F.max(c) if c.endswith("frame_number") else F.coalesce(F.max(c), zero)).alias(c)
            for c in names
        ]
    )


def class_summary(detections: DataFrame, tracks: DataFrame, *, limit: int = TOP) -> DataFrame:
    """Detections, distinct tracks and mean confidence per label, top ``limit`` per run (A2)."""
    label = F.coalesce(F.col("label"), F.lit("unknown")).alias("label")
    found = detections.groupBy("run_id", label).agg(
        F.count("*").alias("detections"),
        F.avg(F.nanvl(F.col("confidence").cast("double"), F.lit(None).cast("double"))).alias("_mean"),
    )
    seen = tracks.groupBy("run_id", label, "track_id").agg(F.count("*").alias("_n"))
    per_label = seen.groupBy("run_id", "label").agg(F.count("track_id").alias("tracks"))
    best = Window.partitionBy("run_id").orderBy(F.col("detections").desc(), "label")
    top = found.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= limit)
    return top.join(per_label, ["run_id", "label"], "left").select(
        "run_id", "label", "detections",
        F.coalesce(F.col("tracks"), F.lit(0)).alias("tracks"),
        finite_or_null(F.col("_mean")).alias("mean_confidence"),
    )


def detections_per_frame(detections: DataFrame) -> DataFrame:
    return detections.groupBy("run_id", "frame_number").agg(F.count("*").alias("detections"))


def frame_stats(per_frame: DataFrame) -> DataFrame:
    """Minimum, maximum and mean detections over the frames that have any (A3)."""
    return per_frame.groupBy("run_id").agg(
        F.min("detections").alias("min"), F.max("detections").alias("max"), F.avg("detections").alias("mean")
    )


def frame_series(per_frame: DataFrame, *, points: int = SERIES_POINTS) -> DataFrame:
    """Every stride-th frame so that at most ``points`` remain per run (A4)."""
    size = per_frame.groupBy("run_id").agg(F.count("*").alias("_n"))
    numbered = number_rows(
        per_frame, ["run_id"], F.floor(F.col("frame_number") / BUCKET), [F.col("frame_number")], "_rn", start=0
    )
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / points))
    return numbered.join(size, "run_id").filter(F.col("_rn") % stride == 0).drop("_rn", "_n")


def tail_rows(df: DataFrame, order: list[Column], limit: int = 200) -> DataFrame:
    """Last ``limit`` rows of a table in its order."""
    n = max(0, limit)
    last = df.orderBy(*[c.desc() for c in order]).limit(n)
    doubles = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    cleaned = last.withColumns({c: finite_or_null(F.col(c)) for c in doubles}) if doubles else last
    return cleaned.orderBy(*order)


def run_catalogue(manifests: DataFrame, *, limit: int = 100, status: str | None = None) -> DataFrame:
    """Newest runs first."""
    chosen = manifests if status is None else manifests.filter(F.col("status") == status)
    return chosen.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(max(0, limit))


def storage_report(listing: DataFrame, category: Column) -> DataFrame:
    """Bytes per run and category with a total (A16), from a file listing."""
    sized = listing.groupBy("run_id", category.alias("category")).agg(
        F.sum("length").alias("bytes"), F.count("*").alias("files")
    )
    total = sized.groupBy("run_id").agg(
        F.lit("total").alias("category"), F.sum("bytes").alias("bytes"), F.sum("files").alias("files")
    )
    return sized.unionByName(total)


def top_classes(df: DataFrame, names: str = "names", probs: str = "probs", k: int = 5) -> DataFrame:
    """The ``k`` most probable classes of each row, ties by position (T5)."""
    ranked = F.zip_with(
        F.transform(F.col(probs), lambda p, i: F.struct((-p).alias("minus"), i.alias("i"))),
        F.col(names),
        lambda p, name: F.struct(p["minus"].alias("minus"), p["i"].alias("i"), name.alias("name")),
    )
    best = F.slice(F.array_sort(ranked), 1, k)
    return df.withColumn(
        "top", F.transform(best, lambda z: F.struct(z["name"].alias("name"), (-z["minus"]).alias("probability")))
    )


def first_per_class(df: DataFrame, label: str, order: list[Column], k: int = 3) -> DataFrame:
    """First ``k`` rows of each class (T5); per-task limits run before the shuffle."""
    by = Window.partitionBy(label).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")
