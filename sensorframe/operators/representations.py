"""Sampled track representations and their change over time."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import box, crop_window
from ..functions.text import label_in
from ..functions.vectors import cosine_scores, norm, unit_vectors
from ..schemas import REPRESENTATIONS, conform
from .sequence import BUCKET, number_rows, previous


def _positive(**values: int) -> None:
    for name, value in values.items():
        if value < 1:
            raise ValueError(f"{name} must be positive")


def check_sampling(min_track_hits: int, sample_every_n_hits: int, max_per_frame: int, pad_px: int, min_crop_size: int) -> None:
    _positive(
        min_track_hits=min_track_hits, sample_every_n_hits=sample_every_n_hits,
        max_per_frame=max_per_frame, min_crop_size=min_crop_size,
    )
    if pad_px < 0:
        raise ValueError(f"pad_px {pad_px}: want 0 or more")


def mature_crops(
    tracks: DataFrame,
    *,
    labels: Iterable[str] | None = None,
    min_track_hits: int = 3,
    pad_px: int = 6,
    min_crop_size: int = 12,
) -> DataFrame:
    """Track observations old enough and large enough to be scored; adds ``crop``.

    No cadence and no cap: this is the admission rule of anomaly scoring.
    Needs the frame ``width`` and ``height``.
    """
    _positive(min_track_hits=min_track_hits, min_crop_size=min_crop_size)
    if pad_px < 0:
        raise ValueError(f"pad_px {pad_px}: want 0 or more")
    return (
        tracks.filter((F.col("hits") >= min_track_hits) & label_in(labels))
        .withColumn("crop", crop_window(F.col("width"), F.col("height"), box(), pad_px, min_crop_size))
        .filter(F.col("crop").isNotNull())
    )


def sample_tracks(
    tracks: DataFrame,
    *,
    labels: Iterable[str] | None = None,
    min_track_hits: int = 3,
    sample_every_n_hits: int = 15,
    max_per_frame: int = 16,
    pad_px: int = 6,
    min_crop_size: int = 12,
    unique_hits: bool = True,
) -> DataFrame:
    """Observations to embed: cadence by hits, then at most ``max_per_frame`` per frame.

    The crop gate comes after the cap, so a crop that is too small uses up a
    slot.  ``unique_hits=False`` repeats nothing for tracks of this package and
    allows foreign tables in which one track shows the same hit count twice;
    then only the earliest such row is a candidate.
    The cap is a ``row_number`` filter, which Spark applies per task before the
    shuffle, so a crowded frame never moves more than the cap per task.
    """
    check_sampling(min_track_hits, sample_every_n_hits, max_per_frame, pad_px, min_crop_size)
    due = tracks.filter(
        (F.col("hits") >= min_track_hits)
        & label_in(labels)
        & ((F.col("hits") - min_track_hits) % sample_every_n_hits == 0)
    )
    if not unique_hits:
        row = F.struct(*due.columns)
        due = (
            due.groupBy("run_id", "track_id", "hits")
            .agg(F.min_by(row, "frame_ordinal").alias("_row"))
            .select("_row.*")
        )
    best = Window.partitionBy("run_id", "frame_ordinal").orderBy(F.col("confidence").desc(), "track_id")
    return (
        due.withColumn("_slot", F.row_number().over(best))
        .filter(F.col("_slot") <= max_per_frame)
        .drop("_slot")
        .withColumn("crop", crop_window(F.col("width"), F.col("height"), box(), pad_px, min_crop_size))
        .filter(F.col("crop").isNotNull())
    )


def representation_changes(sampled: DataFrame, *, source: str = "embedder", bucket: int = BUCKET) -> DataFrame:
    """Representation rows from sampled observations with a raw ``embedding`` column.

    Vectors are L2-normalised; each is compared with the same track's previous
    sample; ``embedding_row`` numbers the rows of a run from 0 in emission order.
    """
    unit = sampled.withColumn("_unit", unit_vectors("embedding"))
    linked = previous(unit, ["run_id", "track_id"], "frame_ordinal", ["_unit"], "_before", bucket)
    rows = change_rows(linked.withColumn("_before", F.col("_before._unit")), source)
    return conform(number_embeddings(rows, bucket=bucket), REPRESENTATIONS)


def change_rows(linked: DataFrame, source: str) -> DataFrame:
    """Measures of unit vectors ``_unit`` against the track's previous one, ``_before`` (null for a first sample)."""
    has_before = F.col("_before").isNotNull()
    # The UDF sees every row of a batch; a first sample is paired with itself.
    partner = F.coalesce("_before", "_unit")
    scored = linked.withColumn("_distance", cosine_scores(F.col("_unit"), partner))
    similarity = F.when(has_before, 1.0 - F.col("_distance"))
    return scored.select(
        *[c for c in scored.columns if c not in ("embedding", "source")],
        F.col("hits").alias("track_hits"),
        F.size("_unit").alias("embedding_dim"),
        norm(F.col("_unit")).alias("embedding_norm"),
        similarity.alias("previous_cosine_similarity"),
        F.when(has_before, F.col("_distance")).alias("representation_change"),
        F.lit(source).alias("source"),
        F.col("_unit").cast("array<float>").alias("embedding"),
    )


def number_embeddings(rows: DataFrame, *, bucket: int = BUCKET) -> DataFrame:
    """0-based ``embedding_row`` per run in (frame, -confidence, track) order."""
    order = [F.col("frame_ordinal"), F.col("confidence").desc(), F.col("track_id")]
    return number_rows(
        rows, ["run_id"], F.floor(F.col("frame_ordinal") / bucket), order, "embedding_row", start=0
    )


def representation_summary(representations: DataFrame) -> DataFrame:
    """Observations, represented tracks and dimension per run.

    Tracks are de-duplicated first, so the distinct count is a second, small
    aggregate rather than a set held per run.
    """
    per_track = representations.groupBy("run_id", "track_id").agg(
        F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim")
    )
    return per_track.groupBy("run_id").agg(
        F.sum("n").alias("observations"),
        F.count("track_id").alias("tracks"),
        F.max("dim").alias("embedding_dim"),
    )
