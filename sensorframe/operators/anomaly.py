"""Normal-centroid anomaly model: fit, score, compare distributions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sorted_json
from ..functions.vectors import as_double, cosine_to
from ..runtime import materialize
from ..schemas import ANOMALIES, REFERENCE, conform
from .quantiles import exact_quantile
from .representations import mature_crops

SOURCE = "track_crop_normal_centroid"
FORMAT_VERSION = 1


def centroid_of(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """Element-wise mean of the raw vectors and their count, as one row.

    ``Summarizer`` keeps one buffer of the vector's size per task.
    """
    vector = array_to_vector(as_double(F.col(column)))
    return embeddings.agg(Summarizer.mean(vector).alias("_mean"), F.count("*").alias("sample_count")).select(
        vector_to_array(F.col("_mean")).alias("centroid"), "sample_count"
    )


def centroid_distances(embeddings: DataFrame, centroid: list[float], column: str = "embedding") -> DataFrame:
    """Adds ``score``: cosine distance to one centroid (a vector of the model's dimension)."""
    if not any(centroid) or not np.isfinite(centroid).all():
        raise ValueError("the centroid is not finite or has zero length")
    return embeddings.withColumn("score", cosine_to(centroid)(F.col(column)))


def fit_reference(
    embeddings: DataFrame,
    *,
    embedder_name: str,
    quantile: float = 0.95,
    column: str = "embedding",
    metadata: Mapping[str, str] | None = None,
) -> DataFrame:
    """Fit centroid and threshold on normal embeddings; returns one row.

    Two scans: mean, then distances (8 bytes per row, stored once).  Only the
    centroid itself and the threshold visit the driver.
    """
    if not 0.0 < quantile < 1.0:
        raise ValueError(f"quantile {quantile} lies outside (0, 1)")
    if not embedder_name:
        raise ValueError("embedder_name cannot be empty")
    spark = embeddings.sparkSession
    centre = centroid_of(embeddings, column).first()
    if centre.sample_count < 2:
        raise ValueError(f"{centre.sample_count} normal vectors given; a threshold needs two or more")
    scores = materialize(centroid_distances(embeddings, centre.centroid, column).select("score"), "scores")
    threshold = exact_quantile(scores, "score", quantile, centre.sample_count)
    row = (
        FORMAT_VERSION, embedder_name, list(centre.centroid), len(centre.centroid), float(threshold),
        centre.sample_count, float(quantile), dict(metadata or {}),
    )
    return spark.createDataFrame([row], REFERENCE)


def check_reference(reference: DataFrame) -> dict:
    """The single reference row after checking its contract."""
    rows = reference.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a reference holds exactly one row")
    r = rows[0].asDict()
    problems = {
        "unsupported reference format version": r["format_version"] != FORMAT_VERSION,
        "embedder_name cannot be empty": not r["embedder_name"],
        "centroid must be a non-empty vector": not r["centroid"],
        "threshold cannot be negative": r["threshold"] < 0,
        "sample_count must be positive": r["sample_count"] < 1,
        "quantile must be between 0 and 1": not 0.0 < r["quantile"] < 1.0,
        "embedding dimension is inconsistent": len(r["centroid"] or []) != r["embedding_dim"],
    }
    for message, broken in problems.items():
        if broken:
            raise ValueError(message)
    return r


def score_anomalies(
    tracks: DataFrame,
    reference: DataFrame,
    *,
    embedder_name: str,
    labels: Iterable[str] | None = None,
    min_track_hits: int = 3,
    pad_px: int = 6,
    min_crop_size: int = 12,
    source: str = SOURCE,
) -> DataFrame:
    """Score mature track observations (with an ``embedding``) against a reference.

    Stateless: works on batch tables and on streams.  The reference is one row
    of fixed size, so its centroid travels as a literal and nothing is joined.
    """
    ref = check_reference(reference)
    if ref["embedder_name"] != embedder_name:
        raise ValueError(f"reference embedder {ref['embedder_name']!r} does not match {embedder_name!r}")
    admitted = mature_crops(
        tracks, labels=labels, min_track_hits=min_track_hits, pad_px=pad_px, min_crop_size=min_crop_size
    )
    threshold = F.lit(ref["threshold"])
    scored = centroid_distances(admitted, ref["centroid"])
    return conform(
        scored.select(
            *[c for c in scored.columns if c not in ("source", "embedding")],
            threshold.alias("threshold"),
            (F.col("score") - threshold).alias("margin"),
            (F.col("score") > threshold).alias("is_anomaly"),
            F.lit(source).alias("source"),
            sorted_json(
                embedder=F.lit(ref["embedder_name"]),
                reference_samples=F.lit(ref["sample_count"]),
                reference_quantile=F.lit(ref["quantile"]),
                track_hits=F.col("hits"),
            ).alias("metadata"),
        ),
        ANOMALIES,
    )


def score_distribution(normal: DataFrame, probe: DataFrame, *, quantile: float = 0.95, column: str = "embedding"):
    """Median distance of a normal and a probe set, and the normal threshold."""
    spark = normal.sparkSession
    centre = centroid_of(normal, column).first()
    rows = []
    stored = {
        name: materialize(centroid_distances(df, centre.centroid, column).select("score"), "scores")
        for name, df in (("normal", normal), ("probe", probe))
    }
    threshold = exact_quantile(stored["normal"], "score", quantile)
    for name, scores in stored.items():
        n = scores.count()
        rows.append((name, n, exact_quantile(scores, "score", 0.5, n) if n else None, threshold))
    return spark.createDataFrame(rows, "set_name string, samples bigint, median_score double, threshold double")


