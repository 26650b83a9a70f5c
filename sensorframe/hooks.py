"""Extension points: user detectors, embedders, trackers, analyzers, event rules, policies.

Analyzers and event rules need no wrapper: any ``DataFrame -> DataFrame``
callable works with ``df.transform`` (:func:`apply_rules` unions several), and an
alert policy is a boolean Column given to ``alerts_from_events(policy=...)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.events import union_events
from .operators.user_tracking import gathered, track_in_chunks
from .runtime import task_count
from .schemas import DETECTIONS

Frames = Iterator[pd.DataFrame]


def detect_with(
    frames: DataFrame, make_detector: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
    schema: T.StructType = DETECTIONS,
) -> DataFrame:
    """Run a detector over frame batches.

    ``make_detector`` runs once per task (load the model there); the detector
    turns a batch of frames into any number of detection rows.
    """

    def run(batches: Frames) -> Frames:
        detector = make_detector()
        for batch in batches:
            yield detector(batch)

    return frames.mapInPandas(run, schema)


def encode_with(
    df: DataFrame,
    column: str,
    make_encoder: Callable[[], Callable[[list], np.ndarray]],
    *,
    dim: int | None = None,
    batch_size: int = 16,
    output: str = "embedding",
) -> DataFrame:
    """Encode a column in batches of ``batch_size`` (X2); adds ``output``.

    The encoder gets a list of values and returns a row matrix.  A wrong row
    count or dimension fails the task.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be positive")

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def encode(values: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = make_encoder()
        width = dim
        for array in values:
            items = array.to_pylist()
            rows = []
            for start in range(0, len(items), batch_size):
                chunk = items[start : start + batch_size]
                matrix = np.asarray(encoder(chunk), dtype=np.float32)
                if matrix.ndim != 2 or len(matrix) != len(chunk):
                    raise ValueError("the encoder gave no matrix with one row per crop")
                width = width or matrix.shape[1]
                if matrix.shape[1] != width:
                    raise ValueError("encoder changed its embedding dimension")
                rows.extend(matrix.tolist())
            yield pa.array(rows, pa.list_(pa.float32()))

    return df.withColumn(output, encode(F.col(column)))


def track_with(
    detections: DataFrame,
    make_tracker: Callable[[], Callable[[pd.DataFrame], pd.DataFrame | dict[str, list]]],
    schema: T.StructType,
    keys: Sequence[str] = ("run_id", "label"),
    *,
    chunk_frames: int | None = None,
    warmup_frames: int = 64,
) -> DataFrame:
    """Run a user tracker (X3) frame by frame, a fresh one per key.

    ``make_tracker()`` returns ``update(frame_rows) -> rows``; the rows are a table, or a mapping of the columns to
    lists, which costs far less than a small table per frame.  Partitions are
    sorted and streamed, so only the tracker's own state and one frame are in
    memory; keys should be as fine as the algorithm allows.  A key is then one task.

    With ``chunk_frames`` a key runs in chunks of so many frames at once, with the same rows.
    ``make_tracker()`` then returns an object that can hand over its state
    (``operators.user_tracking``); others are refused.
    """
    if chunk_frames is not None:
        return track_in_chunks(detections, make_tracker, schema, keys, chunk_frames=chunk_frames, warmup_frames=warmup_frames)
    keys = list(keys)
    order = ["frame_ordinal", "detection_index"]

    def run(batches: Frames) -> Frames:
        tracker, current = None, None
        rest: pd.DataFrame | None = None

        def frames_of(rows: pd.DataFrame) -> list[int]:
            """Start positions of the frames in sorted rows."""
            starts = np.zeros(len(rows), dtype=bool)
            starts[:1] = True
            for c in [*keys, "frame_ordinal"]:
                v = rows[c].to_numpy(dtype=object)
                starts[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(starts).tolist()

        def step(rows: pd.DataFrame, edges: list[int]) -> Frames:
            nonlocal tracker, current
            heads = list(zip(*[rows[k].to_numpy(dtype=object)[edges[:-1]] for k in keys]))
            out = []
            for head, lo, hi in zip(heads, edges[:-1], edges[1:]):
                if head != current:
                    tracker, current = make_tracker(), head
                out.append(tracker(rows.iloc[lo:hi]))
            if out:
                yield gathered(out, schema.names)

        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if rows.empty:
                continue
            edges = frames_of(rows)
            yield from step(rows, edges)
            rest = rows.iloc[edges[-1]:]
        if rest is not None and not rest.empty:
            yield from step(rest, [0, len(rest)])

    parts = task_count(detections.sparkSession)  # else adaptive execution joins keys, as their rows have few bytes
    laid_out = detections.repartition(parts, *[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order)
    return laid_out.mapInPandas(run, schema)


def apply_rules(df: DataFrame, *rules: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply analyzers or event rules to one table and union their rows."""
    return union_events(*[df.transform(rule) for rule in rules])
