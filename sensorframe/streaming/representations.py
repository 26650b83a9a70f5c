"""Sampled representations and their change on a stream.

Three steps, each with state of its own:

* a frame keeps its best due observations, ``max_per_frame`` at most, until the watermark has passed it; then it is
  closed and goes on as one row;
* closed frames of a run get the numbers of their rows, in frame order: one counter per run, and one small row per
  frame, so a run's detections never meet in one task;
* each track keeps its previous unit vector, until it has had no sample for ``idle_s`` seconds.

The encoder stands between the second and the third: it sees sampled rows with their crop, and adds ``embedding``.

Defined results: equal to ``sample_tracks`` and ``representation_changes`` of the same rows, if no frame comes after
the watermark has passed it; such a frame is left out and not counted.  Frames of a run have to be in the order of their
times.  Rows without a frame or track are end marks (``streaming.runs.end_marks``): one with a run's id removes its
counter once the watermark has passed it.  Rows without a time are left out.  A frame whose crops are all too small takes no number.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.geometry import box, crop_window
from ..functions.text import label_in
from ..functions.vectors import unit_vectors
from ..operators.representations import change_rows, check_sampling
from ..schemas import REPRESENTATIONS, conform
from .runs import event_time

CLOSED = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("frame_ordinal", T.LongType()),
        T.StructField("first_row", T.LongType()),
        T.StructField("rows", T.ArrayType(T.StringType())),
        T.StructField("event_time", T.TimestampType()),
    ]
)


def _ms(stamp: pd.Timestamp) -> int:
    return int(stamp.value // 1_000_000)


def _stamp(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


class FrameProcessor(StatefulProcessor):
    """The best rows of one frame, emitted when the watermark passes the frame's time.

    State is [-confidence, track, kept, row as text] of ``most`` rows at most, whatever the frame holds.
    """

    def __init__(self, most: int):
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = T.StructType([T.StructField("body", T.StringType()), T.StructField("at", T.LongType())])
        self.value = handle.getValueState("frame", fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        body, at = self.value.get() if self.value.exists() else ("[]", None)
        best = json.loads(body)
        for batch in rows:
            for r in batch.itertuples(index=False):
                # nulls of confidence come last, as in a descending sort
                best.append([pd.isna(r.confidence), 0.0 if pd.isna(r.confidence) else -float(r.confidence), int(r.track_id), bool(r.kept), r.row])
                stamp = _ms(r.event_time)
                at = stamp if at is None else max(at, stamp)
            best = sorted(best)[: self.most]
        self.handle.registerTimer(at)
        self.value.update((json.dumps(best), at))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.value.exists():
            return
        body, at = self.value.get()
        if at > timerValues.getCurrentWatermarkInMs():
            return  # a later row moved the frame's time
        self.value.clear()
        kept = [row for *_, fits, row in json.loads(body) if fits]
        if kept:
            # a timer rings behind its time, when rows of that very time may count as late already
            yield pd.DataFrame([(key[0], int(key[1]), None, kept, _stamp(at + 1))], columns=CLOSED.names)

    def close(self) -> None:
        pass


class NumberProcessor(StatefulProcessor):
    """Row numbers of one run's closed frames: a counter, removed at the run's end mark."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState("next_row", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # frames closed together come in any order; later batches hold later frames only
        frames = sorted((r for batch in rows for r in batch.itertuples(index=False)), key=lambda r: (r.event_time, r.is_end, r.frame_ordinal))
        n = self.value.get()[0] if self.value.exists() else 0
        out, ended = [], False
        for r in frames:
            if r.is_end:
                ended = True
                continue
            ended = False
            out.append((key[0], int(r.frame_ordinal), n, list(r.rows), r.event_time))
            n += len(r.rows)
        if ended:
            self.value.clear()
        elif frames:
            self.value.update((n,))
        if out:
            yield pd.DataFrame(out, columns=CLOSED.names)

    def close(self) -> None:
        pass


class PreviousProcessor(StatefulProcessor):
    """Adds the track's previous unit vector; forgets it ``idle_ms`` after the last sample."""

    def __init__(self, idle_ms: int, columns: list[str]):
        self.idle_ms, self.columns = idle_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = T.StructType([T.StructField("unit", T.ArrayType(T.DoubleType())), T.StructField("until", T.LongType())])
        self.value = handle.getValueState("previous", fields)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = pd.concat(list(rows)).sort_values(["frame_ordinal", "embedding_row"], kind="stable")
        stored = self.value.get() if self.value.exists() else (None, None)
        units = [list(u) for u in now["unit_vector"]]
        at = [_ms(t) for t in now["event_time"]]
        before = [(stored[0] and list(stored[0]), stored[1]), *((u, t + self.idle_ms) for u, t in zip(units, at, strict=True))]
        # the timer only frees state; whether a track was idle too long follows from the rows' times
        linked = [u if until is not None and t <= until else None for (u, until), t in zip(before[:-1], at, strict=True)]
        now["vector_before"] = pd.Series(linked, index=now.index, dtype=object)
        until = at[-1] + self.idle_ms
        if stored[1] is not None:
            self.handle.deleteTimer(stored[1])
        self.handle.registerTimer(until)
        self.value.update((units[-1], until))
        yield now[self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.value.clear()
        return iter(())

    def close(self) -> None:
        pass


def sample_stream(
    tracks: DataFrame, *, labels: Iterable[str] | None = None, min_track_hits: int = 3, sample_every_n_hits: int = 15,
    max_per_frame: int = 16, pad_px: int = 6, min_crop_size: int = 12, lateness: str = "10 seconds",
) -> DataFrame:
    """Observations to embed, with ``crop``, ``embedding_row`` and ``event_time``; columns of ``tracks`` else.

    ``tracks`` needs the frame's ``width`` and ``height``.  Leave vectors out of it: they come after sampling.
    """
    check_sampling(min_track_hits, sample_every_n_hits, max_per_frame, pad_px, min_crop_size)
    is_mark = F.col("frame_ordinal").isNull() | F.col("track_id").isNull()
    hits = F.col("hits")
    due = (hits >= min_track_hits) & label_in(labels) & ((hits - min_track_hits) % sample_every_n_hits == 0)
    crop = crop_window(F.col("width"), F.col("height"), box(), pad_px, min_crop_size)
    held = T.StructType([f for f in tracks.schema if f.name != "run_id"])
    timed = tracks.withColumn("event_time", event_time()).withWatermark("event_time", lateness)
    # the last term is never true; with it the filter stays behind the watermark, which all rows move on
    wanted = F.coalesce(due, F.lit(False)) | (is_mark & F.col("run_id").isNotNull()) | (F.col("event_time") < F.timestamp_seconds(F.lit(0)))
    packed = timed.filter(wanted & F.col("event_time").isNotNull()).select(
        "run_id", F.coalesce("frame_ordinal", F.lit(-1)).alias("frame_ordinal"), F.coalesce("track_id", F.lit(-1)).alias("track_id"),
        "confidence", crop.isNotNull().alias("fits"), is_mark.alias("is_mark"),
        F.to_json(F.struct(*held.names)).alias("row"), "event_time",
    )
    # an end mark is a frame of its own with one row that always fits
    closed = packed.select("*", (F.col("fits") | F.col("is_mark")).alias("kept")).groupBy("run_id", "frame_ordinal").transformWithStateInPandas(
        statefulProcessor=FrameProcessor(max_per_frame), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="event_time",
    )
    numbered = closed.select("run_id", "frame_ordinal", "rows", (F.col("frame_ordinal") < 0).alias("is_end"), "event_time").groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=NumberProcessor(), outputStructType=CLOSED, outputMode="Append", timeMode="EventTime", eventTimeColumnName="event_time",
    )
    each = numbered.select("run_id", "event_time", "first_row", F.posexplode("rows").alias("_place", "_row"))
    opened = each.select("run_id", F.from_json("_row", held).alias("_t"), (F.col("first_row") + F.col("_place")).alias("embedding_row"), "event_time")
    return opened.select("run_id", "_t.*", "embedding_row", "event_time").withColumn("crop", crop)


def change_stream(
    tracks: DataFrame, encode: Callable[[DataFrame], DataFrame], *, source: str = "embedder", idle_s: float = 3600.0, **sampling,
) -> DataFrame:
    """Representation rows of a stream of tracks; ``encode`` adds ``embedding`` to sampled rows and keeps the rest.

    ``encode`` must be stateless, such as a projection or ``mapInArrow``.  A track without a sample for ``idle_s``
    seconds starts anew.
    """
    encoded = encode(sample_stream(tracks, **sampling))
    unit = encoded.withColumn("unit_vector", unit_vectors("embedding")).drop("embedding", "source", "crop")
    # names that begin with an underscore don't reach a stateful processor
    schema = T.StructType([*unit.schema.fields, T.StructField("vector_before", T.ArrayType(T.DoubleType()))])
    linked = unit.groupBy("run_id", "track_id").transformWithStateInPandas(
        statefulProcessor=PreviousProcessor(int(idle_s * 1000), schema.names), outputStructType=schema, outputMode="Append",
        timeMode="EventTime", eventTimeColumnName="event_time",
    )
    return conform(change_rows(linked.withColumnsRenamed({"unit_vector": "_unit", "vector_before": "_before"}), source), REPRESENTATIONS)
