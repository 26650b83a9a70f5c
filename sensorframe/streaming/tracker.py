"""Streaming tracker with role and dwell rules (ST1).

Input is one row per processed frame with its detections as an array, so a
frame without detections still ages tracks.  State is kept per run: live
tracks, the next id, and frames that arrived ahead of their turn.  It is removed
once the watermark has passed the run's end mark, a row with the run's id and
no ``frame_ordinal``.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from math import hypot

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import label_in, sorted_json
from ..operators.events import DWELL_SOURCE, NORMAL_ROLES, PERSISTENCE_SOURCE, ROLE_SOURCE, check_severity
from ..operators.tracking import NAME, associate
from ..schemas import EVENTS, conform
from .runs import EPOCH_S, event_time

TRACK_ROWS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("status", T.StringType()),  # "track", or "late" for a frame that came after its turn
        T.StructField("frame_ordinal", T.LongType()),
        T.StructField("frame_number", T.LongType()),
        T.StructField("timestamp_s", T.DoubleType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("hits", T.LongType()),
        T.StructField("first_frame_number", T.LongType()),
        T.StructField("first_timestamp_s", T.DoubleType()),
        T.StructField("scenario_role", T.StringType()),
        T.StructField("tracker", T.StringType()),
        T.StructField("x1", T.IntegerType()),
        T.StructField("y1", T.IntegerType()),
        T.StructField("x2", T.IntegerType()),
        T.StructField("y2", T.IntegerType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField("source_path", T.StringType()),
        T.StructField("detection_object_id", T.LongType()),
        T.StructField("max_displacement_px", T.DoubleType()),
        T.StructField("new_role", T.BooleanType()),
        T.StructField("dwelt", T.BooleanType()),
    ]
)
ROWS_OUT = 10_000
CARRIED = ("sensor_id", "modality", "source_path", "object_id")
DETECTION_FIELDS = ("detection_index", "label", "confidence", "scenario_role", *CARRIED, "x1", "y1", "x2", "y2")


def frame_rows(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """One row per frame with ``detections array<struct>`` in detection order (empty when none)."""
    fields = [f for f in DETECTION_FIELDS if f in detections.columns]
    packed = detections.groupBy("run_id", "frame_ordinal").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("detections")
    )
    return frames.select("run_id", "frame_ordinal", "frame_number", "timestamp_s").join(
        packed, ["run_id", "frame_ordinal"], "left"
    ).withColumn("detections", F.coalesce("detections", F.array().cast(packed.schema["detections"].dataType)))


def event_ms(seconds: float) -> int:
    return int((float(seconds) + EPOCH_S) * 1000)


def _table(rows: list[dict]) -> pd.DataFrame:
    """Object columns, so an absent value stays null whatever the column's type."""
    return pd.DataFrame([[r.get(c) for c in TRACK_ROWS.names] for r in rows], columns=TRACK_ROWS.names, dtype=object)


class _Live:
    """A live track; attribute names match what ``associate`` reads."""

    __slots__ = ("id", "label", "box", "at", "hits", "first", "origin", "far", "roles", "dwelt", "inherited")

    def __init__(self, **values):
        self.inherited = False
        for k, v in values.items():
            setattr(self, k, v)

    def dump(self) -> dict:
        return {k: getattr(self, k) for k in self.__slots__ if k != "inherited"}


class TrackProcessor(StatefulProcessor):
    """Greedy IoU association of one run's frames in ordinal order."""

    def __init__(self, threshold: float, max_missed: int, min_hits: int | None, limit: float, labels):
        self.threshold, self.reach = threshold, max_missed + 1
        self.min_hits, self.limit, self.labels = min_hits, limit, labels

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = T.StructType([T.StructField("next_ordinal", T.LongType()), T.StructField("body", T.StringType())])
        self.value = handle.getValueState("run", fields)
        waiting = T.StructType([T.StructField("row", T.StringType())])
        self.waiting = handle.getMapState("waiting", T.StructType([T.StructField("ordinal", T.LongType())]), waiting)

    def _load(self):
        if self.value.exists():
            ordinal, body = self.value.get()
            data = json.loads(body)
            return ordinal, data["next_id"], [_Live(**t) for t in data["live"]], data["ends"]
        return 0, 1, [], None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn, next_id, live, ends = self._load()
        out = []
        ready: dict[int, dict] = {}
        for batch in rows:
            for r in batch.itertuples(index=False):
                if r.is_end:
                    if key[0] is not None:
                        ends = max(ends or 0, event_ms(r.timestamp_s))
                        self.handle.registerTimer(ends)
                    continue
                ordinal = int(r.frame_ordinal)
                frame = {
                    "n": int(r.frame_number), "t": float(r.timestamp_s), "event_ms": event_ms(r.timestamp_s),
                    "d": [[x.get(f) for f in DETECTION_FIELDS[1:]] for x in json.loads(r.detections)],
                }
                if ordinal < turn:
                    out.append({"run_id": key[0], "status": "late", "frame_ordinal": ordinal,
                                "frame_number": frame["n"], "timestamp_s": frame["t"]})
                else:
                    ready[ordinal] = frame
        if not ready and not out and ends is None and not self.value.exists():
            return  # a mark of no run
        for (ordinal,) in list(self.waiting.keys()):
            ready.setdefault(int(ordinal), json.loads(self.waiting.getValue((ordinal,))[0]))
        watermark = timerValues.getCurrentWatermarkInMs()
        turn, next_id = yield from self._advance(key[0], ready, turn, next_id, live, watermark, out)
        self._store(ready, turn, next_id, live, ends, watermark)
        if out:
            yield _table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        turn, next_id, live, ends = self._load()
        ready = {int(o): json.loads(self.waiting.getValue((o,))[0]) for (o,) in list(self.waiting.keys())}
        out: list[dict] = []
        watermark = timerValues.getCurrentWatermarkInMs()
        turn, next_id = yield from self._advance(key[0], ready, turn, next_id, live, watermark, out)
        self._store(ready, turn, next_id, live, ends, watermark)
        if out:
            yield _table(out)

    def _advance(self, run, ready, turn, next_id, live, watermark, out):
        """Take frames whose turn it is; skip a gap once the watermark has passed it.  Full tables go out at once."""
        for ordinal in sorted(ready):
            if ordinal != turn and ready[ordinal]["event_ms"] > watermark:
                break
            next_id = self._frame(run, ordinal, ready.pop(ordinal), next_id, live, out)
            turn = ordinal + 1
            if len(out) >= ROWS_OUT:
                yield _table(out)
                out.clear()
        return turn, next_id

    def _store(self, ready, turn, next_id, live, ends, watermark) -> None:
        known = {int(o) for (o,) in list(self.waiting.keys())}
        for ordinal in known - set(ready):
            self.waiting.removeKey((ordinal,))
        for ordinal in set(ready) - known:
            self.waiting.updateValue((ordinal,), (json.dumps(ready[ordinal]),))
            self.handle.registerTimer(ready[ordinal]["event_ms"])
        if ends is not None and ends <= watermark and not ready:
            self.value.clear()
            return
        alive = [t.dump() for t in live if turn - t.at[0] <= self.reach]
        self.value.update((turn, json.dumps({"next_id": next_id, "live": alive, "ends": ends})))

    def _frame(self, run, ordinal, frame, next_id, live: list[_Live], out) -> int:
        live[:] = [t for t in live if ordinal - t.at[0] <= self.reach]
        by_label: dict[str, tuple[list[_Live], list[int]]] = {}
        for t in live:
            by_label.setdefault(t.label, ([], []))[0].append(t)
        for j, d in enumerate(frame["d"]):
            by_label.setdefault(d[0], ([], []))[1].append(j)
        owner: dict[int, _Live] = {}
        for tracks, positions in by_label.values():
            if tracks and positions:
                match, _ = associate(tracks, [tuple(frame["d"][j][-4:]) for j in positions], self.threshold)
                owner.update({positions[p]: tracks[i] for p, i in match.items()})
        rows = []
        for j, (label, confidence, role, sensor, modality, source, target, *corners) in enumerate(frame["d"]):
            corners = [int(c) for c in corners]
            centre = ((corners[0] + corners[2]) / 2.0, (corners[1] + corners[3]) / 2.0)
            t = owner.get(j)
            if t is None:
                t = _Live(id=next_id, label=label, box=corners, at=[ordinal, j], hits=0,
                          first=[frame["n"], frame["t"]], origin=list(centre), far=0.0, roles=[], dwelt=False)
                next_id += 1
                live.append(t)
            t.box, t.at, t.hits = corners, [ordinal, j], t.hits + 1
            t.far = max(t.far, hypot(centre[0] - t.origin[0], centre[1] - t.origin[1]))
            role = role if isinstance(role, str) and role else None
            new_role = role is not None and role not in t.roles
            if new_role:
                t.roles.append(role)
            dwelt = (
                self.min_hits is not None and not t.dwelt and t.hits >= self.min_hits and t.far <= self.limit
                and (self.labels is None or label in self.labels)
            )
            t.dwelt = t.dwelt or dwelt
            rows.append(
                {
                    "run_id": run, "status": "track", "frame_ordinal": ordinal, "frame_number": frame["n"],
                    "timestamp_s": frame["t"], "track_id": t.id, "label": label, "confidence": confidence,
                    "hits": t.hits, "first_frame_number": t.first[0], "first_timestamp_s": t.first[1],
                    "scenario_role": role, "tracker": NAME, "x1": corners[0], "y1": corners[1], "x2": corners[2],
                    "y2": corners[3], "duration_s": max(0.0, frame["t"] - t.first[1]), "sensor_id": sensor,
                    "modality": modality, "source_path": source, "detection_object_id": target, "max_displacement_px": t.far, "new_role": new_role, "dwelt": dwelt,
                }
            )
        out.extend(sorted(rows, key=lambda r: r["track_id"]))
        return next_id

    def close(self) -> None:
        pass


def track_stream(
    frames: DataFrame,
    *,
    iou_threshold: float = 0.30,
    max_missed_updates: int = 2,
    lateness: str = "10 seconds",
    min_hits: int | None = None,
    max_displacement_px: float = 40.0,
    labels: Iterable[str] | None = None,
) -> DataFrame:
    """Track rows of a frame stream (see :func:`frame_rows`).

    Frames may arrive up to ``lateness`` out of order; a frame whose turn has
    passed is reported with ``status = 'late'`` and never merged silently.  A
    run's end mark removes its state; a frame after it begins the run anew.
    """
    # Detections travel as text: flat columns cross to Python in any batch layout.
    flat = frames.select(
        "run_id", F.coalesce("frame_ordinal", F.lit(-1)).alias("frame_ordinal"), F.coalesce("frame_number", F.lit(-1)).alias("frame_number"),
        "timestamp_s", F.coalesce(F.to_json("detections"), F.lit("[]")).alias("detections"), F.col("frame_ordinal").isNull().alias("is_end"),
    )
    timed = flat.withColumn("event_time", event_time()).withWatermark("event_time", lateness)
    processor = TrackProcessor(
        float(iou_threshold), int(max_missed_updates), min_hits, float(max_displacement_px),
        None if labels is None else set(labels),
    )
    return timed.groupBy("run_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=TRACK_ROWS, outputMode="Append", timeMode="EventTime"
    )


def track_stream_events(tracks: DataFrame, *, max_displacement_px: float = 40.0, normal_roles=NORMAL_ROLES) -> DataFrame:
    """Role and dwell events of a track stream; stateless."""
    role, limit = F.col("scenario_role"), float(max_displacement_px)
    normal = role.isin(*sorted(normal_roles))
    role_event = F.struct(
        F.concat_ws(":", F.lit("scenario"), F.col("track_id").cast("string"), role).alias("event_id"),
        role.alias("event_type"),
        F.when(normal, F.lit("info")).otherwise(F.lit("warning")).alias("severity"),
        F.lit(ROLE_SOURCE).alias("source"),
        F.format_string("Track %d classified as scenario role '%s'.", F.col("track_id"), role).alias("message"),
        sorted_json(hits=F.col("hits")).alias("metadata"),
    )
    dwell_event = F.struct(
        F.format_string("dwell:%d", F.col("track_id")).alias("event_id"),
        F.lit("dwell").alias("event_type"),
        F.lit("warning").alias("severity"),
        F.lit(DWELL_SOURCE).alias("source"),
        F.format_string(
            f"Track %d persisted for %d observations within {limit:.1f}px of its origin.",
            F.col("track_id"), F.col("hits"),
        ).alias("message"),
        sorted_json(
            hits=F.col("hits"),
            duration_s=F.greatest(F.lit(0.0), F.col("timestamp_s") - F.col("first_timestamp_s")),
            max_displacement_px=F.col("max_displacement_px"),
            configured_max_displacement_px=F.lit(limit),
        ).alias("metadata"),
    )
    fired = F.array_compact(F.array(F.when(F.col("new_role"), role_event), F.when(F.col("dwelt"), dwell_event)))
    rows = tracks.filter(F.col("status") == "track").withColumn("_e", F.explode(fired))
    return conform(rows.select(*tracks.columns, "_e.*"), EVENTS)


STREAK_ROWS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("track_id", T.LongType()),
        T.StructField("frame_ordinal", T.LongType()),
        T.StructField("frame_number", T.LongType()),
        T.StructField("timestamp_s", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("streak", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("margin", T.DoubleType()),
        T.StructField("anomaly_source", T.StringType()),
    ]
)
MEASURES = ("score", "threshold", "margin")


class StreakProcessor(StatefulProcessor):
    """Fires once per track when its anomalous streak first reaches ``need`` adjacent frames.

    Scores wait until the watermark passes them, so order within a track is
    restored before they are counted.  A track's state is removed when the
    watermark is ``idle_ms`` past its last score.
    """

    def __init__(self, need: int, idle_ms: int):
        self.need, self.idle_ms = need, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.value = handle.getValueState(
            "streak",
            T.StructType(
                [
                    T.StructField("last", T.LongType()), T.StructField("count", T.LongType()),
                    T.StructField("fired", T.BooleanType()), T.StructField("waiting", T.StringType()),
                    T.StructField("newest", T.LongType()), T.StructField("alarm", T.LongType()),
                ]
            ),
        )

    def _run(self, key, fresh: list, watermark: int) -> Iterator[pd.DataFrame]:
        """Rows are [ordinal, frame number, time, label, anomalous, event time in ms, score, threshold, margin, source]."""
        if not fresh and not self.value.exists():
            return
        last, count, fired, waiting, newest, alarm = self.value.get() if self.value.exists() else (-2, 0, False, "[]", 0, 0)
        rows = sorted([*json.loads(waiting), *fresh], key=lambda r: r[0])
        newest = max([newest, *(r[5] for r in fresh)])
        out, rest = [], []
        for row in rows:
            ordinal, number, stamp, label, odd, event_ms, *measured = row
            if fired:
                break
            if event_ms > watermark:
                rest.append(row)
                continue
            if ordinal <= last:
                continue
            count = (count + 1 if ordinal == last + 1 else 1) if odd else 0
            last = ordinal
            if count >= self.need:
                fired = True
                out.append((key[0], key[1], ordinal, number, stamp, label, count, *measured))
        if rest and not fired:
            self.handle.registerTimer(min(r[5] for r in rest))
        over = newest + self.idle_ms
        if over <= watermark:
            self.value.clear()
        else:
            if alarm <= watermark:  # one idle timer at a time, moved on when it rings
                alarm = over
                self.handle.registerTimer(alarm)
            self.value.update((last, count, fired, json.dumps([] if fired else rest), newest, alarm))
        if out:
            yield pd.DataFrame(out, columns=STREAK_ROWS.names, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = [
            [int(r.frame_ordinal), int(r.frame_number), float(r.timestamp_s), r.label, bool(r.is_anomaly), event_ms(r.timestamp_s),
             *(None if pd.isna(v) else float(v) for v in (r.score, r.threshold, r.margin)), r.source if isinstance(r.source, str) else None]
            for batch in rows
            for r in batch[~batch["is_end"]].itertuples(index=False)
        ]
        yield from self._run(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def persistence_stream(
    anomalies: DataFrame, *, min_consecutive: int = 3, severity: str = "warning", lateness: str = "10 seconds",
    labels: Iterable[str] | None = None, idle_s: float = 3600.0,
) -> DataFrame:
    """Persistent-anomaly events of a score stream (W4 on a stream).

    A track without a score for ``idle_s`` seconds is over: it is forgotten.
    Rows without a track are end marks.
    """
    check_severity(severity)
    have = set(anomalies.columns)
    timed = (
        anomalies.filter(label_in(labels) | F.col("track_id").isNull())
        .withColumn("event_time", event_time())
        .withWatermark("event_time", lateness)
        .select(
            "run_id", "track_id", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("frame_ordinal", "frame_number")], "timestamp_s", "label",
            F.coalesce("is_anomaly", F.lit(False)).alias("is_anomaly"), F.col("track_id").isNull().alias("is_end"),
            *[(F.col(c) if c in have else F.lit(None)).cast("double").alias(c) for c in MEASURES],
            (F.col("source") if "source" in have else F.lit(None)).cast("string").alias("source"), "event_time",
        )
    )
    fired = timed.groupBy("run_id", "track_id").transformWithStateInPandas(
        statefulProcessor=StreakProcessor(int(min_consecutive), int(idle_s * 1000)), outputStructType=STREAK_ROWS,
        outputMode="Append", timeMode="EventTime",
    )
    return conform(
        fired.select(
            "*",
            F.format_string("visual_anomaly:%d", F.col("track_id")).alias("event_id"),
            F.lit("visual_anomaly").alias("event_type"),
            F.lit(severity).alias("severity"),
            F.lit(PERSISTENCE_SOURCE).alias("source"),
            F.format_string(
                "Track %d exceeded the normal-activity anomaly threshold for %d consecutive scored observations.",
                F.col("track_id"), F.col("streak"),
            ).alias("message"),
            sorted_json(
                score=F.col("score"), threshold=F.col("threshold"), margin=F.col("margin"),
                consecutive_observations=F.col("streak"), anomaly_source=F.col("anomaly_source"),
            ).alias("metadata"),
        ),
        EVENTS,
    )
