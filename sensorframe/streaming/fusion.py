"""Streaming fusion (ST3) and streaming scoring (ST2).

Scoring and alerting need nothing special: ``score_anomalies`` and
``alerts_from_events`` are stateless projections and run on a stream as they
are.  Fusion decides an anchor once the watermark has passed everything that
could corroborate it; state is the events within reach of undecided anchors and
of events still to come, one list entry each.  A group's state is removed when
the watermark has left all of it behind.

``group_stream`` is the one stateful step.  Member rows, fused events, alerts
and contributor rows are projections of its rows, on the stream or on a table
written from it.  An end mark (``runs.end_marks``) as the last rows of a stream
lets the watermark pass the last events, so nothing stays undecided.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.events import alerts_from_events
from ..operators.fusion import FusionConfig, candidate_windows, corroborating, event_rows, group_keys, padded_reach
from ..schemas import BBOX, EVIDENCE, FUSION_CONTRIBUTORS, SEVERITIES, conform
from .runs import EPOCH_S, event_time

CORNERS = ("x1", "y1", "x2", "y2")
GROUP_ROWS = T.StructType(
    [
        T.StructField("_group", T.StringType()),
        T.StructField("anchor_run", T.StringType()),
        T.StructField("anchor_sensor", T.StringType()),
        T.StructField("anchor_event", T.StringType()),
        T.StructField("anchor_t", T.DoubleType()),
        T.StructField("fused_t", T.DoubleType()),
        T.StructField("members", T.StringType()),
    ]
)
ENTRY = T.StructType(
    [
        T.StructField("timestamp_s", T.DoubleType()),
        T.StructField("sensor_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("label", T.StringType()),
        *[T.StructField(c, T.DoubleType()) for c in CORNERS],
        T.StructField("body", T.StringType()),
        T.StructField("consumed", T.BooleanType()),
        T.StructField("decided", T.BooleanType()),
    ]
)
FLAT = ENTRY.names[:-2]


def _text(value) -> str | None:
    return value if isinstance(value, str) else None


class FusionProcessor(StatefulProcessor):
    """Anchors of one event group, decided in time order behind the watermark."""

    def __init__(self, config: FusionConfig):
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("events", ENTRY)

    def _passed(self, seconds: float, watermark_ms: int) -> bool:
        """Whether nothing at or before ``seconds`` can still come."""
        return math.ceil((seconds + EPOCH_S) * 1000) < watermark_ms

    def _run(self, key, fresh: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        held = list(self.held.get()) if self.held.exists() else []
        entries = sorted([*held, *fresh], key=lambda e: (e[0], *("" if v is None else v for v in e[1:4])))
        if not entries:
            return
        reach = padded_reach(self.config.max_time_delta_s)
        t, sensor, label = ([e[k] for e in entries] for k in (0, 1, 4))
        boxes = [None if any(v is None for v in e[5:9]) else e[5:9] for e in entries]
        consumed, decided = [e[10] for e in entries], [e[11] for e in entries]
        lows, highs = candidate_windows(np.array(t), self.config.max_time_delta_s)
        out = []
        for i in range(len(entries)):
            if decided[i]:
                continue
            if not self._passed(t[i] + reach, watermark_ms):
                break
            decided[i] = True
            if consumed[i]:
                continue
            chosen = corroborating(i, range(lows[i], highs[i]), t, sensor, label, boxes, consumed, self.config)
            if len(chosen) + 1 < self.config.min_sensors:
                continue
            members = [i, *[c[2] for c in chosen]]
            values = [-1.0, *[-c[1] for c in chosen]]
            for m in members:
                consumed[m] = True
            listed = ",".join(
                f'{{"member_order":{k},"anchor_iou":{v if v >= 0 else "null"},"event":{entries[m][9]}}}'
                for k, (m, v) in enumerate(zip(members, values))
            )
            fused = sum(t[m] for m in members) / len(members)
            out.append((key[0], entries[i][3], sensor[i], entries[i][2], t[i], fused, f"[{listed}]"))
        open_at = [s for s, d in zip(t, decided) if not d]
        least = min(open_at) - reach if open_at else math.inf
        kept = [
            (*e[:10], c, d) for e, c, d in zip(entries, consumed, decided)
            if e[0] >= least or not self._passed(e[0] + reach, watermark_ms)
        ]
        if kept:
            wake = min(open_at) if open_at else kept[-1][0]
            self.handle.registerTimer(math.ceil((wake + reach + EPOCH_S) * 1000) + 1)
            self.held.put(kept)
        else:
            self.held.clear()
        if out:
            yield pd.DataFrame(out, columns=GROUP_ROWS.names, dtype=object)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = []
        for batch in rows:
            batch = batch[batch["event_id"].notna()]
            texts = [[_text(v) for v in batch[c]] for c in ("sensor_id", "event_id", "run_id", "label")]
            corners = [[None if pd.isna(v) else float(v) for v in batch[c]] for c in CORNERS]
            times = batch["timestamp_s"].astype(float).tolist()
            fresh += [(*row, False, False) for row in zip(times, *texts, *corners, batch["body"])]
        yield from self._run(key, fresh, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def group_stream(
    evidence: DataFrame, config: FusionConfig | None = None, *, lateness: str = "10 seconds", scope: Sequence[str] = ()
) -> DataFrame:
    """One row per fused group of a stream of evidence: scope, anchor, fused time and ``members`` (anchor first).

    Groups equal those of ``fuse_events`` for every anchor that the watermark
    has passed by the reach.  Rows behind the watermark are dropped by Spark.
    """
    config = config or FusionConfig()
    keys = group_keys(config, scope)
    fields = T.StructType([*[evidence.schema[c] for c in scope], *EVIDENCE.fields])
    flat = conform(evidence, fields)
    event = T.StructType(EVIDENCE.fields)
    # Events travel as text that only Spark reads; what the processor looks at travels as flat columns.
    # One text key, because a label may be null.
    timed = flat.select(
        F.to_json(F.struct(*keys)).alias("_group"),
        *ENTRY.names[:5],
        *[F.col(f"bbox.{c}").alias(c) for c in CORNERS],
        F.to_json(F.struct(*event.names)).alias("body"),
        event_time().alias("event_time"),
    ).withWatermark("event_time", lateness)
    found = timed.groupBy("_group").transformWithStateInPandas(
        statefulProcessor=FusionProcessor(config), outputStructType=GROUP_ROWS, outputMode="Append",
        timeMode="EventTime",
    )
    member = T.StructType(
        [T.StructField("member_order", T.IntegerType()), T.StructField("anchor_iou", T.DoubleType()), T.StructField("event", event)]
    )
    named = F.from_json("_group", T.StructType([evidence.schema[c] for c in scope])) if scope else None
    return found.select(
        *[named[c].alias(c) for c in scope],
        *[c for c in GROUP_ROWS.names if c not in ("_group", "members")],
        F.from_json("members", T.ArrayType(member)).alias("members"),
    )


def member_rows(groups: DataFrame, *, scope: Sequence[str] = ()) -> DataFrame:
    """Member rows of fused groups, with the columns of ``fuse_contributors``; stateless."""
    anchor = [c for c in GROUP_ROWS.names if c.startswith("anchor_")]
    rows = groups.select(*scope, *anchor, "fused_t", F.explode("members").alias("m"))
    return rows.select(*scope, "m.event.*", *anchor, "fused_t", "m.member_order", "m.anchor_iou")


def fusion_stream(
    evidence: DataFrame, config: FusionConfig | None = None, *, lateness: str = "10 seconds", scope: Sequence[str] = ()
) -> DataFrame:
    """Member rows of the fused groups of a stream of evidence."""
    return member_rows(group_stream(evidence, config, lateness=lateness, scope=scope), scope=scope)


def _name() -> Column:
    """A group's id by its anchor: a stream has no final number of groups."""
    anchor = F.concat_ws("/", "anchor_run", "anchor_sensor", "anchor_event")
    return F.concat(F.lit("fusion:"), anchor, F.lit(":"), F.element_at("members", 1)["event"]["event_type"])


def fused_event_rows(groups: DataFrame, config: FusionConfig | None = None, *, scope: Sequence[str] = ()) -> DataFrame:
    """Fused events with the columns of ``fuse_events(...).events``; stateless, so it runs on the stream or a table."""
    config = config or FusionConfig()
    first = F.element_at("members", 1)["event"]

    def listed(column: str) -> Column:
        return F.transform("members", lambda m: m["event"][column])

    ranks = F.transform(listed("severity"), lambda s: F.array_position(F.array(*[F.lit(v) for v in SEVERITIES]), s))
    labels = listed("label")
    named = groups.select(
        *scope,
        _name().alias("event_id"),
        first["frame_number"].alias("frame_number"),
        F.col("fused_t").alias("timestamp_s"),
        first["event_type"].alias("event_type"),
        F.element_at(F.array(*[F.lit(v) for v in SEVERITIES]), F.nullif(F.array_max(ranks), F.lit(0)).cast("int")).alias("severity"),
        F.when(~F.exists(labels, lambda v: v.isNull()) & (F.size(F.array_distinct(labels)) == 1), labels[0]).alias("label"),
        F.size("members").cast("long").alias("support_count"),
        (F.array_max(listed("timestamp_s")) - F.array_min(listed("timestamp_s"))).alias("time_span_s"),
        F.array_min(F.transform("members", lambda m: m["anchor_iou"])).alias("minimum_pair_iou"),
        listed("sensor_id").alias("sensor_ids"),
        listed("modality").alias("modalities"),
        listed("event_id").alias("contributor_event_ids"),
        listed("run_id").alias("contributor_run_ids"),
    )
    return event_rows(named, scope, config)


def fused_alert_rows(events: DataFrame, config: FusionConfig | None = None) -> DataFrame:
    """Alerts of fused events; stateless."""
    return alerts_from_events(events, minimum_severity=(config or FusionConfig()).minimum_severity)


def contributor_rows(groups: DataFrame, *, scope: Sequence[str] = ()) -> DataFrame:
    """Contributing events with the columns of ``fuse_events(...).contributors``; stateless."""
    rows = groups.select(*scope, _name().alias("fusion_event_id"), "fused_t", F.explode("members").alias("m"))
    event = F.col("m.event")

    def column(name: str) -> Column:
        if name in BBOX.names:
            return event["bbox"][name].alias(name)
        if name == "time_delta_from_fused_s":
            return (event["timestamp_s"] - F.col("fused_t")).alias(name)
        return F.col(name) if name == "fusion_event_id" else event[name].alias(name)

    return rows.select(*scope, *[column(c) for c in FUSION_CONTRIBUTORS], F.col("m.member_order").alias("member_order"))
