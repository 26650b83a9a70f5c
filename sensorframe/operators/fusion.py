"""Late fusion of sensor events by temporal consensus.

Events compete only inside one ``(scope, event_type[, label])`` group, and an
anchor reaches no further than ``max_time_delta_s``.  Groups are therefore cut
into time chunks that copy a margin from both neighbours and run through
:mod:`sensorframe.operators.handoff`; the state that crosses a boundary is the
set of events near it that are already consumed.
"""

from __future__ import annotations

import math
import sys
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import cache, cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.text import sorted_json
from ..runtime import few, materialize, materialize_buckets, task_count
from ..schemas import BBOX, EVENTS, EVIDENCE, FUSION_CONTRIBUTORS, SEVERITIES, conform
from .events import alerts_from_events
from .handoff import SUMMARY, SUMMARY_FIELDS, nullable, run_chunks, settle
from .sequence import number_rows

# The message text and id format of fused events below are row values that other tools read
SOURCE = "temporal_consensus"
ORDER = ["timestamp_s", "sensor_id", "event_id", "run_id"]
CHUNK_ROWS = 50_000
LEAST_REACHES = 4.0
CELL_ROWS = 20_000
PARTS = 12
CELL_REACHES = 2.0
PAIR_ROWS = 250_000
PAIR_TASKS = 200  # Spark sorts none of what it shuffles to so few
GROUPS_OUT = 10_000
ANCHOR = {"anchor_run": "run_id", "anchor_sensor": "sensor_id", "anchor_event": "event_id", "anchor_t": "timestamp_s"}
LATE_START = "%late"  # no event's name, as names have % only before two digits


@dataclass(frozen=True)
class FusionConfig:
    """Options of one fusion; ``spatial_iou_threshold`` needs registered pixel geometry."""

    max_time_delta_s: float = 0.50
    min_sensors: int = 2
    require_matching_label: bool = True
    spatial_iou_threshold: float | None = None
    minimum_severity: str = "warning"

    def __post_init__(self):
        if self.max_time_delta_s < 0:
            raise ValueError("max_time_delta_s cannot be negative")
        if isinstance(self.min_sensors, bool) or self.min_sensors < 2:
            raise ValueError("min_sensors must be at least 2")
        if self.spatial_iou_threshold is not None and not 0.0 <= self.spatial_iou_threshold <= 1.0:
            raise ValueError("spatial_iou_threshold must be between 0 and 1")
        if self.minimum_severity not in SEVERITIES:
            raise ValueError(f"minimum_severity must be one of {SEVERITIES}")


class Fusion:
    """Result tables: fused events, their alerts and the contributing events; ``counts`` of them, where known.

    A table may be given as a function, which is called when the table is first asked for: numbering costs jobs, and
    contributors are stored for it.
    """

    def __init__(self, events, alerts, contributors, counts: DataFrame | None = None):
        self._given, self.counts = {"events": events, "alerts": alerts, "contributors": contributors}, counts

    def _table(self, name: str) -> DataFrame:
        return made() if callable(made := self._given[name]) else made

    @cached_property
    def events(self) -> DataFrame:
        return self._table("events")

    @cached_property
    def alerts(self) -> DataFrame:
        return self._table("alerts")

    @cached_property
    def contributors(self) -> DataFrame:
        return self._table("contributors")


def attach_boxes(events: DataFrame, tracks: DataFrame) -> DataFrame:
    """Give each event the box its track had on that frame (J1); last duplicate wins.

    Last is by ``_position`` (file and row, where the reader gives it), else by ``frame_ordinal``; equal places are
    ordered by the box itself, so the result doesn't depend on the layout.
    Events are few: their keys thin the track table before it is aggregated.
    """
    place = [c for c in ("_position", "frame_ordinal") if c in tracks.columns][:1]
    position = F.struct(*place, *[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")])
    key = ["run_id", "frame_number", "track_id"]
    wanted = events.select(*key).filter(F.col("track_id").isNotNull()).distinct()
    boxes = tracks.join(wanted, key, "left_semi").groupBy(*key).agg(
        F.max_by(
            F.struct(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]), position
        ).alias("bbox")
    )
    return events.drop("bbox").join(boxes, key, "left")


def group_keys(config: FusionConfig, scope: Sequence[str]) -> list[str]:
    return [*scope, "event_type", *(["label"] if config.require_matching_label else [])]


def chunk_widths(evidence: DataFrame, keys: Sequence[str], delta: float, rows: int) -> DataFrame:
    """``keys, _width`` in seconds per group: about ``rows`` events of it per chunk, but ``LEAST_REACHES`` at least.

    A group that fits one chunk has one; how dense other groups are doesn't matter to it.
    """
    spans = materialize(evidence.groupBy(*keys).agg(
        F.count("*").alias("_n"), (F.max("timestamp_s") - F.min("timestamp_s")).alias("_span")), "fusion-spans")
    longest = spans.agg(F.max("_span")).first()[0]
    if longest is not None and not math.isfinite(longest):
        raise ValueError("timestamps must be finite")
    reach = padded_reach(delta)
    wanted = F.when(F.col("_n") > rows, F.col("_span") * rows / F.col("_n")).otherwise(F.col("_span") + reach)
    return spans.select(*keys, F.greatest(wanted, F.lit(LEAST_REACHES * reach)).alias("_width"))


def padded_reach(delta: float) -> float:
    """How far around an event, in seconds, everything that may corroborate it lies, rounding included."""
    return 1.000001 * delta + 1e-6


def candidate_windows(times: np.ndarray, delta: float) -> tuple[list[int], list[int]]:
    """For each of ascending times, where its candidates begin and end; the gate ``|t1 - t2| <= delta`` decides later."""
    slack = 1.000001 * delta + 1e-9
    return np.searchsorted(times, times - slack).tolist(), np.searchsorted(times, times + slack, side="right").tolist()


def overlap(a: tuple | None, b: tuple | None) -> float:
    """IoU of two boxes; -1.0 when either is missing."""
    if a is None or b is None:
        return -1.0
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    area = [max(0.0, c[2] - c[0]) * max(0.0, c[3] - c[1]) for c in (a, b)]
    union = area[0] + area[1] - w * h
    return w * h / union if union > 0 else 0.0


def corroborating(i: int, window: Iterable[int], t, sensor, label, boxes, consumed, config: FusionConfig) -> list:
    """Nearest free compatible event of every other sensor, as (gap, -iou, position), nearest first."""
    best: dict[str, tuple[float, float, int]] = {}
    gate = config.spatial_iou_threshold
    for j in window:
        if j == i or consumed[j] or sensor[j] == sensor[i]:
            continue
        gap = abs(t[i] - t[j])
        if gap > config.max_time_delta_s or (config.require_matching_label and label[i] != label[j]):
            continue
        value = overlap(boxes[i], boxes[j])
        if gate is not None and (value == -1.0 or value < gate):
            continue
        rank = (float(gap), -value, j)
        known = best.get(sensor[j])
        if known is None or rank < known:
            best[sensor[j]] = rank
    return sorted(best.values())


class Nearest:
    """What :func:`corroborating` finds, for events of one group in order of time, without a pass over the window.

    Each sensor's events are walked outwards from the anchor, over links that leave out the consumed ones; the walk
    ends at the first gap at which one fits.  So the work grows with the events, not with how many lie within reach.
    """

    def __init__(self, t, sensor, boxes, consumed: list[bool], config: FusionConfig):
        self.t, self.sensor, self.boxes, self.consumed = t, sensor, boxes, consumed
        self.delta, self.gate = config.max_time_delta_s, config.spatial_iou_threshold
        self.at: dict[str, list[int]] = {}
        for i, s in enumerate(sensor):
            self.at.setdefault(s, []).append(i)
        self.links = {s: (list(range(-1, len(p) - 1)), list(range(1, len(p) + 1))) for s, p in self.at.items()}
        self.plain = self.gate is None and not any(b is not None for b in boxes)
        self.times = {s: [t[i] for i in p] for s, p in self.at.items()} if self.plain else {}

    def _free(self, s: str, k: int, right: bool) -> int:
        """The first free place from ``k`` on to one side."""
        places, link, end = self.at[s], self.links[s][right], k
        while 0 <= end < len(places) and self.consumed[places[end]]:
            end = link[end]
        while k != end:  # those passed lead there from now on
            link[k], k = end, link[k]
        return end

    def _of_plain(self, i: int) -> list[tuple[float, float, int]]:
        """Without boxes the first of those at one gap counts, so events of one time are not walked one by one."""
        now, best = self.t[i], []
        for s, places in self.at.items():
            if s == self.sensor[i]:
                continue
            times, cut = self.times[s], bisect_left(places, i)
            left, right = self._free(s, cut - 1, False), self._free(s, cut, True)
            before = abs(now - times[left]) if left >= 0 else math.inf
            after = abs(now - times[right]) if right < len(places) else math.inf
            gap = min(before, after)
            if gap > self.delta or gap == math.inf:
                continue
            k = right
            if before == gap:
                further = left
                while further >= 0 and abs(now - times[further]) == gap:
                    begin = bisect_left(times, times[further])
                    k, further = self._free(s, begin, True), self._free(s, begin - 1, False)
            best.append((float(gap), 1.0, places[k]))
        return sorted(best)

    def of(self, i: int) -> list[tuple[float, float, int]]:
        if self.plain:
            return self._of_plain(i)
        best = []
        for s, places in self.at.items():
            if s == self.sensor[i]:
                continue
            cut, found = bisect_left(places, i), None
            side = [self._free(s, cut - 1, False), self._free(s, cut, True)]
            while found is None:
                gaps = [abs(self.t[i] - self.t[places[k]]) if 0 <= k < len(places) else math.inf for k in side]
                gap = min(gaps)
                if gap > self.delta or gap == math.inf:
                    break
                for right in (0, 1):
                    while 0 <= side[right] < len(places) and abs(self.t[i] - self.t[places[side[right]]]) == gap:
                        j = places[side[right]]
                        value = overlap(self.boxes[i], self.boxes[j])
                        if self.gate is None or (value != -1.0 and value >= self.gate):
                            found = min(found, (float(gap), -value, j)) if found else (float(gap), -value, j)
                        side[right] = self._free(s, side[right] + (1 if right else -1), bool(right))
            if found:
                best.append(found)
        return sorted(best)


def _escaped(value) -> str:
    """Text of a part of an event's name, free of the characters that separate parts and names."""
    return str(value).replace("%", "%25").replace(";", "%3B").replace("\x1f", "%1F")


class _Rows:
    """Rows of whole chunks, in order, as plain columns."""

    def __init__(self, table: pa.Table):
        cols = {c: table.column(c).to_pylist() for c in ("run_id", "sensor_id", "event_id", "_own", "bbox")}
        self.time = table.column("timestamp_s").to_numpy()
        self.t = self.time.tolist()
        self.run, self.sensor, self.event, self.own = (cols[c] for c in ("run_id", "sensor_id", "event_id", "_own"))
        self.label = table.column("label").to_pylist()
        self.box = [None if b is None else (b["x1"], b["y1"], b["x2"], b["y2"]) for b in cols["bbox"]]

    def names(self, places: Iterable[int]) -> list[str]:
        made, seen = [], Counter()
        for i in places:
            plain = "\x1f".join(_escaped(v) for v in (self.run[i], self.sensor[i], self.event[i], self.t[i]))
            seen[plain] += 1  # equal events at one time come together in every chunk that holds them
            made.append(f"{plain}\x1f{seen[plain]}")
        return made


class _Chunk:
    """All rows of one time chunk with its margins: those from ``lo`` to ``hi``."""

    def __init__(self, rows: _Rows, lo: int, hi: int, chunk: int, width: float, warm: float, init: str | None, config: FusionConfig, margin: float):
        self.config, self.warm, self.margin, self.init = config, warm, margin, init
        self.start, self.stop = chunk * width, (chunk + 1) * width
        self.rows, self.lo, self.time = rows, lo, rows.time[lo:hi]
        self.t, self.sensor, self.own, self.box = (c[lo:hi] for c in (rows.t, rows.sensor, rows.own, rows.box))

    def _named(self, boundary: float) -> list[tuple[int, str]]:
        """Rows near a boundary with their names; all events of one time are near it or none is."""
        near = np.flatnonzero(np.abs(self.time - boundary) <= self.margin).tolist()
        return list(zip(near, self.rows.names(self.lo + i for i in near)))

    def _near(self, boundary: float, consumed: list[bool]) -> str:
        return ";".join(sorted(name for i, name in self._named(boundary) if consumed[i]))

    def run(self) -> tuple[list[tuple[list[int], list[float]]], str, str]:
        """Groups of row positions (anchor first) with anchor IoUs, and boundary states."""
        n = len(self.t)
        consumed = [False] * n
        late, cold = self.init == LATE_START, self.init is None or self.init == LATE_START
        if not cold:
            taken = set(filter(None, self.init.split(";")))
            for i, name in self._named(self.start) if taken else ():
                consumed[i] = name in taken
        nearest = Nearest(self.t, self.sensor, self.box, consumed, self.config)
        groups, used, entered = [], "", False
        for i in range(n):
            if self.own[i] and not entered:
                entered = True
                used = self._near(self.start, consumed)
            if not self.own[i]:
                if entered:
                    break  # rows copied from the next chunk are candidates only
                if not cold:
                    continue
                if late or self.t[i] < self.start - self.warm:
                    # a warm-up takes what lies before it as used up; the other warm-up begins one event later
                    late = late and self.t[i] < self.start - self.warm
                    consumed[i] = True
                    continue
            if consumed[i]:
                continue
            chosen = nearest.of(i)
            if len(chosen) + 1 < self.config.min_sensors:
                continue
            members = [i, *[c[2] for c in chosen]]
            for k in members:
                consumed[k] = True
            if self.own[i]:
                groups.append((members, [-c[1] for c in chosen]))
        return groups, used, self._near(self.stop, consumed)


def _kernel(config: FusionConfig, keys: list[str], margin: float, schema):
    out_schema = to_arrow_schema(schema)
    chunk_keys = [*keys, "_chunk"]

    member_fields = list(out_schema.field("members").type.value_type)

    def listed(table: pa.Table, t: list[float], groups: list) -> pa.RecordBatch:
        """One row per group: what its anchor says of it, and its members, anchor first."""
        offsets = np.cumsum([0, *[len(members) for members, _ in groups]])
        picked = table.take(pa.array([m for members, _ in groups for m in members]))
        values = [v for _, overlaps in groups for v in (-1.0, *overlaps)]
        made = {
            "member_order": [k for members, _ in groups for k in range(len(members))],
            "anchor_iou": [v if v >= 0 else None for v in values],
        }
        columns = [
            pa.array(made[f.name], f.type) if f.name in made else picked.column(f.name).combine_chunks().cast(f.type)
            for f in member_fields
        ]
        members = pa.StructArray.from_arrays(columns, fields=member_fields)
        anchors = table.take(pa.array([members[0] for members, _ in groups]))
        fused = [sum(t[m] for m in members) / len(members) for members, _ in groups]
        given = {
            "kind": pa.array(["row"] * len(groups)),
            "fused_t": pa.array(fused, pa.float64()),
            "members": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), members),
        }
        for name in (*chunk_keys, *ANCHOR):
            given[name] = anchors.column(ANCHOR.get(name, name)).combine_chunks()
        arrays = [
            given[f.name].cast(f.type) if f.name in given else pa.nulls(len(groups), f.type) for f in out_schema
        ]
        return pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    def finish(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Runs the chunks of a table, each from its first row in order; what they gave leaves together."""
        places = np.flatnonzero(table.column("_place").to_numpy() == 1)
        heads = table.select([*chunk_keys, "_width", "_warm", "_init"]).take(pa.array(places)).to_pylist()
        rows, groups, summaries = _Rows(table), [], []
        for lo, hi, head in zip(places.tolist(), [*places[1:].tolist(), table.num_rows], heads):
            if not any(rows.own[lo:hi]):
                continue
            chunk = _Chunk(rows, lo, hi, head["_chunk"], head["_width"], head["_warm"], head["_init"], config, margin)
            found, used, end = chunk.run()
            groups += [([lo + m for m in members], overlaps) for members, overlaps in found]
            told = {"kind": SUMMARY, "used_state": used, "end_state": end, "order_mattered": False}
            summaries.append({**{k: head[k] for k in chunk_keys}, **told})
            if len(groups) >= GROUPS_OUT:
                for begin in range(0, len(groups), GROUPS_OUT):
                    yield listed(table, rows.t, groups[begin:begin + GROUPS_OUT])
                groups = []
        if groups:
            yield listed(table, rows.t, groups)
        if summaries:
            given = {k: [s[k] for s in summaries] for k in summaries[0]}
            arrays = [pa.array(given[f.name], f.type) if f.name in given else pa.nulls(len(summaries), f.type) for f in out_schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=out_schema)

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come chunk by chunk, sorted and numbered; a chunk is run when the next one begins."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            begins = np.flatnonzero(batch.column("_place").to_numpy() == 1)
            cut = int(begins[-1]) if len(begins) else 0
            if cut or (len(begins) and held):
                yield from finish(pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks())
                held = []
            held.append(batch.slice(cut))
        if sum(b.num_rows for b in held):
            yield from finish(pa.Table.from_batches(held).combine_chunks())

    return chunks_of


def _sized(rows: DataFrame, keys: Sequence[str], delta: float, width_s: float | None = None) -> DataFrame:
    """``rows`` with the ``_width`` of their group's chunks."""
    if width_s is not None:
        return rows.withColumn("_width", F.lit(max(float(width_s), 2.0 * padded_reach(delta))))
    widths = chunk_widths(rows, keys, delta, CHUNK_ROWS).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_width")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return rows.join(few(widths), same).select(*rows.columns, "_width")


def _with_margins(base: DataFrame, reach: float) -> DataFrame:
    """Assign time chunks of ``_width`` seconds; copy rows near a boundary to the neighbour."""
    t, width = F.col("timestamp_s"), F.col("_width")
    home = F.floor(t / width)
    none = F.array().cast("array<int>")
    shifts = F.concat(
        F.array(F.lit(0)),
        F.when(t >= (home + 1) * width - (F.col("_warm") + reach), F.array(F.lit(1))).otherwise(none),
        F.when(t <= home * width + reach, F.array(F.lit(-1))).otherwise(none),
    )
    return (
        base.withColumn("_home", home.cast("long"))
        .withColumn("_shift", F.explode(shifts))
        .withColumn("_chunk", F.col("_home") + F.col("_shift"))
        .withColumn("_own", F.col("_shift") == 0)
        .withColumn("_init", F.lit(None).cast("string"))
        .drop("_home", "_shift")
    )


def fuse_groups(
    evidence: DataFrame, config: FusionConfig, *, scope: Sequence[str] = (), width_s: float | None = None,
) -> DataFrame:
    """One row per fused group: ``scope``, its anchor, ``fused_t`` and ``members`` (anchor first), as one task found it."""
    keys = group_keys(config, scope)
    delta = config.max_time_delta_s
    reach = padded_reach(delta)
    base = conform(evidence, T.StructType([*[evidence.schema[c] for c in scope], *EVIDENCE.fields]))
    sized = _sized(base, keys, delta, width_s)
    sized = sized.withColumn("_warm", F.least(F.lit(4.0 * (delta if delta > 0 else 1e-6)), F.col("_width") - reach))
    # stored, so that whatever made the evidence runs once, however many rounds follow
    rows = materialize_buckets(_with_margins(sized, reach).drop("_init"), "fusion-rows", [*keys, "_chunk"])
    rows = rows.withColumn("_init", F.lit(None).cast("string"))
    member = T.StructType([
        *nullable(base.schema),
        T.StructField("member_order", T.IntegerType()),
        T.StructField("anchor_iou", T.DoubleType()),
    ])
    schema = T.StructType([
        *nullable(base.select(*keys).schema),
        T.StructField("_chunk", T.LongType()),
        T.StructField("kind", T.StringType()),
        *[T.StructField(c, base.schema[of].dataType) for c, of in ANCHOR.items()],
        T.StructField("fused_t", T.DoubleType()),
        T.StructField("members", T.ArrayType(member)),
        *SUMMARY_FIELDS,
    ])
    kernel = _kernel(config, keys, reach, schema)
    args = (keys, ORDER, kernel, schema, "fusion")
    results, _ = settle(rows, run_chunks(rows, *args, True), *args, variant=LATE_START, grouped=True)
    return results.filter(F.col("kind") == "row").select(*scope, *ANCHOR, "fused_t", "members")


def fuse_contributors(
    evidence: DataFrame, config: FusionConfig, *, scope: Sequence[str] = (), width_s: float | None = None,
) -> DataFrame:
    """Member rows of every fused group, keyed by their anchor event."""
    groups = fuse_groups(evidence, config, scope=scope, width_s=width_s)
    rows = groups.select(*scope, *ANCHOR, "fused_t", F.explode("members").alias("_m"))
    fields = [f.name for f in EVIDENCE.fields if f.name not in scope]
    return rows.select(*scope, *[F.col(f"_m.{c}").alias(c) for c in fields], *ANCHOR, "_m.member_order", "_m.anchor_iou", "fused_t")


def fuse_events(
    evidence: DataFrame, config: FusionConfig | None = None, *, scope: Sequence[str] = (),
    width_s: float | None = None,
) -> Fusion:
    """Fuse events of several sensors.

    ``scope`` names columns (site, exercise ...) that separate independent
    fusions processed in one job; fused events are numbered per scope.
    A group stays one row with its members from the task that found it, so
    numbering it is the only step that follows; it is done for the tables that
    are asked for.
    """
    config = config or FusionConfig()
    scope = list(scope)
    keys = group_keys(config, scope)
    groups = fuse_groups(evidence, config, scope=scope, width_s=width_s)
    slices = cache(lambda: _time_slices(groups))
    listed = {"contributor_event_ids": "event_id", "contributor_run_ids": "run_id"}
    order = ["anchor_t", "anchor_sensor", "anchor_event", "anchor_run", *listed]  # lists: for equal events of one time

    def named(sliced: DataFrame, stored: bool = False) -> DataFrame:
        numbered = number_rows(sliced, scope, F.col("_slice"), [F.col(c) for c in order], "fusion_number", stored=stored)
        return numbered.withColumn("event_id", F.format_string("fusion:%06d:%s", F.col("fusion_number"), F.col("event_type")))

    events = cache(lambda: event_rows(named(slices()(_described(groups, scope))), scope, config))

    def contributors() -> DataFrame:
        # members go through the numbering without what their group has once or what follows from the rest
        once = [c for c in keys if c in FUSION_CONTRIBUTORS]
        made = {"fusion_event_id": F.col("event_id"), "time_delta_from_fused_s": F.col("_m.timestamp_s") - F.col("fused_t"),
                **{c: F.col(f"_m.bbox.{c}") for c in BBOX.names}, **{c: F.col(f"_once.{c}") for c in once}}
        kept = [c for c in FUSION_CONTRIBUTORS if c not in made]
        slim = F.transform("members", lambda m: F.struct(*[m[c].alias(c) for c in kept], m["bbox"].alias("bbox")))
        first = F.col("members")[0]
        lists = groups.select(
            *scope, *ANCHOR, *[F.col("members")[field].alias(name) for name, field in listed.items()], "fused_t",
            first["event_type"].alias("event_type"), F.struct(*[first[c].alias(c) for c in once]).alias("_once"), slim.alias("_members"))
        # bucketed by slice, so that numbering moves no list: a shuffle would write each of them whole
        stored = materialize_buckets(slices()(lists), "fusion-lists", [*scope, "_slice"])
        rows = named(stored, True).select(*scope, "event_id", "fused_t", "_once", F.posexplode("_members").alias("member_order", "_m"))
        return rows.select(*scope, *[made.get(c, F.col(f"_m.{c}")).alias(c) for c in FUSION_CONTRIBUTORS], "member_order")

    return Fusion(
        events, lambda: alerts_from_events(events(), minimum_severity=config.minimum_severity), contributors,
        counts=_counts(groups, scope, config))


def _counts(groups: DataFrame, scope: Sequence[str], config: FusionConfig) -> DataFrame:
    """Fused events, alerts and contributors as one row; nothing needs a number for it."""
    unnamed = event_rows(_described(groups, scope).withColumn("event_id", F.lit("")), scope, config)
    alerts = alerts_from_events(unnamed, minimum_severity=config.minimum_severity)
    sums = groups.agg(F.count("*").alias("fused_events"), F.coalesce(F.sum(F.size("members")), F.lit(0)).cast("long").alias("contributors"))
    return sums.crossJoin(alerts.agg(F.count("*").alias("fused_alerts"))).select("fused_events", "fused_alerts", "contributors")


def _time_slices(groups: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """What adds ``_slice`` to rows of groups: about equally many groups each, in anchor time, for numbering.

    Cut points are approximate quantiles; any cuts give the same numbers.
    """
    from pyspark.ml.feature import Bucketizer  # here, as kernels need none of it

    anchors = groups.select("anchor_t")
    parts = math.ceil(anchors.count() / CHUNK_ROWS)
    if parts < 2:
        return lambda rows: rows.withColumn("_slice", F.lit(0))
    cuts = anchors.approxQuantile("anchor_t", [i / parts for i in range(1, parts)], 0.1 / parts)
    splits = [-math.inf, *sorted(set(cuts)), math.inf]
    sliced = Bucketizer(splits=splits, inputCol="anchor_t", outputCol="_slice")
    # whole numbers: Spark shuffles by doubles anew, also where rows are bucketed by them
    return lambda rows: sliced.transform(rows).withColumn("_slice", F.col("_slice").cast("int"))


def _described(groups: DataFrame, scope: Sequence[str]) -> DataFrame:
    """The columns of fused events but for their names, from the members of each group (A12); stateless."""
    first = F.col("members")[0]

    def listed(column: str) -> Column:
        return F.transform("members", lambda m: m[column])

    ranks = F.transform(listed("severity"), lambda s: F.array_position(F.array(*[F.lit(v) for v in SEVERITIES]), s))
    labels = listed("label")
    return groups.select(
        *scope, *ANCHOR,
        first["frame_number"].alias("frame_number"),
        F.col("fused_t").alias("timestamp_s"),
        first["event_type"].alias("event_type"),
        F.element_at(F.array(*[F.lit(v) for v in SEVERITIES]), F.nullif(F.array_max(ranks), F.lit(0)).cast("int")).alias("severity"),
        F.when(~F.exists(labels, lambda v: v.isNull()) & (F.size(F.array_distinct(labels)) == 1), labels[0]).alias("label"),
        F.size("members").cast("long").alias("support_count"),
        (F.array_max(listed("timestamp_s")) - F.array_min(listed("timestamp_s"))).alias("time_span_s"),
        F.array_min(listed("anchor_iou")).alias("minimum_pair_iou"),
        listed("sensor_id").alias("sensor_ids"),
        listed("modality").alias("modalities"),
        listed("event_id").alias("contributor_event_ids"),
        listed("run_id").alias("contributor_run_ids"),
    )


def event_rows(named: DataFrame, scope, config: FusionConfig) -> DataFrame:
    """Event columns of named groups (one row each, with the members' fields as arrays); stateless."""
    gate = config.spatial_iou_threshold
    rows = named.select(
        *named.columns,
        F.lit(SOURCE).alias("source"),
        F.format_string(
            "%d sensors corroborated '%s' within %.3fs.",
            F.col("support_count"), F.col("event_type"), F.col("time_span_s"),
        ).alias("message"),
        sorted_json(
            strategy=F.lit(SOURCE),
            support_count=F.col("support_count"),
            sensor_ids=F.col("sensor_ids"),
            modalities=F.col("modalities"),
            contributor_event_ids=F.col("contributor_event_ids"),
            contributor_run_ids=F.col("contributor_run_ids"),
            time_span_s=F.col("time_span_s"),
            require_matching_label=F.lit(config.require_matching_label),
            spatial_iou_threshold=F.lit(gate).cast("double"),
            minimum_pair_iou=F.col("minimum_pair_iou"),
        ).alias("metadata"),
    )
    extra = [
        "support_count", "time_span_s", "minimum_pair_iou", "sensor_ids", "modalities",
        "contributor_event_ids", "contributor_run_ids",
    ]
    fields = [named.schema[c] for c in scope] + EVENTS.fields + [rows.schema[c] for c in extra]
    return conform(rows, T.StructType(fields))


def consensus_support(
    evidence: DataFrame, config: FusionConfig | None = None, *, scope: Sequence[str] = ()
) -> DataFrame:
    """How many events of other sensors could corroborate each event (J2, counted).

    Without a spatial gate this is two range-framed window counts per time
    chunk: all events within the reach minus those of the same sensor.  With
    one, each chunk is counted event by event against the boxes within reach.
    Either way no event pairs leave a task.
    """
    config = config or FusionConfig()
    keys = group_keys(config, scope)
    delta = float(config.max_time_delta_s)
    rows = _with_margins(_sized(evidence, keys, delta).withColumn("_warm", F.lit(0.0)), padded_reach(delta))
    if config.spatial_iou_threshold is not None:
        schema = T.StructType([*nullable(evidence.schema), T.StructField("compatible_events", T.LongType())])
        return rows.groupBy(*keys, "_chunk").applyInArrow(_gated_support(config, evidence.columns), schema)

    def within_reach(*extra: str) -> Column:
        by = ", ".join(f"`{k}`" for k in (*keys, "_chunk", *extra))
        span = f"RANGE BETWEEN {delta!r}D PRECEDING AND {delta!r}D FOLLOWING"
        return F.expr(f"count(*) OVER (PARTITION BY {by} ORDER BY timestamp_s {span})")

    counted = rows.withColumn("_all", within_reach()).withColumn("_same", within_reach("sensor_id"))
    return (
        counted.filter("_own")
        .withColumn("compatible_events", F.col("_all") - F.col("_same"))
        .drop("_all", "_same", "_own", "_chunk", "_init", "_width", "_warm")
    )


def _parts(n: Column, cell_rows: int) -> Column:
    """In how many parts a cell of ``n`` rows is dealt."""
    return F.least(F.ceil(n / cell_rows), 2 + F.floor(n / CELL_ROWS), F.lit(PARTS)).cast("int")


def _shared_area(a: str, b: str) -> Column:
    """Area that the boxes of two sides have in common; their corners are flat columns without nulls."""
    (ax1, ay1, ax2, ay2), (bx1, by1, bx2, by2) = ([F.col(f"{p}__{c}") for c in BBOX.names] for p in (a, b))
    wide, high = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    return F.greatest(F.lit(0.0), wide) * F.greatest(F.lit(0.0), high)


def compatible_pairs(
    evidence: DataFrame, config: FusionConfig | None = None, *, scope: Sequence[str] = (), cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Pairs of events that could corroborate each other (J2), each once.

    ``a_*`` and ``b_*`` hold the key (``run_id``, ``sensor_id``, ``event_id``, ``timestamp_s``) of either, the first in
    the order of time, sensor, event and run as ``a``; ``time_gap_s``, and ``iou`` (null without two boxes).

    A band join over cells of ``CELL_REACHES`` reaches: every event is ``a`` in its own cell, and ``b`` there and, within
    reach of its start, in the cell before, so a pair has one owner.  In a cell above ``cell_rows`` rows the ``b`` are
    dealt by a hash and each part meets all ``a``; where those are many too, both sides are dealt, so no task holds a
    cell.  A side travels once per part of the other, ``PARTS`` at most.  Tasks follow the rows, not their bytes: a task
    sorts about ``PAIR_ROWS`` of them, which needs no disk.
    """
    config = config or FusionConfig()
    keys = group_keys(config, scope)
    reach = padded_reach(float(config.max_time_delta_s))
    width = CELL_REACHES * reach
    names = ["run_id", "sensor_id", "event_id", "timestamp_s"]
    group = F.to_json(F.struct(*keys))  # null keys are left out, so equal nulls meet
    corners = {f"_{c}": F.col("bbox")[c].cast("double") for c in BBOX.names}
    # greatest() and least() pass over a null; so does a corner further out than all others, and it takes no test
    outmost = {c: F.lit(-sys.float_info.max if c.endswith("1") else sys.float_info.max) for c in corners}
    rows = evidence.select(
        *scope, *[c for c in names if c not in scope], F.col("bbox").isNotNull().alias("_boxed"), *[v.alias(c) for c, v in corners.items()],
        F.floor(F.col("timestamp_s") / width).cast("long").alias("_cell"), group.alias("_group"))
    rows = materialize(rows, "pair-rows")
    before = F.when(F.col("timestamp_s") <= F.col("_cell") * width + reach, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    targets = rows.withColumn("_back", F.explode(before)).withColumn("_cell", F.col("_cell") - F.col("_back"))
    place = ["_group", "_cell"]
    sizes = targets.groupBy(*place).agg(F.count_if(F.col("_back") == 0).alias("_a"), F.count("*").alias("_b"))
    sizes = materialize(sizes.select(
        *place, "_a", "_b", F.least(1 + F.floor(F.col("_a") / CELL_ROWS), F.lit(PARTS)).cast("int").alias("_askers"),
        _parts(F.col("_b"), cell_rows).alias("_asked")).filter("_a > 0"), "pair-cells")
    copies = sizes.agg(F.sum(F.col("_a") * F.col("_asked") + F.col("_b") * F.col("_askers"))).first()[0] or 0
    tasks = max(task_count(rows.sparkSession), min(math.ceil(copies / PAIR_ROWS), PAIR_TASKS))
    dealt = few(sizes.drop("_a", "_b"))

    def side(prefix: str, df: DataFrame, mine: str, other: str, part: Column, also: Sequence[Column] = ()) -> DataFrame:
        """Rows dealt to ``mine`` parts, each copied for every part of the other side."""
        x1, y1, x2, y2 = (F.col(c) for c in corners)
        area = F.greatest(F.lit(0.0), x2 - x1) * F.greatest(F.lit(0.0), y2 - y1)
        given = {**{c: F.col(c) for c in (*names, "_boxed")}, **{c: F.coalesce(F.col(c), v) for c, v in outmost.items()}, "_area": area}
        cut = df.join(dealt, place).withColumn("_mine", F.pmod(F.xxhash64(*names), F.col(mine)).cast("int"))
        cut = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        cut = cut.select(*place, part.cast("int").alias("_part"), *[c.alias(f"{prefix}_{n}") for n, c in given.items()], *also)
        return cut.repartition(tasks, *meet)

    meet = ["_cell", "_part", "_group"]
    left = side("a", rows, "_askers", "_asked", F.col("_mine") * F.col("_asked") + F.col("_other"), [F.col(k).alias(f"_key_{k}") for k in scope])
    right = side("b", targets, "_asked", "_askers", F.col("_other") * F.col("_asked") + F.col("_mine"))
    a_t, b_t, a_s, b_s = (F.col(f"{p}_{c}") for c in ("timestamp_s", "sensor_id") for p in "ab")
    gap = F.abs(a_t - b_t)
    # sensors differ, so they decide between events of one time; null comes first
    first = (a_t < b_t) | F.coalesce(a_s < b_s, a_s.isNull())
    pairs = left.join(right.hint("merge"), meet).where((a_t <= b_t) & (gap <= float(config.max_time_delta_s)) & ~a_s.eqNullSafe(b_s) & first)
    # as a generated column, this is worked out once per pair; a plain one is put in wherever it is used, and Java compiles
    # no method of that length
    pairs = pairs.withColumn("_shared", F.explode(F.array(_shared_area("a", "b"))))
    union = F.col("a__area") + F.col("b__area") - F.col("_shared")
    value = F.when((F.col("_shared") > 0) & (union > 0), F.col("_shared") / union).otherwise(F.lit(0.0))
    boxed = F.col("a__boxed") & F.col("b__boxed")
    if config.spatial_iou_threshold is not None:
        pairs = pairs.where(boxed & (value >= float(config.spatial_iou_threshold)))
    pairs = pairs.withColumn("iou", F.when(boxed, value))
    return pairs.select(*[F.col(f"_key_{k}").alias(k) for k in scope], *[f"{p}_{c}" for p in "ab" for c in names], gap.alias("time_gap_s"), "iou")


def _gated_support(config: FusionConfig, columns: Sequence[str]):
    """Counts one chunk's compatible events: other sensor, within reach, both boxes known and overlapping enough."""
    delta, gate = float(config.max_time_delta_s), float(config.spatial_iou_threshold)

    def count(table: pa.Table) -> pa.Table:
        table = table.sort_by("timestamp_s")
        t = table.column("timestamp_s").to_numpy()
        sensor = np.unique(np.array(["" if v is None else f"={v}" for v in table.column("sensor_id").to_pylist()]), return_inverse=True)[1]
        boxes = [None if b is None or None in b.values() else [b[c] for c in ("x1", "y1", "x2", "y2")] for b in table.column("bbox").to_pylist()]
        known = np.array([b is not None for b in boxes])
        box = np.array([b or [0.0] * 4 for b in boxes], dtype=np.float64).reshape(-1, 4)
        area = np.maximum(0.0, box[:, 2] - box[:, 0]) * np.maximum(0.0, box[:, 3] - box[:, 1])
        found = np.zeros(len(t), dtype=np.int64)
        for i, (low, high) in enumerate(zip(*candidate_windows(t, delta))):
            if not known[i]:
                continue
            other = slice(low, high)
            w = np.minimum(box[i, 2], box[other, 2]) - np.maximum(box[i, 0], box[other, 0])
            h = np.minimum(box[i, 3], box[other, 3]) - np.maximum(box[i, 1], box[other, 1])
            inside = np.maximum(0.0, w) * np.maximum(0.0, h)
            union = area[i] + area[other] - inside
            iou = np.divide(inside, union, out=np.zeros_like(inside), where=union > 0)
            near = (np.abs(t[i] - t[other]) <= delta) & (sensor[other] != sensor[i]) & known[other]
            found[i] = np.count_nonzero(near & (iou >= gate))
        own = table.append_column("compatible_events", pa.array(found)).filter(table.column("_own"))
        return own.select([*columns, "compatible_events"])

    return count


def fusion_summary(fused: DataFrame, *, limit: int = 30, scope: Sequence[str] = ()) -> DataFrame:
    """Fused events per type, most frequent first (A5)."""
    label = F.coalesce(F.col("event_type"), F.lit("unknown"))
    counts = fused.groupBy(*scope, label.alias("label")).agg(F.count("*").alias("events"))
    if not scope:
        return counts.orderBy(F.col("events").desc(), "label").limit(limit)
    best = Window.partitionBy(*scope).orderBy(F.col("events").desc(), "label")
    return counts.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") <= limit).drop("_r")


def fusion_counters(evidence: DataFrame, fusion: Fusion) -> DataFrame:
    """Input events, distinct sensors, fused events, alerts, contributors as one row."""
    sensors = evidence.groupBy("sensor_id").agg(F.count("*").alias("n"))
    total = sensors.agg(F.sum("n").alias("input_events"), F.count("*").alias("distinct_sensors"))
    if fusion.counts is not None:
        return total.crossJoin(fusion.counts)  # one row with one row
    one = total
    for name, df in (
        ("fused_events", fusion.events), ("fused_alerts", fusion.alerts), ("contributors", fusion.contributors)
    ):
        one = one.crossJoin(df.agg(F.count("*").alias(name)))  # one row with one row
    return one
