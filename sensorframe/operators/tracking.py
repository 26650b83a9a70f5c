"""Greedy same-label IoU tracking of detections (batch).

The association is order-dependent, so it runs through
:mod:`sensorframe.operators.handoff`: detections are grouped by
``(run_id, label)`` (labels never compete) and cut into chunks of
``chunk_frames`` processed frames.  The kernel streams a chunk frame by frame
and keeps only the live tracks in memory.

A track is identified inside a chunk by its *segment*: the detection that gave
birth to it, or the detection it was last matched to before the chunk began.
Segments are then linked across chunks by pointer doubling on the (small) end
states, which yields birth, hits and the run-wide track number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import materialize
from ..schemas import TRACKS, conform
from .handoff import SUMMARY, SUMMARY_FIELDS, changes, nullable, replace_chunks, rerun, run_chunks, settle
from .sequence import BUCKET, number_rows, with_halo

KEYS = ["run_id", "label"]
ORDER = ["frame_ordinal", "detection_index"]
NAME = "iou"
PAIRS = 1 << 20
_ROOT = ["root_ordinal", "root_index", "root_frame_number", "root_timestamp_s", "segment_hits", "inherited"]
_CARRIED = [
    "frame_number", "timestamp_s", "confidence", "scenario_role", "sensor_id", "modality", "source_path",
    "object_id", "x1", "y1", "x2", "y2",
]


class _Track:
    __slots__ = ("box", "at", "root", "hits", "inherited")

    def __init__(self, box, at, root, hits, inherited):
        self.box, self.at, self.root, self.hits, self.inherited = box, at, root, hits, inherited


def _overlap(a, b) -> float:
    w = min(a[2], b[2]) - max(a[0], b[0])
    h = min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    inter = w * h
    union = (
        max(0, a[2] - a[0]) * max(0, a[3] - a[1]) + max(0, b[2] - b[0]) * max(0, b[3] - b[1]) - inter
    )
    return inter / union if union > 0 else 0.0


def _areas(c: np.ndarray) -> np.ndarray:
    return np.clip(c[:, 2] - c[:, 0], 0, None) * np.clip(c[:, 3] - c[:, 1], 0, None)


def _overlapping(tracks: list[_Track], boxes: list[tuple], threshold: float) -> list[tuple[float, int, int]]:
    """(-iou, track position, detection position) of the pairs that overlap by at least the threshold, best first.

    A few pairs are compared one by one.  Otherwise boxes are sorted by their left edge, so each track meets only
    those that can reach it, in blocks of ``PAIRS`` pairs; no matrix of tracks and boxes is made.
    """
    if len(tracks) * len(boxes) <= 24:
        pairs = [(-_overlap(t.box, b), i, j) for i, t in enumerate(tracks) for j, b in enumerate(boxes)]
        return sorted(p for p in pairs if p[0] < 0 and -p[0] >= threshold)
    a = np.array([t.box for t in tracks], dtype=np.float64)
    b = np.array(boxes, dtype=np.float64)
    order = np.argsort(b[:, 0], kind="stable")
    left, widest = b[order, 0], max(0.0, float((b[:, 2] - b[:, 0]).max()))
    low = np.searchsorted(left, a[:, 0] - widest)
    count = np.maximum(np.searchsorted(left, a[:, 2]) - low, 0)
    total = np.concatenate([[0], np.cumsum(count)])
    area_a, area_b, out, begin = _areas(a), _areas(b), [], 0
    while begin < len(a):
        end = max(begin + 1, int(np.searchsorted(total, total[begin] + PAIRS, side="right")) - 1)
        n = count[begin:end]
        i = np.repeat(np.arange(begin, end), n)
        j = order[np.repeat(low[begin:end] - total[begin:end], n) + np.arange(total[begin], total[end])]
        w = np.minimum(a[i, 2], b[j, 2]) - np.maximum(a[i, 0], b[j, 0])
        h = np.minimum(a[i, 3], b[j, 3]) - np.maximum(a[i, 1], b[j, 1])
        meet = (w > 0) & (h > 0)
        i, j, inter = i[meet], j[meet], (w * h)[meet]
        union = area_a[i] + area_b[j] - inter
        value = np.divide(inter, union, out=np.zeros_like(inter), where=union > 0)
        keep = (value > 0) & (value >= threshold)
        out += zip((-value[keep]).tolist(), i[keep].tolist(), j[keep].tolist())
        begin = end
    return sorted(out)


def associate(tracks: list[_Track], boxes: list[tuple], threshold: float) -> tuple[dict[int, int], bool]:
    """Greedy one-to-one pairs ``{detection: track}`` of one frame.

    The flag tells whether two inherited tracks tied on one detection, i.e.
    whether their relative age may have decided the result.  At a threshold of
    0 all pairs count: those that don't overlap come last, in order.
    """
    pairs = _overlapping(tracks, boxes, threshold)
    taken: set[int] = set()
    match: dict[int, int] = {}
    for _, i, j in pairs:
        if i not in taken and j not in match:
            taken.add(i)
            match[j] = i
    seen = set()
    tie = False
    for value, i, j in pairs if len(tracks) > 1 else []:
        if tracks[i].inherited:
            if (value, j) in seen:
                tie = True
                break
            seen.add((value, j))
    if threshold <= 0:
        apart = sum(t.inherited for t in tracks)
        near = Counter(j for _, i, j in pairs if tracks[i].inherited)
        tie = tie or any(apart - near[j] > 1 for j in range(len(boxes)))
        free = [j for j in range(len(boxes)) if j not in match]
        match |= dict(zip(free, (i for i in range(len(tracks)) if i not in taken)))
    return match, tie


def _state(tracks: list[_Track], boundary: int, reach: int) -> list[_Track]:
    return [t for t in tracks if boundary - t.at[0] <= reach]


def _text(tracks: list[_Track]) -> str:
    return ";".join(f"{t.at[0]}:{t.at[1]}" for t in tracks)


class _ChunkScan:
    """State of one (run, label, chunk) while its frames stream by."""

    def __init__(self, key: tuple, init: str | None, settings: tuple[float, int, int]):
        self.key, self.init = key, init
        self.threshold, self.reach, self.span = settings
        self.start = key[-1] * self.span
        self.tracks: list[_Track] = []
        self.warm: dict[tuple[int, int], tuple] = {}
        self.entered = False
        self.used = ""
        self.tie = False

    def _enter(self) -> None:
        """Cross the chunk boundary: freeze what is alive as inherited segments."""
        self.entered = True
        if self.init is None:
            self.tracks = _state(self.tracks, self.start, self.reach)
        else:
            self.tracks = []
            for item in filter(None, self.init.split(";")):
                at = tuple(int(v) for v in item.split(":"))
                self.tracks.append(_Track(self.warm[at], at, None, 0, True))
        for t in self.tracks:
            t.root, t.hits, t.inherited = (*t.at, None, None), 0, True
        self.used = _text(self.tracks)
        self.warm = {}

    def frame(self, ordinal, own, indexes, boxes, numbers, stamps, out, base) -> None:
        if own and not self.entered:
            self._enter()
        if not own and self.init is not None:
            if self.start - ordinal <= self.reach:
                for index, b in zip(indexes, boxes):
                    self.warm[(ordinal, index)] = b
            return
        if self.tracks:
            self.tracks = [t for t in self.tracks if ordinal - t.at[0] <= self.reach]
        match, tie = associate(self.tracks, boxes, self.threshold) if self.tracks else ({}, False)
        self.tie = self.tie or (tie and own)
        for j, b in enumerate(boxes):
            at = (ordinal, indexes[j])
            i = match.get(j)
            if i is None:
                t = _Track(b, at, (*at, numbers[j], stamps[j]), 1, False)
                self.tracks.append(t)
            else:
                t = self.tracks[i]
                t.box, t.at = b, at
                t.hits += 1
            if own:
                out[base + j] = (*t.root, t.hits, t.inherited)

    def close(self) -> tuple[list[dict], bool]:
        if not self.entered:
            return [], False
        alive = _state(self.tracks, self.start + self.span, self.reach)
        head = dict(zip([*KEYS, "_chunk"], self.key))
        rows = [
            {
                **head, "kind": "end", "frame_ordinal": t.at[0], "detection_index": t.at[1],
                **dict(zip(_ROOT, (*t.root, t.hits, t.inherited))),
            }
            for t in alive
        ]
        rows.append(
            {**head, "kind": SUMMARY, "used_state": self.used, "end_state": _text(alive),
             "order_mattered": self.tie}
        )
        return rows, True


def _values(column: pa.ChunkedArray) -> list:
    """Python values of a column, by way of NumPy when it has no nulls."""
    return column.to_pylist() if column.null_count else column.to_numpy().tolist()


def _kernel(threshold: float, max_missed: int, chunk_frames: int, schema: T.StructType):
    settings = (threshold, max_missed + 1, chunk_frames)
    out_schema = to_arrow_schema(schema)
    group = [*KEYS, "_chunk"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _ChunkScan | None = None
        pending: pa.Table | None = None

        def advance(table: pa.Table, final: bool):
            """Process every complete frame; return the unfinished rest."""
            nonlocal current
            new_group = changes(table, group)
            ordinals = table.column("frame_ordinal").to_numpy()
            starts = new_group.copy()
            starts[1:] |= ordinals[1:] != ordinals[:-1]
            edges = np.flatnonzero(starts).tolist()
            stop = table.num_rows if final else edges[-1]
            bounds = [e for e in edges if e < stop] + [stop]
            side: list[dict] = []
            out: list = [None] * stop
            own = table.column("_own").to_numpy()
            col = {c: _values(table.column(c)) for c in ("detection_index", "frame_number", "timestamp_s")}
            boxes = np.column_stack([table.column(c).to_numpy() for c in ("x1", "y1", "x2", "y2")]).tolist()
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                if new_group[lo]:
                    key = tuple(table.column(k)[lo].as_py() for k in group)
                    if current is None or current.key != key:
                        if current is not None:
                            side += current.close()[0]
                        current = _ChunkScan(key, table.column("_init")[lo].as_py(), settings)
                current.frame(
                    int(ordinals[lo]), bool(own[lo]), col["detection_index"][lo:hi], boxes[lo:hi],
                    col["frame_number"][lo:hi], col["timestamp_s"][lo:hi], out, lo,
                )
            if final and current is not None:
                side += current.close()[0]
            done = table.slice(0, stop)
            mine = np.flatnonzero(own[:stop])
            result = []
            if len(mine):
                picked = done.take(pa.array(mine))
                extra = {name: pa.array(values) for name, values in zip(_ROOT, zip(*[out[i] for i in mine]))}
                n = len(mine)
                arrays = []
                for field in out_schema:
                    if field.name in extra:
                        arrays.append(extra[field.name].cast(field.type))
                    elif field.name == "kind":
                        arrays.append(pa.array(["row"] * n, field.type))
                    elif field.name in picked.column_names:
                        arrays.append(picked.column(field.name).combine_chunks().cast(field.type))
                    else:
                        arrays.append(pa.nulls(n, field.type))
                result.append(pa.RecordBatch.from_arrays(arrays, schema=out_schema))
            if side:
                result.append(pa.RecordBatch.from_pylist(side, schema=out_schema))
            return result, table.slice(stop)

        for batch in batches:
            if batch.num_rows == 0:
                continue
            table = pa.Table.from_batches([batch])
            if pending is not None and pending.num_rows:
                table = pa.concat_tables([pending, table])
            result, pending = advance(table.combine_chunks(), False)
            yield from result
        if pending is not None and pending.num_rows:
            result, _ = advance(pending.combine_chunks(), True)
            yield from result

    return scan


def _true_order(results: DataFrame, ends: DataFrame) -> DataFrame:
    """Chunks where age decided a tie, with the inherited tracks in true birth order."""
    asked = results.filter((F.col("kind") == SUMMARY) & F.col("order_mattered")).select(
        *KEYS, "_chunk", "used_state"
    )
    ages = ends.groupBy(
        F.col("run_id").alias("_e_run"), F.col("label").alias("_e_label"), (F.col("_chunk") + 1).alias("_e_chunk")
    ).agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct("root_ordinal", "root_index", "frame_ordinal", "detection_index"))
                ),
                lambda s: F.concat_ws(":", s["frame_ordinal"].cast("string"), s["detection_index"].cast("string")),
            ),
            ";",
        ).alias("_init")
    )
    cond = (
        asked["run_id"].eqNullSafe(ages["_e_run"])
        & asked["label"].eqNullSafe(ages["_e_label"])
        & (asked["_chunk"] == ages["_e_chunk"])
    )
    return (
        asked.join(ages, cond)
        .filter(F.col("_init") != F.col("used_state"))
        .select(*KEYS, "_chunk", "_init")
    )


def _resolve(ends: DataFrame, name: str) -> DataFrame:
    """Follow inherited segments to their births, doubling the reach each round."""
    ends = materialize(ends, f"{name}-ends")
    while not ends.filter("inherited").isEmpty():
        earlier = ends.select(
            F.col("run_id").alias("_p_run"),
            F.col("label").alias("_p_label"),
            F.col("frame_ordinal").alias("_p_ordinal"),
            F.col("detection_index").alias("_p_index"),
            *[F.col(c).alias(f"_p_{c}") for c in _ROOT],
        )
        cond = (
            F.col("inherited")
            & F.col("run_id").eqNullSafe(F.col("_p_run"))
            & F.col("label").eqNullSafe(F.col("_p_label"))
            & (F.col("root_ordinal") == F.col("_p_ordinal"))
            & (F.col("root_index") == F.col("_p_index"))
        )
        step = ends.join(earlier, cond, "left")
        hop = F.col("inherited")
        ends = materialize(
            step.select(
                *KEYS, "_chunk", *ORDER,
                *[
                    F.when(hop, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c)
                    for c in _ROOT
                    if c not in ("segment_hits",)
                ],
                (F.col("segment_hits") + F.when(hop, F.col("_p_segment_hits")).otherwise(0)).alias("segment_hits"),
            ),
            f"{name}-ends",
        )
    return ends


def track_detections(
    detections: DataFrame,
    *,
    iou_threshold: float = 0.30,
    max_missed_updates: int = 2,
    chunk_frames: int = 2048,
    warmup_frames: int = 64,
) -> DataFrame:
    """Tracks (one row per observation) of all runs in ``detections``.

    ``detections`` needs ``run_id, frame_ordinal, detection_index, label,
    frame_number, timestamp_s, x1..y2``; other contract columns are carried when
    present.  Ages count processed frames, so frames without detections matter:
    ``frame_ordinal`` must come from the frame list.
    """
    if not 0.0 <= iou_threshold <= 1.0:
        raise ValueError(f"iou_threshold {iou_threshold} lies outside [0, 1]")
    if max_missed_updates < 0:
        raise ValueError(f"max_missed_updates {max_missed_updates}: want 0 or more")
    reach = max_missed_updates + 1
    warmup = max(warmup_frames, reach)
    span = max(chunk_frames, 2 * warmup)

    wanted = {f.name: f.dataType for f in TRACKS}
    wanted.update(object_id=T.LongType())
    have = set(detections.columns)
    base = detections.select(
        *KEYS,
        *[F.col(c).cast("long").alias(c) for c in ORDER],
        *[
            (F.col(c) if c in have else F.lit(None)).cast(wanted[c]).alias(c)
            for c in _CARRIED
        ],
    )
    rows = with_halo(
        base,
        F.floor(F.col("frame_ordinal") / span),
        F.col("frame_ordinal") % span >= span - warmup,
    ).withColumn("_init", F.lit(None).cast("string"))
    rows = materialize(rows, "tracks-rows")  # the detector upstream runs once, however many rounds follow
    schema = T.StructType(
        nullable(base.schema)
        + [
            T.StructField("_chunk", T.LongType()),
            T.StructField("kind", T.StringType()),
            T.StructField("root_ordinal", T.LongType()),
            T.StructField("root_index", T.LongType()),
            T.StructField("root_frame_number", T.LongType()),
            T.StructField("root_timestamp_s", T.DoubleType()),
            T.StructField("segment_hits", T.LongType()),
            T.StructField("inherited", T.BooleanType()),
        ]
        + SUMMARY_FIELDS
    )
    kernel = _kernel(float(iou_threshold), int(max_missed_updates), span, schema)
    args = (KEYS, ORDER, kernel, schema, "tracks")

    def follow_ups(results: DataFrame) -> dict[str, DataFrame]:
        return {
            "inherited": results.filter((F.col("kind") == "end") & F.col("inherited")),
            "ties": results.filter((F.col("kind") == SUMMARY) & F.col("order_mattered")),
        }

    results = run_chunks(rows, *args)
    while True:
        results, found = settle(rows, results, *args, also=follow_ups)
        ends = results.filter(F.col("kind") == "end").select(*KEYS, "_chunk", *ORDER, *_ROOT)
        if "inherited" in found:
            ends = _resolve(ends, "tracks")
        if "ties" not in found:
            break
        redo = materialize(_true_order(results, ends), "tracks-ties")
        if redo.isEmpty():
            break
        results = replace_chunks(results, rerun(rows, redo, *args), redo, KEYS)
    return _number(results.filter(F.col("kind") == "row"), ends, span)


def _number(observations: DataFrame, ends: DataFrame, span: int) -> DataFrame:
    """Dense run-wide ids in birth order, then one join from segment to track."""
    at_birth = (~F.col("inherited")) & (F.col("segment_hits") == 1)
    births = observations.filter(at_birth).select("run_id", "label", "root_ordinal", "root_index",
                                                 "root_frame_number", "root_timestamp_s")
    numbered = number_rows(
        births, ["run_id"], F.floor(F.col("root_ordinal") / span),
        [F.col("root_ordinal"), F.col("root_index")], "track_id",
    )
    local = numbered.select(
        "run_id", "label", F.lit(False).alias("inherited"), "root_ordinal", "root_index", "track_id",
        F.lit(0).cast("long").alias("_before"), "root_frame_number", "root_timestamp_s",
    )
    born = numbered.select(
        F.col("run_id").alias("_b_run"), F.col("root_ordinal").alias("_b_ordinal"),
        F.col("root_index").alias("_b_index"), "track_id",
    )
    passed_on = ends.join(
        born,
        F.col("run_id").eqNullSafe(F.col("_b_run"))
        & (F.col("root_ordinal") == F.col("_b_ordinal"))
        & (F.col("root_index") == F.col("_b_index")),
    ).select(
        "run_id", "label", F.lit(True).alias("inherited"), F.col("frame_ordinal").alias("root_ordinal"),
        F.col("detection_index").alias("root_index"), "track_id", F.col("segment_hits").alias("_before"),
        "root_frame_number", "root_timestamp_s",
    )
    segments = local.unionByName(passed_on).select(
        F.col("run_id").alias("_s_run"), F.col("inherited").alias("_s_inherited"),
        F.col("root_ordinal").alias("_s_ordinal"), F.col("root_index").alias("_s_index"), "track_id",
        "_before", F.col("root_frame_number").alias("first_frame_number"),
        F.col("root_timestamp_s").alias("first_timestamp_s"),
    )
    joined = observations.drop("root_frame_number", "root_timestamp_s").join(
        segments,
        F.col("run_id").eqNullSafe(F.col("_s_run"))
        & (F.col("inherited") == F.col("_s_inherited"))
        & (F.col("root_ordinal") == F.col("_s_ordinal"))
        & (F.col("root_index") == F.col("_s_index")),
    )
    return conform(
        joined.withColumn("hits", F.col("segment_hits") + F.col("_before"))
        .withColumn("duration_s", F.greatest(F.lit(0.0), F.col("timestamp_s") - F.col("first_timestamp_s")))
        .withColumn("tracker", F.lit(NAME))
        .withColumn("detection_object_id", F.col("object_id")),
        TRACKS,
    )


def observation_history(tracks: DataFrame) -> DataFrame:
    """Recompute hits and first sighting of a foreign track table.

    Hits are numbered in two levels and first sightings come from ``min_by``,
    so one long track is not sorted in one task.
    """
    first = tracks.groupBy("run_id", "track_id").agg(
        F.min_by(F.struct("frame_number", "timestamp_s"), "frame_ordinal").alias("_first")
    )
    counted = number_rows(
        tracks.drop("hits"), ["run_id", "track_id"], F.floor(F.col("frame_ordinal") / BUCKET),
        [F.col("frame_ordinal")], "hits",
    )
    return (
        counted.drop("first_frame_number", "first_timestamp_s", "duration_s")
        .join(first, ["run_id", "track_id"])
        .withColumn("first_frame_number", F.col("_first.frame_number"))
        .withColumn("first_timestamp_s", F.col("_first.timestamp_s"))
        .withColumn("duration_s", F.greatest(F.lit(0.0), F.col("timestamp_s") - F.col("first_timestamp_s")))
        .drop("_first")
    )


def current_track_states(tracks: DataFrame) -> DataFrame:
    """Latest observation of every track, by partial aggregation."""
    row = F.struct(*tracks.columns)
    return (
        tracks.groupBy("run_id", "track_id").agg(F.max_by(row, "frame_ordinal").alias("_last")).select("_last.*")
    )
