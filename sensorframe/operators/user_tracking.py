"""User trackers in parallel chunks of one key.

A tracker that only has ``update`` is serial per key.  One that can also hand its state over runs in chunks of frames
at once (:mod:`.handoff`): each chunk replays a short warm-up, says from which state it went on and which it left,
and is run again where that isn't its predecessor's; the maps from entry to exit state that chunks have shown are
composed by pointer doubling.  The rows equal those of one tracker that saw all frames.

The protocol, beside ``update(frame_rows) -> rows``:

* ``dump() -> (text, ids, issued)``: the state as text, without track ids; the ids of its live tracks in the order in
  which the text has them; and how many ids were issued since ``load`` or the start.  Two trackers with the same text
  must go on alike.  New ids count up from 1 in the order of births.
* ``load(text, ids)``: go on from a state; its tracks have these ids (negative numbers), new ids start at 1 again.

``update`` gives a table, or a mapping of the columns to lists, which costs far less than a small table per frame.
It may put ids into the column ``track_id``; they come out as the serial tracker's.  What only grows, such as
hits, doesn't belong in the state: it would differ after any warm-up, so chunks would run one after the other.  Take
it from :func:`.tracking.observation_history`.
"""

from __future__ import annotations

import json
from base64 import b64decode, b64encode
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import materialize
from .handoff import SUMMARY, SUMMARY_FIELDS, changes, nullable, run_chunks, settle
from .sequence import number_rows, with_halo

ORDER = ["frame_ordinal", "detection_index"]
NAME = "user-tracks"


class ChunkedTracker(Protocol):
    def update(self, frame: pd.DataFrame) -> pd.DataFrame | dict[str, list]: ...

    def dump(self) -> tuple[str, list[int], int]: ...

    def load(self, text: str, ids: list[int]) -> None: ...


def require_protocol(make_tracker: Callable[[], ChunkedTracker]) -> None:
    tracker = make_tracker()
    lacking = [m for m in ("update", "dump", "load") if not callable(getattr(tracker, m, None))]
    if lacking:
        raise TypeError(f"{type(tracker).__name__} can't run in chunks: it has no {', '.join(lacking)}")


def slices(rows: pd.DataFrame, bounds: list[int]) -> Iterator[pd.DataFrame]:
    """Tables of the frames that begin at ``bounds``, each counted from 0; the last bound ends the last one."""
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        frame = rows.iloc[lo:hi]
        frame.index = pd.RangeIndex(hi - lo)
        yield frame


def gathered(parts: list, columns: list[str]) -> pd.DataFrame:
    """One table of what ``update`` gave for many frames, as tables or as mappings of columns to lists."""
    if all(isinstance(p, pd.DataFrame) for p in parts):
        return pd.concat(parts, ignore_index=True)[columns]
    lists: dict[str, list] = {c: [] for c in columns}
    for part in parts:
        for c, values in lists.items():
            values.extend(part[c])
    return pd.DataFrame(lists, dtype=object)


def _coded(text: str, n: int) -> str:
    return b64encode(json.dumps([text, n]).encode()).decode()


class _Chunk:
    """One chunk of one key while its frames stream by."""

    def __init__(self, make_tracker: Callable[[], ChunkedTracker], init: str | None):
        self.make, self.tracker, self.entered, self.used = make_tracker, make_tracker(), False, ""
        self.fresh, self.init = self.tracker.dump()[0], init

    def _state(self, text: str, ids: list[int]) -> str:
        return "" if text == self.fresh and not ids else _coded(text, len(ids))

    def _enter(self) -> None:
        self.entered = True
        if self.init is None:
            text, ids, _ = self.tracker.dump()
            self.used = self._state(text, ids)
        else:
            self.used = self.init
        self.tracker = self.make()
        if self.used:
            text, n = json.loads(b64decode(self.used))
            self.tracker.load(text, [-1 - i for i in range(n)])

    def frame(self, rows: pd.DataFrame, own: bool) -> pd.DataFrame | dict[str, list] | None:
        if own and not self.entered:
            self._enter()
        if not own and self.init is not None:
            return None
        out = self.tracker.update(rows)
        return out if own else None

    def close(self, head: dict) -> list[dict]:
        if not self.entered:
            return []
        text, ids, issued = self.tracker.dump()
        rows = [{**head, "kind": "end", "slot": i, "local": int(t)} for i, t in enumerate(ids)]
        return [*rows, {**head, "kind": SUMMARY, "used_state": self.used, "end_state": self._state(text, ids), "order_mattered": False, "issued": int(issued)}]


def _kernel(make_tracker: Callable[[], ChunkedTracker], keys: list[str], given: list[str], schema: T.StructType, fields: T.StructType):
    group, out_schema, columns = [*keys, "_chunk"], to_arrow_schema(schema), fields.names

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: _Chunk | None = None
        head: dict = {}
        pending: pa.Table | None = None

        def advance(table: pa.Table, final: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            nonlocal chunk, head
            opens = changes(table, group)
            starts = opens | changes(table, [*group, "frame_ordinal"])
            edges = np.flatnonzero(starts).tolist()
            stop = table.num_rows if final else edges[-1]
            bounds = [e for e in edges if e < stop] + [stop]
            own = table.column("_own").to_numpy()
            rows = table.select(given).to_pandas()
            out: list[pd.DataFrame | dict[str, list]] = []
            side: list[dict] = []
            done: list[pa.RecordBatch] = []

            def flush() -> None:
                """Rows of the chunk so far, under its number."""
                if out:
                    part = pa.Table.from_pandas(gathered(out, columns), to_arrow_schema(fields), preserve_index=False).combine_chunks()
                    n = part.num_rows
                    extra = {"_chunk": pa.array([head["_chunk"]] * n, pa.int64()), "kind": pa.array(["row"] * n)}
                    arrays = [extra[f.name] if f.name in extra else part.column(f.name).combine_chunks() if f.name in columns else pa.nulls(n, f.type) for f in out_schema]
                    if n:
                        done.append(pa.RecordBatch.from_arrays(arrays, schema=out_schema))
                    out.clear()

            for lo, frame in zip(bounds, slices(rows, bounds)):
                if opens[lo]:
                    now = {k: table.column(k)[lo].as_py() for k in group}
                    if chunk is None or now != head:
                        flush()
                        if chunk is not None:
                            side += chunk.close(head)
                        chunk, head = _Chunk(make_tracker, table.column("_init")[lo].as_py()), now
                got = chunk.frame(frame, bool(own[lo]))
                if got is not None and len(got):
                    out.append(got)
            flush()
            if final and chunk is not None:
                side += chunk.close(head)
            if side:
                done.append(pa.RecordBatch.from_pylist(side, schema=out_schema))
            return done, table.slice(stop)

        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                table = table if pending is None or not pending.num_rows else pa.concat_tables([pending, table])
                done, pending = advance(table.combine_chunks(), False)
                yield from done
        if pending is not None and pending.num_rows:
            yield from advance(pending.combine_chunks(), True)[0]

    return scan


def _keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_key", F.to_json(F.struct(*keys)))


def _global_ids(rows: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """``track_id`` as the serial tracker counts: births of earlier chunks come first, inherited tracks keep theirs."""
    summary = _keyed(results.filter(F.col("kind") == SUMMARY), keys)
    before = Window.partitionBy("_key").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = summary.select("_key", "_chunk", F.coalesce(F.sum("issued").over(before), F.lit(0)).alias("_offset"))
    ends = _keyed(results.filter(F.col("kind") == "end"), keys).select("_key", "_chunk", "slot", "local").join(offsets, ["_key", "_chunk"])
    born = F.when(F.col("local") > 0, F.col("local") + F.col("_offset"))
    # a slot that isn't born here is slot -1 - local of the chunk before: follow these links, twice as far each round
    now = materialize(ends.select("_key", "_chunk", "slot", born.alias("id"), (F.col("_chunk") - 1).alias("_to"), (-1 - F.col("local")).alias("_to_slot")), f"{NAME}-slots")
    while not now.filter("id IS NULL").isEmpty():
        far = now.select("_key", F.col("_chunk").alias("_to"), F.col("slot").alias("_to_slot"), F.col("id").alias("_id"), F.col("_to").alias("_to2"), F.col("_to_slot").alias("_slot2"))
        step = now.join(far, ["_key", "_to", "_to_slot"], "left")
        now = materialize(step.select("_key", "_chunk", "slot", F.coalesce("id", "_id").alias("id"), F.coalesce("_to2", "_to").alias("_to"), F.coalesce("_slot2", "_to_slot").alias("_to_slot")), f"{NAME}-slots")
    inherited = now.select("_key", (F.col("_chunk") + 1).alias("_chunk"), (-1 - F.col("slot")).cast("long").alias("track_id"), "id")
    named = _keyed(rows, keys).withColumn("track_id", F.col("track_id").cast("long"))
    joined = named.join(offsets, ["_key", "_chunk"]).join(inherited, ["_key", "_chunk", "track_id"], "left")
    return joined.withColumn("track_id", F.when(F.col("track_id") > 0, F.col("track_id") + F.col("_offset")).otherwise(F.col("id")))


def track_in_chunks(
    detections: DataFrame, make_tracker: Callable[[], ChunkedTracker], schema: T.StructType, keys: Sequence[str], *, chunk_frames: int, warmup_frames: int = 64
) -> DataFrame:
    """Rows of ``schema`` (which has the keys) of a tracker that follows the protocol above."""
    require_protocol(make_tracker)
    keys = list(keys)
    lacking = [k for k in keys if k not in schema.names]
    if lacking:
        raise ValueError(f"the tracker's schema lacks its keys {lacking}")
    warmup = max(1, min(warmup_frames, chunk_frames // 2))
    place = F.floor(F.col("frame_ordinal") / chunk_frames)
    stored = materialize(_keyed(detections, keys).withColumn("_place", place), f"{NAME}-rows")
    # chunks without rows are left out of the count, as a tracker's state outlives them
    chunks = number_rows(stored.select("_key", "_place").distinct(), ["_key"], F.floor(F.col("_place") / 4096), [F.col("_place")], "_at")
    rows = stored.join(chunks, ["_key", "_place"])
    rows = with_halo(rows, F.col("_at"), F.col("frame_ordinal") % chunk_frames >= chunk_frames - warmup)
    rows = materialize(rows.drop("_key", "_place", "_at").withColumn("_init", F.lit(None).cast("string")), f"{NAME}-rows")
    extra = [T.StructField("_chunk", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("slot", T.LongType()), T.StructField("local", T.LongType()), T.StructField("issued", T.LongType())]
    whole = T.StructType(nullable(schema) + extra + SUMMARY_FIELDS)
    kernel = _kernel(make_tracker, keys, detections.columns, whole, T.StructType(nullable(schema)))
    args = (keys, ORDER, kernel, whole, NAME)
    results, _ = settle(rows, run_chunks(rows, *args), *args)
    out = results.filter(F.col("kind") == "row")
    if "track_id" in schema.names:
        out = _global_ids(out, results, keys)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
