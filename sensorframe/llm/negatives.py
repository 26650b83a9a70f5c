"""Hard negatives by zone maps over blocks in Hilbert order.

Vectors are whole numbers, ``floor(scale * x)``; the score of a row for an anchor is their inner product.  An anchor's
positives are its best other rows of the same label.  For each positive, rows of other labels whose score lies between
``low`` and ``high`` per cent of the positive's are hard negatives; the best few are returned.

Candidates are sorted by label and by the position of their eight most varied components on a Hilbert curve, and
stored as Parquet blocks, one label each, with the least and greatest value of every component (the zone map).  For an
anchor ``a`` and a block the score of any row lies within ``sum(min(a lo, a hi))`` and ``sum(max(a lo, a hi))``:

* positives: the block that holds the anchor gives a score that its last positive has at least; a block of the
  label is read where its upper bound reaches that score;
* negatives: a block of another label is read where its interval meets one of the anchor's windows, unless blocks
  that lie wholly inside the window already hold enough rows that beat its upper bound.

Anchors are packed in groups along the curve, zone maps in pages; a group meets every page (the stated query set
against all zone maps, in blocks, dealt over all tasks by salt), and after that only the blocks chosen for it.  The
results of consecutive blocks are merged in the task, so what is shuffled are a few rows per window and task.  No table
is held whole in one place; the driver gets eight axes per vector length.

Defined results: rows with a null ``vec_id``, label or vector, an empty vector, a null or non-finite component, or
one whose whole number exceeds ``2^31`` or ``sqrt(2^62 / length)`` (the score would not fit) take no part.  Of rows
that share a ``vec_id`` the one with the smallest label, then vector, takes part.  Vectors of different length have no
score.  A positive with a negative score has an empty window.  Ties go to the smaller ``vec_id``.  Where fewer rows
exist, all are returned; an anchor without positives, or an empty table, returns nothing.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorframe.llm.common import materialize, texts_of

BLOCK, GROUP, PAGE, SALT = 256, 256, 256, 64
AXES, BITS = 8, 7
NONE = np.iinfo(np.int64).min
MERGE = 200_000

WHOLE = "vec_id long, label long, anchor boolean, dim int, vector binary"
SPREAD = "dim int, axis int, n long, total double, squares double, low double, high double"
KEYED = "vec_id long, label long, anchor boolean, dim int, vector binary, key long"
BLOCKS = "block long, label long, dim int, n int, ids binary, anchors binary, vectors binary, low binary, high binary"
GROUPS = "gid long, dim int, ids binary, labels binary, floors binary, vectors binary"
PAGES = "page long, dim int, blocks binary, labels binary, sizes binary, low binary, high binary"
CHOSEN = "gid long, block long, chosen binary"
BEST = "gid long, slot int, place int, id long, score long"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], list(names))


def _whole(scale: float):
    """Vectors as little-endian 32-bit whole numbers; those out of range are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v")
            ends, values = flat.offsets.to_numpy(), np.floor(scale * flat.values.to_numpy(zero_copy_only=False))
            keep, out = [], []
            for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                if np.abs(values[i:j]).max() <= min(2**31 - 1, int((2**62 / (j - i)) ** 0.5)):
                    keep.append(k)
                    out.append(values[i:j].astype("<i4").tobytes())
            kept = [batch.column(c).take(pa.array(keep, pa.int64())) for c in ("vec_id", "label", "anchor")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array([len(o) // 4 for o in out], pa.int32()), pa.array(out, pa.binary())], ["vec_id", "label", "anchor", "dim", "vector"])

    return run


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per vector length of a batch: the length, its rows and their vectors as a matrix."""
    dims, raw = batch.column("dim").to_numpy(), texts_of(batch.column("vector"))
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield dim, rows, np.frombuffer(b"".join(raw[i] for i in rows), "<i4").reshape(-1, dim)


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, sums and limits of every component."""
    for batch in batches:
        for dim, rows, x in _by_dim(batch):
            x = x.astype(np.float64)
            columns = [[dim] * dim, range(dim), [len(rows)] * dim, x.sum(0), (x * x).sum(0), x.min(0), x.max(0)]
            yield _batch(SPREAD, [list(c) for c in columns])


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with whole coordinates below ``2**bits`` (Skilling, 2004)."""
    x = x.astype(np.int64).copy()
    dims, top = x.shape[1], 1 << (bits - 1)
    step = top
    while step > 1:
        low = step - 1
        for i in range(dims):
            turned = (x[:, i] & step) > 0
            swapped = np.where(turned, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turned, low, swapped)
            x[:, i] ^= swapped
        step >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    flips, step = np.zeros(len(x), np.int64), top
    while step > 1:
        flips ^= np.where(x[:, -1] & step, step - 1, 0)
        step >>= 1
    x ^= flips[:, None]
    key = np.zeros(len(x), np.int64)
    for b in reversed(range(bits)):
        for i in range(dims):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def _keyed(axes: dict[int, list[tuple[int, float, float]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = np.zeros(batch.num_rows, np.int64)
            for dim, rows, x in _by_dim(batch):
                chosen = axes[dim]
                low, high = np.array([a[1] for a in chosen]), np.array([a[2] for a in chosen])
                part = (x[:, [a[0] for a in chosen]] - low) / np.maximum(high - low, 1.0)
                key[rows] = hilbert(np.clip(part * (1 << BITS), 0, (1 << BITS) - 1), BITS)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], [*batch.schema.names, "key"])

    return run


def _blocks(size: int):
    """Blocks of at most ``size`` consecutive rows of one label and vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 40
        now, held = None, []

        def out() -> pa.RecordBatch:
            nonlocal block, held
            part, held = held[:size], held[size:]
            part.sort(key=lambda r: r[0])  # ties then go to the smaller id
            x = np.frombuffer(b"".join(r[2] for r in part), "<i4").reshape(len(part), -1)
            ids, anchors = np.array([r[0] for r in part], "<i8"), np.array([r[1] for r in part], bool)
            block += 1
            return _batch(BLOCKS, [[c] for c in (block, *now, len(part), ids.tobytes(), anchors.tobytes(), x.tobytes(), x.min(0).tobytes(), x.max(0).tobytes())])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("vec_id", "anchor", "label", "dim")), texts_of(batch.column("vector")), strict=True)
            for vec_id, anchor, label, dim, vector in rows:
                if now != (label, dim):
                    if held:
                        yield out()
                    now = (label, dim)
                held.append((vec_id, anchor, vector))
                if len(held) >= size:
                    yield out()
        if held:
            yield out()

    return run


def _matrix(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4").reshape(-1, dim)


def _exact(a: np.ndarray, b: np.ndarray):
    """Both as doubles where all sums of products stay below 2^53, else as 64-bit whole numbers."""
    most = [max(abs(int(m.min())), abs(int(m.max()))) if m.size else 0 for m in (a, b)]
    kind = np.float64 if 2 * a.shape[1] * most[0] * most[1] < 2**53 else np.int64
    return a.astype(kind), b.astype(kind)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` and ``b``."""
    x, y = _exact(a, b)
    return (x @ y.T).astype(np.int64)


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that a row within a zone map can have, per row of ``a`` and zone map."""
    x, ends = _exact(a, np.concatenate([low, high]))
    low, high = ends[: len(low)].T, ends[len(low) :].T
    up, down = np.maximum(x, 0), np.minimum(x, 0)
    return (up @ low + down @ high).astype(np.int64), (up @ high + down @ low).astype(np.int64)


def _groups(size: int, positives: int):
    """Anchors in the order of the blocks, each with a score that its last positive has at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, now, held = TaskContext.get().partitionId() << 40, None, []

        def out() -> pa.RecordBatch:
            nonlocal gid, held
            part, held = held[:size], held[size:]
            gid += 1
            ids, labels, floors = (np.array([r[k] for r in part], "<i8").tobytes() for k in range(3))
            return _batch(GROUPS, [[c] for c in (gid, now, ids, labels, floors, b"".join(r[3] for r in part))])

        for batch in batches:
            for row in batch.to_pylist():
                if now != row["dim"]:
                    if held:
                        yield out()
                    now = row["dim"]
                x, ids = _matrix(row["vectors"], now), np.frombuffer(row["ids"], "<i8")
                at = np.flatnonzero(np.frombuffer(row["anchors"], bool))
                if not len(at):
                    continue
                found = scores(x[at], x)
                found[np.arange(len(at)), at] = NONE
                floors = np.sort(found, axis=1)[:, -positives] if len(ids) > positives else np.full(len(at), NONE)
                held += [(int(ids[k]), row["label"], int(f), x[k].tobytes()) for k, f in zip(at, floors, strict=True)]
                while len(held) >= size:
                    yield out()
        if held:
            yield out()

    return run


def _pages(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, held = TaskContext.get().partitionId() << 40, []

        def out() -> pa.RecordBatch:
            nonlocal page, held
            page += 1
            whole = [np.array([r[c] for r in held], "<i8").tobytes() for c in ("block", "label", "n")]
            row, held = [page, held[0]["dim"], *whole, b"".join(r["low"] for r in held), b"".join(r["high"] for r in held)], []
            return _batch(PAGES, [[c] for c in row])

        for batch in batches:
            for row in batch.to_pylist():
                if held and (len(held) >= size or held[0]["dim"] != row["dim"]):
                    yield out()
                held.append(row)
        if held:
            yield out()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _windows(row: dict, n: int, places: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score per anchor and positive; an empty window where there is no such positive."""
    least, most = np.full((n, places), 1, np.int64), np.full((n, places), 0, np.int64)
    for p in row["found"]:
        if p["score"] >= 0:
            least[p["slot"], p["place"]] = -(-low * p["score"] // 100)
            most[p["slot"], p["place"]] = high * p["score"] // 100
    return least, most


def _choose(positives: int, negatives: int, low: int, high: int):
    """Which blocks of a page the anchors of a group must read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            dim, a = row["dim"], _matrix(row["vectors"], row["dim"])
            blocks, kinds, sizes = (np.frombuffer(row[c], "<i8") for c in ("blocks", "block_labels", "sizes"))
            least, most = bounds(a, _matrix(row["low"], dim), _matrix(row["high"], dim))
            same = np.frombuffer(row["labels"], "<i8")[:, None] == kinds
            if "found" not in row:
                need = same & (most >= np.frombuffer(row["floors"], "<i8")[:, None])
            else:
                need = np.zeros(same.shape, bool)
                for begin, end in zip(*(w.T for w in _windows(row, len(a), positives, low, high)), strict=True):
                    begin, end = begin[:, None], end[:, None]
                    meets = ~same & (begin <= end) & (most >= begin) & (least <= end)
                    inside = meets & (least >= begin) & (most <= end)
                    order = np.argsort(np.where(inside, -least, -NONE - 1), axis=1, kind="stable")
                    held = np.cumsum(np.take_along_axis(inside * sizes, order, 1), axis=1) >= negatives
                    last = np.take_along_axis(order, held.argmax(1)[:, None], 1)
                    beaten = np.where(held.any(1)[:, None], np.take_along_axis(least, last, 1), NONE)
                    need |= meets & (most >= beaten)
            at = np.flatnonzero(need.any(0))
            yield _batch(CHOSEN, [[row["gid"]] * len(at), blocks[at], [np.packbits(need[:, k]).tobytes() for k in at]])

    return run


def _top(parts: list[np.ndarray], most: int) -> np.ndarray:
    """Best rows (slot, place, id, score) of each slot and place."""
    rows = np.concatenate(parts)
    rows = rows[np.lexsort((rows[:, 2], -rows[:, 3], rows[:, 1], rows[:, 0]))]
    first = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]) if len(rows) else np.zeros(0, int)
    rank = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)]))
    return rows[rank < most]


def _read(positives: int, negatives: int, low: int, high: int):
    """Best rows of the chosen blocks: positives, or negatives where the windows are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid, held, count = None, [], 0

        def out() -> pa.RecordBatch:
            best = _top(held, most)
            return _batch(BEST, [np.full(len(best), gid), *best.T])

        for row in _rows(batches):
            mining = "found" in row
            most = negatives if mining else positives
            if held and (row["gid"] != gid or count > MERGE):
                if row["gid"] == gid:
                    held = [_top(held, most)]
                    count = len(held[0])
                if row["gid"] != gid or count > MERGE:
                    yield out()
                    held, count = [], 0
            gid, dim = row["gid"], row["dim"]
            ids, a = np.frombuffer(row["block_ids"], "<i8"), _matrix(row["vectors"], dim)
            slots = np.flatnonzero(np.unpackbits(np.frombuffer(row["chosen"], np.uint8))[: len(a)])
            found = scores(a[slots], _matrix(row["block_vectors"], dim))
            order = np.argsort(-found, axis=1, kind="stable")
            ranked = np.take_along_axis(found, order, 1)
            if mining:
                least, end = (w[slots] for w in _windows(row, len(a), positives, low, high))
            else:  # one place above, as the anchor itself may be among them
                least, end, most = np.full((len(slots), 1), NONE), np.full((len(slots), 1), -(NONE + 1)), positives + 1
            own = np.frombuffer(row["ids"], "<i8")[slots]
            for place in range(least.shape[1]):
                at = (ranked > end[:, place, None]).sum(1)[:, None] + np.arange(most)
                real = at < len(ids)
                at = np.minimum(at, len(ids) - 1)
                score, who = np.take_along_axis(ranked, at, 1), ids[np.take_along_axis(order, at, 1)]
                i, j = np.nonzero(real & (score >= least[:, place, None]) & (mining | (who != own[:, None])))
                held.append(np.stack([slots[i], np.full(len(i), place), who[i, j], score[i, j]], axis=1))
                count += len(i)
            most = negatives if mining else positives
        if held:
            yield out()

    return run


def blocks_of(vectors: DataFrame, anchors: Column, scale: float = 256.0, size: int = BLOCK) -> DataFrame:
    """Stored blocks with their zone maps, in Hilbert order; rows where ``anchors`` holds are marked."""
    raw = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("anchor"))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & (F.size("v") > 0)
    whole = raw.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine).mapInArrow(_whole(scale), WHOLE)
    rest = ["label", "dim", "vector", "anchor"]
    once = materialize(whole.groupBy("vec_id").agg(F.min(F.struct(*rest)).alias("r")).select("vec_id", *(F.col(f"r.{c}").alias(c) for c in rest)), "whole")
    once = once.select("vec_id", "label", "anchor", "dim", "vector")
    spread = once.mapInArrow(_spread, SPREAD).groupBy("dim", "axis").agg(
        *(F.sum(c).alias(c) for c in ("n", "total", "squares")), F.min("low").alias("low"), F.max("high").alias("high"))
    varied = (F.col("squares") - F.col("total") * F.col("total") / F.col("n")).desc()
    widest = spread.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy(varied, "axis"))).where(F.col("place") <= AXES)
    axes: dict[int, list] = {}
    for r in widest.orderBy("dim", "place").collect():
        axes.setdefault(r.dim, []).append((r.axis, r.low, r.high))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "dim", "key", "vec_id"]
    laid = once.mapInArrow(_keyed(axes), KEYED).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(laid.mapInArrow(_blocks(size), BLOCKS), "blocks")


def _met(groups: DataFrame, pages: DataFrame) -> DataFrame:
    """Every group beside every page of its vector length, spread by the pages' salt."""
    dealt = pages.withColumn("salt", F.pmod(F.xxhash64("page"), F.lit(SALT)).cast("int")).withColumnRenamed("labels", "block_labels")
    return groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).join(dealt, ["dim", "salt"]).drop("salt", "page")


def reading_plan(groups: DataFrame, pages: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """``gid, block, chosen``: the blocks that anchors of a group must read (bits of ``chosen``)."""
    return _met(groups, pages).mapInArrow(_choose(positives, negatives, low, high), CHOSEN)


def _answers(groups: DataFrame, pages: DataFrame, blocks: DataFrame, *how: int) -> DataFrame:
    rows = blocks.select("block", F.col("ids").alias("block_ids"), F.col("vectors").alias("block_vectors"))
    return reading_plan(groups, pages, *how).join(rows, "block").join(groups, "gid").mapInArrow(_read(*how), BEST)


def _ranked(best: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("gid", "slot", "place").orderBy(F.col("score").desc(), "id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def packed(blocks: DataFrame, positives: int) -> tuple[DataFrame, DataFrame]:
    """Groups of anchors and pages of zone maps."""
    groups = materialize(blocks.mapInArrow(_groups(GROUP, positives), GROUPS), "groups")
    pages = materialize(blocks.select("block", "label", "dim", "n", "low", "high").mapInArrow(_pages(PAGE), PAGES), "pages")
    return groups, pages


def with_positives(groups: DataFrame, pages: DataFrame, blocks: DataFrame, *how: int) -> DataFrame:
    """Groups whose ``found`` lists the positives of each slot (at most ``positives`` each)."""
    best = _ranked(_answers(groups, pages, blocks, *how), how[0])
    found = best.groupBy("gid").agg(F.collect_list(F.struct("slot", (F.col("rank") - 1).alias("place"), "id", "score")).alias("found"))
    return materialize(groups.join(found, "gid"), "positives")


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, size: int = BLOCK
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``vectors`` (``vec_id``,
    ``embedding``, ``label``), of which those where ``anchors`` holds are anchors."""
    how = (positives, negatives, low, high)
    blocks = blocks_of(vectors, anchors, scale, size)
    groups, pages = packed(blocks, positives)
    known = with_positives(groups, pages, blocks, *how)
    best = _ranked(_answers(known, pages, blocks, *how), negatives)
    slots = known.select("gid", "ids", F.explode("found").alias("p")).mapInArrow(_named, "gid long, slot int, place int, anchor_id long, positive_id long, positive_score long")
    return best.join(slots, ["gid", "slot", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = "gid long, slot int, place int, anchor_id long, positive_id long, positive_score long"
    for batch in batches:
        rows = [(r["gid"], r["p"]["slot"], r["p"]["place"], int(np.frombuffer(r["ids"], "<i8")[r["p"]["slot"]]), r["p"]["id"], r["p"]["score"]) for r in batch.to_pylist()]
        yield _batch(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 6)


HARD_NEGATIVES_SQL = """
    WITH whole AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
      list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
    scored AS (SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
      FROM whole a JOIN whole r ON r.vec_id <> a.vec_id AND len(a.v) = len(r.v) WHERE a.vec_id % 100 = 0),
    positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scored USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
    WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5"""
