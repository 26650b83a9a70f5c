"""Near duplicates among vectors by E8 lattice hashing.

Each of several tables projects the normalised vector to eight dimensions by a random orthonormal map, scales it and
decodes it to the nearest point of the E8 lattice (the densest packing in eight dimensions, so cells are as round as
they can be).  A vector is stored under its own cell and looked up under its own cell and those neighbours of it, out
of the 240 that touch it, that lie nearest.  Pairs found are verified by the cosine in double precision.  The scale
follows the threshold: it makes the distance of a pair *at* the threshold ``REACH`` on average, a little less than the
cells' width, so that 16 tables find such a pair with 0.98 or more in 2 dimensions as in 768.

Equal vectors are stored once with their number, so a group of copies costs one row.  Links between different vectors
are all found out and counted; none are capped.  Cells hold ids alone; candidates meet their vectors once each and are
compared in Arrow batches of joined rows, and no cell is gathered in one place.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as do
those with a null label or ``vec_id``; they return ``n_links`` 0 and themselves as component.  Vectors of different
length are never linked.  Rows that share a ``vec_id`` are one node that has all their
links; its ``n_links`` is the largest count of its vectors.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.llm.common import components, materialize, mix, ordered

TABLES, PROBES, SEED = 16, 8, 20210
#: Mean distance, after scaling, of a pair at the threshold; neighbouring lattice points are ``sqrt(2)`` apart.
REACH = 1.15
CELLS = "rep long, label int, home boolean, cell long"


@cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    whole = [s * np.eye(8)[i] + t * np.eye(8)[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    half = [v for k in range(256) if (v := np.array([0.5 - (k >> i & 1) for i in range(8)])).sum() % 2 == 0]
    return np.array(whole + half)


def _even(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum (the lattice D8)."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(x[odd] - near[odd]).argmax(1)
    off = x[odd, worst] - near[odd, worst]
    near[odd, worst] += np.where(off >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points of the rows of ``x``: the better of D8 and D8 shifted by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(nearer[:, None], a, b)


@cache
def projections(dim: int, tables: int, seed: int) -> np.ndarray:
    """``tables`` maps to eight dimensions, by blocks of random rotations so that maps of one block don't overlap."""
    rng, maps = np.random.default_rng([seed, dim]), []
    while len(maps) < tables:
        width = max(dim, 8)
        turn = np.linalg.qr(rng.standard_normal((width, width)))[0][:dim] * np.sqrt(width / 8)
        maps += [turn[:, 8 * k : 8 * k + 8] for k in range(width // 8)]
    return np.stack(maps[:tables])


def scale_of(least: float) -> float:
    """Factor that brings unit vectors with this cosine to a distance of ``REACH``."""
    return REACH / np.sqrt(max(2 - 2 * least, 1e-6))


def cells(vectors: np.ndarray, tables: int, probes: int, scale: float, seed: int) -> np.ndarray:
    """Keys (row, table, 1 + probes): the own cell first."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = np.empty((len(unit), tables, 1 + probes), np.int64)
    for t, turn in enumerate(projections(vectors.shape[1], tables, seed)):
        x = scale * (unit @ turn)
        own = decode(x)
        toward = (x - own) @ neighbours().T
        best = np.argsort(-toward, axis=1, kind="stable")[:, :probes]
        points = np.concatenate([own[:, None], own[:, None] + neighbours()[best]], axis=1)
        key = np.full(points.shape[:2], t, np.uint64)
        for axis in range(8):
            key = mix(key * np.uint64(31) + (2 * points[:, :, axis]).astype(np.int64).view(np.uint64))
        out[:, t] = key.view(np.int64)
    return out


def _cells(tables: int, probes: int, scale: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("vector").to_pylist()
            reps, labels = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "label"))
            lengths = np.array([len(v) for v in raw])
            for size in np.unique(lengths):
                rows = np.flatnonzero(lengths == size)
                for part in np.array_split(rows, -(-len(rows) // 512)):
                    found = cells(np.stack([np.frombuffer(raw[i], np.float64) for i in part]), tables, probes, scale, seed)
                    of = np.repeat(part, tables * (1 + probes))
                    home = np.tile(np.arange(1 + probes) == 0, len(part) * tables)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reps[of], pa.int64()), pa.array(labels[of], pa.int32()), pa.array(home), pa.array(found.ravel())],
                        ["rep", "label", "home", "cell"],
                    )

    return run


def _close(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = batch.column("first").to_pylist(), batch.column("second").to_pylist()
            keep = np.zeros(len(first), bool)
            alike = np.array([len(x) == len(y) for x, y in zip(first, second, strict=True)], bool)
            lengths = np.array([len(x) for x in first])
            for size in np.unique(lengths[alike]):
                rows = np.flatnonzero(alike & (lengths == size))
                x = np.frombuffer(b"".join(first[i] for i in rows), np.float64).reshape(len(rows), -1)
                y = np.frombuffer(b"".join(second[i] for i in rows), np.float64).reshape(len(rows), -1)
                cosine = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
                keep[rows] = cosine >= least
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        flat, ends = batch.column("scaled"), batch.column("scaled").offsets.to_numpy()
        values = flat.values.to_numpy(zero_copy_only=False)
        out = [values[i:j].tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "vector"])


def vector_links(vectors: DataFrame, least: float = 0.98, tables: int = TABLES, probes: int = PROBES, scale: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Classes of equal vectors (``vec_id``, ``rep``, ``copies``) and links ``a``, ``b`` between representatives."""
    scale = scale_of(least) if scale is None else scale
    raw = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>").alias("v"))
    top = F.array_max(F.transform("v", F.abs))
    fine = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & (top > 0)
    # a power of two, so that squares neither overflow nor vanish; the cosine stays as it is
    raw = raw.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine)
    raw = raw.withColumn("scaled", F.transform("v", lambda x: (x / F.pow(F.lit(2.0), F.floor(F.log2(top)))) + F.lit(0.0)))
    stored = materialize(raw.select("vec_id", "label", "scaled").mapInArrow(_as_bytes, "vec_id long, label int, vector binary"), "vectors")
    classes = stored.groupBy("label", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialize(classes, "classes")
    spread = classes.select("rep", "label", "vector").mapInArrow(_cells(tables, probes, scale, seed), CELLS)
    spread = materialize(spread, "cells")
    kept = spread.where("home").select(F.col("rep").alias("to"), "label", "cell")
    found = spread.select(F.col("rep").alias("from"), "label", "cell").join(kept, ["label", "cell"]).where("from <> to")
    found = found.select(*ordered("from", "to"), "label").distinct()
    first = classes.select(F.col("rep").alias("a"), "label", F.col("vector").alias("first"))
    second = classes.select(F.col("rep").alias("b"), "label", F.col("vector").alias("second"))
    pairs = found.join(first, ["a", "label"]).join(second, ["b", "label"]).select("a", "b", "first", "second")
    links = materialize(pairs.mapInArrow(_close(least), "a long, b long").distinct(), "links")
    members = stored.join(classes, ["label", "vector"]).select("vec_id", "rep", "copies")
    return materialize(members, "members"), links


def near_vectors(vectors: DataFrame, least: float = 0.98, **method) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors`` (``vec_id``, ``embedding``, ``label``)."""
    members, links = vector_links(vectors, least, **method)
    copies = members.groupBy("rep").agg(F.max("copies").alias("copies"))
    lowest = members.groupBy("vec_id").agg(F.min("rep").alias("b"), F.max("rep").alias("high")).where("b <> high").drop("high")
    shared = members.join(lowest, "vec_id").where("rep <> b").select(F.col("rep").alias("a"), "b")
    ways = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = ways.join(copies.withColumnRenamed("rep", "b"), "b").groupBy("a").agg(F.sum("copies").alias("others"))
    groups = components(links.union(shared)).withColumnRenamed("node", "a")
    per_class = copies.withColumnRenamed("rep", "a").join(linked, "a", "left").join(groups, "a", "left")
    per_class = materialize(per_class.select(
        F.col("a").alias("rep"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "a").alias("group")), "labels")
    known = members.join(per_class, "rep").groupBy(F.col("vec_id").alias("id")).agg(F.max("links").alias("links"), F.min("group").alias("group"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(known, F.col("vec_id") == F.col("id"), "left")
    group = F.coalesce("group", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), group.alias("component_id"), (F.col("vec_id") == group).alias("kept"))
