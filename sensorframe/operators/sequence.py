"""Order-dependent building blocks that survive a key holding most of the rows.

A plain window over ``run_id`` or ``track_id`` sorts one key in one task.  The
helpers below cut each key into buckets of its order column, do the window work
per bucket, and carry only one small row per bucket across buckets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import few, materialize

BUCKET = 4096


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def number_rows(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[Column], name: str, start: int = 1,
    stored: bool = False,
) -> DataFrame:
    """``row_number`` per ``keys`` in two levels.

    ``bucket`` must not decrease along ``order``.  Rows are ranked inside
    ``(keys, bucket)``; bucket counts (one row per bucket, combined map-side)
    give the offsets.  ``stored``: reading ``df`` is cheap, so the offsets are
    found first, and where they are few, rows bucketed by ``(keys, bucket)`` stay
    where they are.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if stored:
        offsets = few(materialize(offsets, "offsets"))
    local = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = keyed.withColumn("_rank", F.row_number().over(local))
    names = [*keys, "_bucket"]
    return (
        ranked.join(offsets, _same(ranked, offsets, names), "inner")
        .select(
            *[ranked[c] for c in df.columns if c != name],
            (F.col("_rank") + F.col("_offset") + (start - 1)).cast("long").alias(name),
        )
    )


def previous(
    df: DataFrame, keys: Sequence[str], position: str, values: Sequence[str], name: str, bucket: int = BUCKET,
    tie: Sequence[str] = (),
) -> DataFrame:
    """``lag`` of a struct of ``values`` along ``position``, bucketed.

    Only the last row of each bucket crosses buckets, so a key of N rows needs
    a serial window over N/bucket rows instead of N.
    """
    order = [position, *tie]
    cut = df.withColumn("_bucket", F.floor(F.col(position) / bucket))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    payload = F.struct(*values)
    rows = cut.withColumn("_lag", F.lag(payload).over(inside)).withColumn("_rank", F.row_number().over(inside))
    tails = cut.groupBy(*keys, "_bucket").agg(F.max_by(payload, F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    carried = tails.withColumn("_carry", F.lag("_tail").over(across)).drop("_tail")
    on = _same(rows, carried, [*keys, "_bucket"])
    return rows.join(carried, on, "left").select(
        *[rows[c] for c in df.columns],
        F.when(F.col("_rank") == 1, F.col("_carry")).otherwise(F.col("_lag")).alias(name),
    )


def with_halo(df: DataFrame, chunk: Column, into_next: Column, into_previous: Column | None = None) -> DataFrame:
    """Assign rows to chunks and copy boundary rows to the neighbouring chunks.

    Adds ``_chunk`` and ``_own`` (false for copies).
    """
    targets = [F.array(F.lit(0)), F.when(into_next, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))]
    if into_previous is not None:
        targets.append(F.when(into_previous, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    return (
        df.withColumn("_home", chunk.cast("long"))
        .withColumn("_shift", F.explode(F.concat(*targets)))
        .withColumn("_chunk", F.col("_home") + F.col("_shift"))
        .withColumn("_own", F.col("_shift") == 0)
        .drop("_home", "_shift")
    )
