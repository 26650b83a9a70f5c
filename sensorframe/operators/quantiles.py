"""Exact interpolated quantiles without gathering the values in one place."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 4096
GATHER = 1_000_000


def _order_statistic(values: DataFrame, column: str, rank: int) -> float:
    """Value at 0-based ``rank``: narrow the range by histograms, then sort what is left.

    Every pass is one scan with a map-side combined histogram of ``BINS`` rows.
    """
    low, high = values.agg(F.min(column), F.max(column)).first()
    if math.isnan(high):
        raise ValueError("quantile of NaN values")
    c = F.col(column)
    inside = values
    while low < high:
        width = (high - low) / BINS
        if width <= 0 or low + width == low:
            break
        bin_of = F.least(F.lit(BINS - 1), F.floor((c - low) / width)).cast("int")
        rows = (
            inside.groupBy(bin_of.alias("b"))
            .agg(F.count("*").alias("n"), F.min(c).alias("lo"), F.max(c).alias("hi"))
            .orderBy("b")
            .collect()  # at most BINS rows
        )
        for row in rows:
            if rank < row.n:
                break
            rank -= row.n
        inside = inside.filter((c >= row.lo) & (c <= row.hi))
        if (row.lo, row.hi) == (low, high):
            break
        low, high = row.lo, row.hi
        if row.n <= GATHER:
            break
    if low == high:
        return low
    # At most GATHER rows, or a range too narrow to split further.
    ordered = inside.groupBy(column).agg(F.count("*").alias("n")).orderBy(column)
    for row in ordered.toLocalIterator():
        if rank < row["n"]:
            return row[column]
        rank -= row["n"]
    raise ValueError("rank outside the data")


def exact_quantile(values: DataFrame, column: str, q: float, count: int | None = None) -> float:
    """Linear-interpolated quantile of ``column``; ``values`` should be a stored table."""
    n = values.count() if count is None else count
    if n == 0:
        raise ValueError("quantile of no rows")
    if n <= GATHER:
        return values.agg(F.percentile(column, F.lit(q))).first()[0]
    position = q * (n - 1)
    floor = math.floor(position)
    low = _order_statistic(values, column, floor)
    if position == floor:
        return low
    high = _order_statistic(values, column, floor + 1)
    return low + (high - low) * (position - floor)
