"""Vector arithmetic on ``array<float>`` columns.

Two paths with one meaning: higher-order functions (``dot``, ``norm`` ...) for
short vectors inside larger expressions, and Arrow UDFs (``cosine_scores``) for
scoring whole columns -- one matrix product per batch instead of an interpreted
lambda call per element.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(as_double(a), as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def is_finite_vector(v: Column) -> Column:
    bad = F.exists(as_double(v), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~bad


def clip(c: Column, low: float = -1.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def cosine_distance(v: Column, centroid: Column) -> Column:
    """``1 - cos``; raises on a dimension mismatch, an empty or a zero vector."""
    nv, nc = norm(v), norm(centroid)
    usable = (F.size(v) == F.size(centroid)) & (nv > 0) & (nc > 0)
    score = 1.0 - clip(dot(v, centroid) / (nv * nc))
    return F.when(usable, score).otherwise(
        F.raise_error(F.lit("cosine distance needs equal dimensions and non-zero vectors")).cast("double")
    )


def l2_normalise(v: Column) -> Column:
    """Unit vector as ``array<double>``; raises on a zero or non-finite norm."""
    n = norm(v)
    usable = is_finite_vector(v) & (n > 0)
    return F.when(usable, F.transform(as_double(v), lambda x: x / n)).otherwise(
        F.raise_error(F.lit("representation is not finite or has zero length")).cast("array<double>")
    )


def matrix(column: pa.Array) -> np.ndarray:
    """List column to a row matrix without per-row Python objects."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("embedding is null")
    lengths = np.diff(column.offsets.to_numpy())
    dim = int(lengths[0])
    if dim == 0 or (lengths != dim).any():
        raise ValueError("embeddings of one batch differ in dimension or are empty")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def _unit(rows: np.ndarray) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    if not np.isfinite(length).all() or (length == 0).any():
        raise ValueError("representation is not finite or has zero length")
    return rows / length[:, None]


@F.arrow_udf(T.DoubleType())
def cosine_scores(vector: pa.Array, centroid: pa.Array) -> pa.Array:
    """Row-wise cosine distance of two vector columns."""
    if len(vector) == 0:
        return pa.array([], pa.float64())
    left, right = matrix(vector), matrix(centroid)
    if left.shape[1] != right.shape[1]:
        raise ValueError("embedding dimension does not match the reference centroid")
    cosine = np.einsum("ij,ij->i", _unit(left), _unit(right))
    return pa.array(1.0 - np.clip(cosine, -1.0, 1.0))


def cosine_to(centroid: list[float]):
    """Row-wise cosine distance of a vector column to one vector, which travels once with the function."""
    fixed = np.asarray(centroid, np.float64)
    fixed = fixed / np.sqrt(fixed @ fixed)

    @F.arrow_udf(T.DoubleType())
    def distance(vector: pa.Array) -> pa.Array:
        if len(vector) == 0:
            return pa.array([], pa.float64())
        rows = matrix(vector)
        if rows.shape[1] != len(fixed):
            raise ValueError("embedding dimension does not match the reference centroid")
        return pa.array(1.0 - np.clip(_unit(rows) @ fixed, -1.0, 1.0))

    return distance


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def unit_vectors(vector: pa.Array) -> pa.Array:
    """Row-wise L2 normalisation."""
    if len(vector) == 0:
        return pa.array([], pa.list_(pa.float64()))
    rows = _unit(matrix(vector))
    offsets = np.arange(rows.shape[0] + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))
