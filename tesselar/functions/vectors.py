"""Embedding algebra: Arrow batches for per-row maths, Summarizer for distributed means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf


def matrix(column: pa.Array) -> np.ndarray:
    """Arrow list column of equal-length vectors as an (n, d) float64 view."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(n, -1) if n else flat.reshape(0, 0)


def list_column(m: np.ndarray) -> pa.Array:
    n, d = m.shape
    offsets = np.arange(n + 1, dtype=np.int32) * d
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(m).ravel()))


def unit_rows(m: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    norm[norm == 0] = 1.0
    return m / norm


def sanitise(c: Column) -> Column:
    """NaN and infinities become 0."""
    return F.transform(
        c.cast("array<double>"),
        lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x),
    )


@arrow_udf(T.ArrayType(T.DoubleType()))
def unit(v: pa.Array) -> pa.Array:
    """Finite values, L2-normalised; a zero vector stays zero."""
    m = matrix(v)
    return list_column(unit_rows(np.where(np.isfinite(m), m, 0.0))) if len(v) else pa.array([], pa.list_(pa.float64()))


def unit_about(c: Column, centre: np.ndarray) -> Column:
    """Subtract ``centre`` and normalise again."""

    @arrow_udf(T.ArrayType(T.DoubleType()))
    def run(v: pa.Array) -> pa.Array:
        return list_column(unit_rows(matrix(v) - centre)) if len(v) else pa.array([], pa.list_(pa.float64()))

    return run(c)


def dot_with(c: Column | str, fixed: np.ndarray) -> Column:
    """Dot product with one fixed vector."""

    @arrow_udf(T.DoubleType())
    def run(v: pa.Array) -> pa.Array:
        return pa.array(matrix(v) @ fixed if len(v) else [], pa.float64())

    return run(c)


@arrow_udf(T.DoubleType())
def dot(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(np.einsum("nd,nd->n", matrix(a), matrix(b)) if len(a) else [], pa.float64())


@arrow_udf(T.DoubleType())
def l2_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(np.linalg.norm(matrix(a) - matrix(b), axis=1) if len(a) else [], pa.float64())


def mean_vector(c: Column) -> Column:
    """Aggregate: component-wise mean with partial sums on the map side."""
    return vector_to_array(Summarizer.mean(array_to_vector(c)))


def representation(features: DataFrame, metric: str = "cosine") -> DataFrame:
    """``(id, vec)`` in the space of ``metric``: ``cosine`` or ``cosine_centered``."""
    units = features.select("id", unit(F.col("embedding")).alias("vec"))
    if metric != "cosine_centered":
        return units
    return units.select("id", unit_about(F.col("vec"), overall_mean(units)).alias("vec"))


def overall_mean(rep: DataFrame) -> np.ndarray:
    """Mean of all vectors: one D-sized row reaches the driver."""
    return np.array(rep.agg(mean_vector(F.col("vec"))).first()[0], dtype=np.float64)
