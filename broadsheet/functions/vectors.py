"""Vector arithmetic on array columns. Scores for a fixed query vector use one matrix product per Arrow
batch; scores between two columns of one row use the same element-wise batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ("cosine", "dot", "euclidean")


def check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}, expected one of {METRICS}")


def matrix(column: pa.Array, dim: int | None = None, kind=np.float64) -> np.ndarray:
    """Arrow list column without NULLs → float64 matrix (``kind=None``: single precision stays as it is)."""
    lengths = np.unique(np.diff(column.offsets.to_numpy())) if len(column) else np.array([dim or 0])
    if len(lengths) > 1:
        raise ValueError("vectors of one column must have one length")
    values = column.flatten().to_numpy(zero_copy_only=False)
    values = values if kind is None and values.dtype == np.float32 else values.astype(kind or np.float64)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, dim or 0)


def _norms(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=-1))
    return np.where(n == 0, np.nan, n)


def scores(corpus: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """(rows of corpus) × (rows of queries) similarities."""
    if metric == "euclidean":
        squared = (corpus**2).sum(1)[:, None] + (queries**2).sum(1)[None, :] - 2.0 * (corpus @ queries.T)
        return 1.0 / (1.0 + np.sqrt(np.maximum(squared, 0.0)))
    product = corpus @ queries.T
    if metric == "dot":
        return product
    return product / _norms(corpus)[:, None] / _norms(queries)[None, :]


def _masked(result: np.ndarray, valid: np.ndarray) -> pa.Array:
    out = np.full(len(valid), np.nan)
    out[valid] = result
    return pa.array(out, mask=np.isnan(out))


def similarity_to(vector, query: list[float], metric: str = "cosine") -> Column:
    """Similarity of an array column to one given vector (NULL for NULL or zero vectors)."""
    check_metric(metric)
    q = np.asarray(query, dtype=np.float64)[None, :]

    @F.arrow_udf(T.DoubleType())
    def score(v: pa.Array) -> pa.Array:
        valid = np.asarray(v.is_valid())
        return _masked(scores(matrix(v.drop_null(), q.shape[1]), q, metric)[:, 0], valid)

    return score(F.col(vector) if isinstance(vector, str) else vector)


def similarity(a, b, metric: str = "cosine") -> Column:
    """V02. Similarity of two array columns of one row: cosine, dot, or 1/(1+euclidean distance)."""
    check_metric(metric)

    @F.arrow_udf(T.DoubleType())
    def score(x: pa.Array, y: pa.Array) -> pa.Array:
        valid = np.asarray(x.is_valid()) & np.asarray(y.is_valid())
        keep = pa.array(valid)
        mx, my = matrix(x.filter(keep)), matrix(y.filter(keep))
        if metric == "euclidean":
            result = 1.0 / (1.0 + np.sqrt(((mx - my) ** 2).sum(1)))
        else:
            result = (mx * my).sum(1)
            if metric == "cosine":
                result = result / _norms(mx) / _norms(my)
        return _masked(result, valid)

    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return score(as_col(a), as_col(b))


def distance_to_similarity(distance) -> Column:
    """V08."""
    return F.lit(1.0) - (F.col(distance) if isinstance(distance, str) else distance)
