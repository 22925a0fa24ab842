"""Vector columns for the embedding operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """Not null, not zero, all components finite."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def lengths(vectors: DataFrame, column: str = "embedding") -> list[int]:
    """The lengths that there are. Vectors of different lengths have no cosine and no inner product; each length is searched by itself."""
    return sorted(r[0] for r in vectors.select(F.size(column)).distinct().collect())  # a row a length: models, not vectors


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows of equal length as doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def sample(vectors: DataFrame, node: str, bound: int) -> np.ndarray:
    """At most ``bound`` vectors, the first by a hash of their ids."""
    some = vectors.orderBy(F.xxhash64(F.lit("sample"), node), node).limit(bound).select("embedding").toArrow()
    column = some["embedding"].combine_chunks()
    return matrix(column, len(column[0])) if len(column) else np.zeros((0, 0))
