"""Vectors as whole numbers, and as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship

ship(__name__)

#: Whole numbers are held between minus this and this; beyond it neighbouring doubles are more than one apart.
LIMIT = 1 << 53


def usable(df: DataFrame, vector: str) -> DataFrame:
    """df without rows whose vector is null or holds null or non-finite entries."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    return df.filter(F.col(vector).isNotNull() & F.forall(vector, finite))


def whole(vector: str, scale: int, offset: int = 0) -> Column:
    """floor(scale * c) + offset for every entry c, taken as double; the floor is held within LIMIT."""
    floor = lambda c: F.greatest(F.least(F.floor(c.cast("double") * scale), F.lit(LIMIT)), F.lit(-LIMIT))
    return F.transform(vector, lambda c: (floor(c) + offset).cast("long"))


def matrix(column: pa.Array | pa.ChunkedArray, fill: int = 0, dim: int | None = None) -> np.ndarray:
    """The rows of a column of lists of longs; shorter ones end with fill."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    size = np.diff(column.offsets.to_numpy()) if n else np.zeros(0, dtype=np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    dim = int(size.max(initial=0)) if dim is None else dim
    if (size == dim).all():
        return flat.reshape(n, dim)
    out = np.full((n, dim), fill, dtype=np.int64)
    row = np.repeat(np.arange(n), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


def wider(x: np.ndarray, dim: int) -> np.ndarray:
    """x with columns of noughts up to dim."""
    return x if x.shape[1] == dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))
