"""Shared handling of embedding columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(col: Column) -> Column:
    """True for vectors that are not null, not zero, and hold finite numbers only."""
    bad = F.exists(
        col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    some = F.exists(col, lambda x: x != 0)
    return F.coalesce(col.isNotNull() & ~bad & some, F.lit(False))


def matrix(col: pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix; the column holds no nulls."""
    if not len(col):
        return np.zeros((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of matching rows, in double precision, each by the same sums wherever the row stands."""
    dot = (a * b).sum(axis=-1)
    return dot / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))
