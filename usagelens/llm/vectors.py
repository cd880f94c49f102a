"""Columns of vectors as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def lengths(df: DataFrame, vector: str) -> list[int]:
    """The different lengths of the vectors, ascending: a handful, as each stands for a model that made them."""
    return sorted(r[0] for r in df.select(F.size(vector)).distinct().collect())


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Rows of equal length as float64."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
