"""What vector operators share: usable vectors, and equal vectors as one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str | Column) -> Column:
    """Whether a vector takes part: not null, not empty, without null or non-finite components, not zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """float64 rows of a list column whose lists are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def per_width(df: DataFrame, vector: str) -> list[int]:
    """The lengths of the vectors that there are: vectors of other lengths have no product."""
    return sorted(r[0] for r in df.select(F.size(vector).alias("n")).distinct().collect())
