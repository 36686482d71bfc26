"""Shared steps of the two vector operators: usable rows, blocks of rows as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str = "embedding") -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def bounded_sample(df: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About `rows` rows, by a threshold on the key's hash: the same ones in every run."""
    share = min(1.0, rows / max(1, total))
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) <= int(share * ((1 << 30) - 1)))
