"""Vectors as numbers: which take part, and their directions in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def length(vector: Column) -> Column:
    return F.size(vector)


def doubles(df: DataFrame, column: str) -> Column:
    return F.col(f"`{column}`").cast("array<double>")


def matrix(values):
    """A two-dimensional array of doubles from an Arrow list column without nulls and of one length."""
    import numpy as np

    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 0)


def units(x):
    """Rows scaled to length 1; scaled by the largest component first, so that squares don't overflow."""
    import numpy as np

    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(x, y):
    """cos of each row of x with vector y, from the original values; alike for equal rows, whatever the others."""
    import numpy as np

    a, b = np.abs(x).max(axis=1), np.abs(y).max()
    x, y = x / a[:, None], y / b
    return (x * y).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum()))
