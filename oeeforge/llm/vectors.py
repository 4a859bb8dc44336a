"""Vectors of ``embeddings`` as whole numbers, exact squared distances, and distances rounded to the safe side."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers per unit of a component.
SCALE = 1024
#: Components from here on are not kept: squared distances of their vectors would leave 64 bits.
BEYOND = float(1 << 16)
#: Relative margin of a rounded distance; several times the rounding error of a square root, a sum or a difference.
MARGIN = 2.0**-50
#: Below this size of all numbers, sums of products are exact in doubles.
_SMALL = 1 << 21


def finite(vector: Column) -> Column:
    """Is the vector there, with finite components only? (false for null)"""
    whole = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double")) < F.lit(float("inf"))) & ~F.isnan(x), F.lit(False)))
    return vector.isNotNull() & F.coalesce(whole, F.lit(False))


def whole_numbers(df: DataFrame, dim: int, *columns: str) -> DataFrame:
    """``columns`` and ``vector``: floor(1024 * x) of the rows whose embedding has ``dim`` finite components (below 2**16 in size)."""
    raw = F.col("embedding")
    fits = finite(raw) & (F.size(raw) == dim) & F.forall(raw, lambda x: F.abs(x.cast("double")) < BEYOND)
    numbers = F.transform(raw, lambda x: F.floor(x.cast("double") * SCALE).cast("int"))
    return df.where(fits).select(*columns, numbers.alias("vector"))


def matrix(batch: pa.RecordBatch, column: str = "vector") -> np.ndarray:
    """The equally long lists of a batch's column as rows."""
    lists = batch.column(column)
    return np.asarray(lists.flatten()).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-number rows, as 64-bit numbers (rows of x by rows of y)."""
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)), np.int64)
    if max(int(np.abs(x).max()), int(np.abs(y).max())) < _SMALL:
        a, b = x.astype(np.float64), y.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)).astype(np.int64)
    a, b = x.astype(np.int64), y.astype(np.int64)
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1)


def above(squared: np.ndarray) -> np.ndarray:
    """Not less than the distance."""
    return np.sqrt(np.asarray(squared, np.float64)) * (1 + MARGIN)


def below(squared: np.ndarray) -> np.ndarray:
    """Not more than the distance."""
    return np.sqrt(np.asarray(squared, np.float64)) * (1 - MARGIN)
