"""Vectors as integers, and batches of them as numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Components beyond this are held to it, so that products of vectors of up to 1,024 components fit into a long.
LIMIT = 1 << 25


def usable(vector: Column) -> Column:
    """True for a vector that is not null and whose components are all finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector.cast("array<double>"), lambda x: F.coalesce(fine(x), F.lit(False))), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double, within ``LIMIT``."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), x * scale))).cast("int"))


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """The rows of a list column as longs; shorter rows end in zeros. ``width`` is known or the longest row's."""
    size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(size.max(initial=0)) if width is None else width
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (size == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < size[:, None]] = values
    return out
