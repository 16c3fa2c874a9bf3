"""Vectors as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(column: str = "embedding") -> Column:
    """True for vectors that are not null and hold finite entries only."""
    # NaN is above every number in Spark, so one comparison refuses it too.
    finite = F.forall(column, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.col(column).isNotNull() & F.coalesce(finite, F.lit(False))


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The lists as rows of a matrix; those shorter than `width` end in zeros."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
